"""Query catalog: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's ``orders`` table through the loan-book fixture,
so its work grows with the table.  As in the process itself, the clean table is
built once per source and written (``staging``); report queries read the
written table and its tier boundaries, ``clean_table`` itself returns the
freshly derived frame.  All run the shipped operators with shipped settings,
one path at every size.  ``queries(builtin=True)`` gives the same reports on
plain windows and Spark's ``median``, for the bench.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.plans import marts as M
from loanscope.plans import portfolio as P
from loanscope.plans.staging import staged_clean, staged_with_cuts
from loanscope.session import shared_folder
from loanscope.sources.fixture import read_loan_book
from loanscope.sources.loanbook import CSV_HEADER_NAMES, read_loan_csv

Query = Callable[[SparkSession, str], DataFrame]


def _on_clean(fn, **kw) -> Query:
    return lambda spark, sf_dir: fn(staged_clean(spark, sf_dir), **kw)


def _by_tier(fn, builtin: bool) -> Query:
    """Report that needs the tiers of the staged table: with its boundaries, or the plain window."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if builtin:
            return fn(staged_clean(spark, sf_dir), builtin=True)
        clean, cuts = staged_with_cuts(spark, sf_dir)
        return fn(clean, cuts=cuts)
    return run


def _global_ntile(clean: DataFrame, **kw) -> DataFrame:
    return P.tiered(clean.select("loan_id", "utilization"), **kw).select("loan_id", "utilization_capped", "risk_tier")


def _median(raw: DataFrame, builtin: bool) -> DataFrame:
    if builtin:
        return raw.agg(F.median(F.col("monthly_income").cast("double")).alias("median_income"),
                       F.count("monthly_income").alias("income_values"))
    return P.exact_median_income(raw)


def _csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw book written as CSV in two parts whose columns stand in different orders, and imported again."""
    raw = read_loan_book(spark, sf_dir)
    header = {ours: theirs for theirs, ours in CSV_HEADER_NAMES.items() if theirs not in ("", "_c0", "column1")}
    folder = f"{shared_folder(spark)}/loanscope-work/csv-{uuid.uuid4().hex}"
    parts = []
    for half, columns in enumerate((raw.columns, raw.columns[::-1])):
        part = raw.filter(F.pmod("loan_id", F.lit(2)) == half).select([F.col(c).alias(header[c]) for c in columns])
        part.write.option("header", True).option("nullValue", "NA").csv(f"{folder}/{half}")
        parts.append(f"{folder}/{half}")
    return read_loan_csv(spark, parts)


def queries(builtin: bool = False) -> dict[str, Query]:
    form = {"builtin": builtin}
    return {
        # the seven scripts
        "profile": lambda s, d: P.raw_profile(read_loan_book(s, d)),
        "clean_table": lambda s, d: P.clean_table(read_loan_book(s, d), **form),
        # the CSV import, and the same table with the statistics joined as one row
        "csv_import": _csv_import,
        "clean_table_joined": lambda s, d: P.clean_table(read_loan_book(s, d), attach="join"),
        "clean_verify": _on_clean(P.clean_verify),
        "ratio_buckets": _on_clean(P.ratio_buckets),
        "tier_summary": _by_tier(P.tier_summary, builtin),
        "tier_top": _by_tier(P.tier_top, builtin),
        "cohort_trend": _on_clean(P.cohort_trend),
        "watchlist": _on_clean(P.watchlist, **form),
        "concentration": _on_clean(P.concentration),
        # published figures
        "headline_rate": _on_clean(P.headline_rate),
        "gap_audit": _on_clean(P.gap_audit),
        "bucket_extremes": _on_clean(P.bucket_extremes),
        "segment_spread": _by_tier(P.segment_spread, builtin),
        "concentration_gap": _on_clean(P.concentration_gap),
        "impute_effect": lambda s, d: P.impute_effect(read_loan_book(s, d), staged_clean(s, d)),
        "tie_audit": _on_clean(P.tie_audit),
        "cap_effect": _by_tier(P.cap_effect, builtin),
        "top_nondefault": _on_clean(P.top_nondefault, **form),
        "volume_rate_split": _on_clean(P.volume_rate_split),
        # marts
        "mart_executive": _on_clean(M.mart_executive),
        "mart_risk": _by_tier(M.mart_risk, builtin),
        "mart_borrower": _by_tier(M.mart_borrower, builtin),
        # the scale operators by themselves: boundaries looked for, rows ranked (the watch list's, and all), median selected
        "global_ntile": _on_clean(_global_ntile, **form),
        "ranked_peers": _on_clean(P.watchlist, **form),
        "ranked_peers_all": _on_clean(P.ranked_all, **form),
        "exact_percentile": lambda s, d: _median(read_loan_book(s, d), builtin),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration report: the headline of the executive page."""
    return queries()["concentration"](spark, sf_dir)

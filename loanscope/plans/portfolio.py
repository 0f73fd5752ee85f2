"""Portfolio reports with the loan-book defaults (column names, thresholds).

``raw`` is the loan book as read (``RAW_SCHEMA``), ``clean`` the staged table
after ``clean_table``.  Every report runs one way at every size; with
``builtin=True`` it runs on plain windows and Spark's ``median``, the form that
tests and the bench compare with.  ``cuts`` are the tier boundaries of the
table (``tiering.tier_cuts``), found anew where they are not given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import TREND_BASELINE, exact_mean, pct, trend_label
from loanscope.functions.segments import AGE_BANDS, LEGACY_RATIO_EDGES, RATIO_BUCKETS
from loanscope.operators.imputation import impute as impute_frame
from loanscope.operators import quality, ranking, reports, tiering
from loanscope.operators.common import sort_small
from loanscope.operators.rates import segment_rates
from loanscope.operators.selection import exact_percentile
from loanscope.sources.loanbook import CLEAN_COLUMNS

# Fixed values of the process: utilization cap, tier count, top-k per tier,
# watch-list population (90+ days late at least once, ratio strictly < 5.0).
UTILIZATION_CAP = 2.0
TIERS = 5
TOP_PER_TIER = 3
WATCH_MIN_LATE = 1
WATCH_MAX_RATIO = 5.0

NULL_COLS = ["monthly_income", "dependents"]

def bad_age():
    return {"bad_age_rows": F.col("age") == 0}


# -- phase 1 -------------------------------------------------------------------

def raw_profile(raw: DataFrame) -> DataFrame:
    return quality.profile(raw, NULL_COLS, bad_age())


def clean_table(raw: DataFrame, *, builtin: bool = False, **kw) -> DataFrame:
    """Median-filled income, mode-filled dependents, age 0 (and NULL age) dropped."""
    return impute_frame(raw, ["monthly_income"], ["dependents"], keep=F.col("age") != 0,
                        columns=CLEAN_COLUMNS, **({"strategy": "builtin"} if builtin else {}), **kw)


def clean_verify(clean: DataFrame) -> DataFrame:
    return quality.verify(clean, NULL_COLS, bad_age(), stat_col="monthly_income", stat_name="income")


def ratio_buckets(clean: DataFrame) -> DataFrame:
    return segment_rates(clean, RATIO_BUCKETS)


# -- phase 2 -------------------------------------------------------------------

def _tier_form(builtin: bool, cuts: list[tuple] | None) -> dict:
    return {"strategy": "builtin"} if builtin else {"cuts": cuts}


def tier_summary(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    return tiering.tier_summary(clean, "utilization", TIERS, cap_at=UTILIZATION_CAP, **_tier_form(builtin, cuts), **kw)


def tiered(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, out: str = "risk_tier",
           **kw) -> DataFrame:
    return tiering.tier(clean, "utilization", TIERS, cap_at=UTILIZATION_CAP, out=out, **_tier_form(builtin, cuts), **kw)


def tier_top(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    t = tiered(clean.select("loan_id", "utilization", "default_flag"), builtin=builtin, cuts=cuts, **kw)
    top = ranking.top_per_group(t, "risk_tier", "utilization", TOP_PER_TIER, out="util_rank",
                                strategy="builtin" if builtin else "values")
    return (top.select("risk_tier", "loan_id", F.col("utilization").alias("raw_utilization"),
                       "utilization_capped", "default_flag", "util_rank")
            .orderBy("risk_tier", "util_rank", "loan_id"))   # ties make this row-sized: distributed sort


def cohort_trend(clean: DataFrame) -> DataFrame:
    return reports.trend(clean, AGE_BANDS)


def watch_population(clean: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Delinquent, non-artifact borrowers with their age band (filter before any window)."""
    pop = clean.filter((F.col("late_90") >= WATCH_MIN_LATE) & (F.col("debt_ratio") < WATCH_MAX_RATIO))
    return pop.select(AGE_BANDS.label().alias("age_band"), "loan_id", "debt_ratio", "default_flag",
                      *extra)


WATCH_COLUMNS = ["age_band", "loan_id", "debt_ratio", "default_flag", "debt_rank",
                 "next_loan_id", "next_debt_ratio", "next_default_flag"]


def watchlist(clean: DataFrame, *, builtin: bool = False, ordered: bool = True,
              extra: tuple[str, ...] = (), **kw) -> DataFrame:
    ranked = ranking.ranked_peers(watch_population(clean, extra), "age_band", "debt_ratio", "loan_id",
                                  ("default_flag",), rank_name="debt_rank",
                                  strategy="builtin" if builtin else "buckets", **kw)
    out = ranked.select(*WATCH_COLUMNS, *extra)
    return out.orderBy("age_band", "debt_rank", "loan_id") if ordered else out


def ranked_all(clean: DataFrame, *, builtin: bool = False, **kw) -> DataFrame:
    """Every borrower of the clean table ranked in its age band by debt ratio: rank, dense rank and next peer."""
    rows = clean.select(AGE_BANDS.label().alias("age_band"), "loan_id", "debt_ratio", "default_flag")
    ranked = ranking.ranked_peers(rows, "age_band", "debt_ratio", "loan_id", ("default_flag",), rank_name="debt_rank",
                                  dense_name="debt_dense_rank", strategy="builtin" if builtin else "buckets", **kw)
    return ranked.select(*WATCH_COLUMNS, "debt_dense_rank")


def concentration(clean: DataFrame) -> DataFrame:
    return reports.concentration(clean, AGE_BANDS)


# -- published figures ------------------------------------------------------------

def headline_rate(clean: DataFrame) -> DataFrame:
    agg = clean.agg(F.count(F.lit(1)).alias("borrowers"),
                    F.sum(F.col("default_flag").cast("int")).cast("bigint").alias("defaults"))
    return agg.select("borrowers", "defaults",
                      pct("defaults", "borrowers").cast("double").alias("default_rate_pct"))


def gap_audit(clean: DataFrame) -> DataFrame:
    return reports.gap_audit(clean, "debt_ratio", LEGACY_RATIO_EDGES)


def bucket_extremes(clean: DataFrame) -> DataFrame:
    return reports.bucket_extremes(clean, RATIO_BUCKETS)


def segment_spread(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    tiers = tier_summary(clean, builtin=builtin, cuts=cuts, **kw).withColumn("__o", F.col("risk_tier"))
    ages = segment_rates(clean, AGE_BANDS)
    return (reports.segment_spread(tiers, "risk_tier", "__o", "risk_tier")
            .unionByName(reports.segment_spread(ages, "age_band", "age_band_order", "age_band")))


def concentration_gap(clean: DataFrame) -> DataFrame:
    return reports.concentration_gap(clean, AGE_BANDS)


def impute_effect(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Mean income before (non-NULL raw values) and after imputation, rows filled."""
    before = raw.agg(exact_mean("monthly_income", 2).alias("raw_avg_income"),
                     F.count(F.when(F.col("monthly_income").isNull() & (F.col("age") != 0), 1))
                     .alias("filled_rows"))
    after = clean.agg(exact_mean("monthly_income", 2).alias("clean_avg_income"))
    both = before.crossJoin(after)
    return both.select("raw_avg_income", "clean_avg_income",
                       F.round(F.col("clean_avg_income") - F.col("raw_avg_income"), 2).alias("avg_shift"),
                       "filled_rows")


def tie_audit(clean: DataFrame) -> DataFrame:
    """Debt ratios shared by more than one watch-list borrower of a band (tied ranks)."""
    return (watch_population(clean).groupBy("age_band", "debt_ratio")
            .agg(F.count(F.lit(1)).alias("tied_rows"))
            .filter(F.col("tied_rows") > 1))


def cap_effect(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    """Rows whose tier changes when the cap is dropped (ties broken by id)."""
    base = clean.select("loan_id", "utilization")
    raw_cuts = None
    if not builtin:
        cuts = tiering.tier_cuts(base, "utilization", TIERS, cap_at=UTILIZATION_CAP, **kw) if cuts is None else cuts
        raw_cuts = tiering.uncapped_cuts(base, cuts, "utilization", TIERS, cap_at=UTILIZATION_CAP, **kw)
    a = tiered(base, builtin=builtin, cuts=cuts, out="tier_capped")
    b = tiering.tier(a, "utilization", TIERS, cap_at=None, capped="__raw_key", out="tier_raw", **_tier_form(builtin, raw_cuts))
    return b.agg(F.count(F.lit(1)).alias("borrowers"),
                 F.count(F.when(F.col("tier_capped") != F.col("tier_raw"), 1)).alias("tier_changes"))


def top_nondefault(clean: DataFrame, n: int = TOP_PER_TIER, *, builtin: bool = False) -> DataFrame:
    """Per band, the top-n watch-list ranks by debt ratio: how many never defaulted."""
    people, good = watch_population(clean), F.count(F.when(F.col("default_flag") == 0, 1))
    if builtin:
        top = ranking.top_per_group(people, "age_band", "debt_ratio", n, out="debt_rank", dense=False, strategy="builtin")
        found = top.groupBy("age_band").agg(F.count(F.lit(1)).alias("top_rows"), good.alias("non_default_rows"))
    else:                                    # counts per top value are enough: the rows are not needed
        top = ranking.top_counts(people, "age_band", "debt_ratio", n, [good])
        found = top.groupBy("age_band").agg(F.sum("__rows").alias("top_rows"), F.sum("__a0").alias("non_default_rows"))
    return found.withColumn("non_default_pct", pct("non_default_rows", "top_rows").cast("double"))


def volume_rate_split(clean: DataFrame) -> DataFrame:
    """Bands whose default count and default rate move in opposite directions."""
    t = cohort_trend(clean)
    vol = trend_label("defaults_change", "prev_defaults")
    rate = trend_label("rate_change", "prev_rate_pct")
    return (t.select("age_band", "age_band_order", "defaults_change", "rate_change",
                     vol.alias("volume_direction"), rate.alias("rate_direction"))
            .withColumn("diverges", F.when(
                (F.col("volume_direction") != F.lit(TREND_BASELINE))
                & (F.col("volume_direction") != F.col("rate_direction")), 1).otherwise(0).cast("bigint"))
            .transform(lambda d: sort_small(d, "age_band_order")))


def exact_median_income(raw: DataFrame, **kw) -> DataFrame:
    """Median of the raw income by selection, with the count it was taken over."""
    med = exact_percentile(raw, "monthly_income", 0.5, **kw)
    return raw.agg(F.lit(med).cast("double").alias("median_income"),
                   F.count("monthly_income").alias("income_values"))

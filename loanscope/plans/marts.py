"""Report marts: the tables behind the three report pages.

executive : concentration rows with the portfolio headline on every row
risk      : ratio buckets and utilization tiers in one long table
borrower  : the watch list with debt bucket, risk tier and flag columns,
            written partitioned by age band so a page filter prunes folders

Flag definitions are not given by the process; ours reuse its thresholds:
high_debt_flag = debt bucket High, top_tier_flag = highest utilization tier,
priority_flag = debt rank within the first three of the band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import TOTAL_LABEL, exact_mean, pct
from loanscope.functions.segments import RATIO_BUCKETS
from loanscope.plans import portfolio as P
from loanscope.sources.sinks import write_clustered, write_table


def mart_executive(clean: DataFrame) -> DataFrame:
    # The Total row of the report holds the portfolio's figures; the window is over five rows.
    rows = P.concentration(clean)
    total, whole = F.col("age_band") == TOTAL_LABEL, Window.partitionBy()
    with_total = rows.withColumns({
        "portfolio_borrowers": F.max(F.when(total, F.col("borrowers"))).over(whole),
        "portfolio_defaults": F.max(F.when(total, F.col("defaults"))).over(whole)})
    return with_total.withColumn("portfolio_rate_pct", pct("portfolio_defaults", "portfolio_borrowers").cast("double"))


def mart_risk(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    """Debt buckets and risk tiers in one table, from one scan: each row counts once in either dimension."""
    rows = P.tiered(clean.select("loan_id", "debt_ratio", "utilization", "default_flag"), builtin=builtin, cuts=cuts, **kw)
    label = RATIO_BUCKETS.label()
    none = F.lit(None).cast("double")
    places = F.array(
        F.struct(F.lit("debt_bucket").alias("dimension"), label.alias("segment"), none.alias("value")),
        F.struct(F.lit("risk_tier").alias("dimension"), F.col("risk_tier").cast("string").alias("segment"),
                 F.col("utilization_capped").alias("value")))
    counted = (rows.select(F.explode(places).alias("at"), "default_flag").groupBy("at.dimension", "at.segment")
               .agg(F.count(F.lit(1)).alias("borrowers"),
                    F.sum(F.when(F.col("default_flag") == 1, 1).otherwise(0)).cast("bigint").alias("defaults"),
                    exact_mean("at.value", 4).alias("avg_utilization")))
    order = F.when(F.col("dimension") == "risk_tier", F.col("segment").cast("bigint")).otherwise(
        RATIO_BUCKETS.order(F.col("segment")))
    return counted.select("dimension", "segment", order.alias("segment_order"), "borrowers", "defaults",
                          pct("defaults", "borrowers").cast("double").alias("default_rate_pct"), "avg_utilization")


def mart_borrower(clean: DataFrame, *, builtin: bool = False, cuts: list[tuple] | None = None, **kw) -> DataFrame:
    """Watch list plus debt bucket, risk tier (over the whole clean table) and flags."""
    with_tier = P.tiered(clean.select("loan_id", "age", "late_90", "debt_ratio", "default_flag", "utilization"),
                         builtin=builtin, cuts=cuts)
    watch = P.watchlist(with_tier, builtin=builtin, ordered=False, extra=("risk_tier",), **kw)
    return watch.select(
        *P.WATCH_COLUMNS,
        RATIO_BUCKETS.label().alias("debt_bucket"),
        "risk_tier",
        F.when(RATIO_BUCKETS.label() == F.lit("High"), 1).otherwise(0).cast("bigint").alias("high_debt_flag"),
        F.when(F.col("risk_tier") == P.TIERS, 1).otherwise(0).cast("bigint").alias("top_tier_flag"),
        F.when(F.col("debt_rank") <= P.TOP_PER_TIER, 1).otherwise(0).cast("bigint").alias("priority_flag"),
    )


def write_borrower_clustered(clean: DataFrame, path: str, *, files: int = 64, cuts: list[tuple] | None = None) -> str:
    """The borrower mart laid out by debt ratio and age (``read_clustered`` skips files by either)."""
    ages = clean.select("loan_id", "age")
    return write_clustered(mart_borrower(clean, cuts=cuts).join(ages, "loan_id"), path, ["debt_ratio", "age"], files=files)


def write_marts(clean: DataFrame, folder: str, *, mode: str = "overwrite", cuts: list[tuple] | None = None) -> dict[str, str]:
    """Write the three marts below ``folder``; returns table -> path."""
    paths = {
        "executive": write_table(mart_executive(clean), f"{folder}/executive", mode=mode),
        "risk": write_table(mart_risk(clean, cuts=cuts), f"{folder}/risk", mode=mode),
        "borrower": write_table(mart_borrower(clean, cuts=cuts), f"{folder}/borrower", mode=mode,
                                partition_by=["age_band"]),
    }
    return paths

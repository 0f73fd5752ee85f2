"""The whole process in order: stage the raw book as Parquet, profile it,
stage the clean table, verify it, then write every report and the three marts.

Each step is one Spark job over the staged clean table (read back from its
files, so later steps scan Parquet columns with pushdown and never re-run the
imputation).  Report tables with one row per segment are written as single
files; the top-per-tier and tie tables (sized by ties in the data) keep
their partitions; the borrower-sized watch list and borrower mart are
written partitioned by age band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanscope.operators.tiering import tier_cuts
from loanscope.plans import marts as M
from loanscope.plans import portfolio as P
from loanscope.sources.sinks import write_table

SMALL_REPORTS = {
    "ratio_buckets": P.ratio_buckets,
    "tier_summary": P.tier_summary,
    "tier_top": P.tier_top,
    "cohort_trend": P.cohort_trend,
    "concentration": P.concentration,
    "headline_rate": P.headline_rate,
    "gap_audit": P.gap_audit,
    "bucket_extremes": P.bucket_extremes,
    "segment_spread": P.segment_spread,
    "concentration_gap": P.concentration_gap,
    "tie_audit": P.tie_audit,
    "cap_effect": P.cap_effect,
    "top_nondefault": P.top_nondefault,
    "volume_rate_split": P.volume_rate_split,
}


TIE_SIZED = {"tier_top", "tie_audit"}
BY_TIER = {"tier_summary", "tier_top", "segment_spread", "cap_effect"}


def run_process(spark: SparkSession, raw: DataFrame, folder: str, *, mode: str = "overwrite") -> dict[str, str]:
    """Run every step on ``raw`` and write the results below ``folder``."""
    out: dict[str, str] = {}
    folder = folder.rstrip("/")
    # Parse the source once: the statistics behind the imputation take several
    # passes, which then read Parquet columns instead of re-parsing CSV text.
    out["raw"] = write_table(raw, f"{folder}/raw", mode=mode)
    raw = spark.read.parquet(out["raw"])
    out["profile"] = write_table(P.raw_profile(raw).coalesce(1), f"{folder}/profile", mode=mode)
    out["clean"] = write_table(P.clean_table(raw), f"{folder}/clean", mode=mode)
    clean = spark.read.parquet(out["clean"])
    cuts = tier_cuts(clean, "utilization", P.TIERS, cap_at=P.UTILIZATION_CAP)    # once for all reports
    out["clean_verify"] = write_table(P.clean_verify(clean).coalesce(1), f"{folder}/clean_verify", mode=mode)
    for name, fn in SMALL_REPORTS.items():
        df = fn(clean, cuts=cuts) if name in BY_TIER else fn(clean)
        # one file for tables bounded by the number of segments; tables whose
        # size follows ties in the data keep their partitions
        out[name] = write_table(df if name in TIE_SIZED else df.coalesce(1), f"{folder}/{name}", mode=mode)
    out["impute_effect"] = write_table(P.impute_effect(raw, clean).coalesce(1), f"{folder}/impute_effect",
                                       mode=mode)
    # no global sort: rows are ordered by rank inside each task before the
    # band-partitioned write, so every file reads in priority order
    watch = P.watchlist(clean, ordered=False).sortWithinPartitions(
        "age_band", "debt_rank", "loan_id")
    out["watchlist"] = write_table(watch, f"{folder}/watchlist", mode=mode, partition_by=["age_band"])
    for name, path in M.write_marts(clean, f"{folder}/marts", mode=mode, cuts=cuts).items():
        out[f"mart_{name}"] = path
    return out

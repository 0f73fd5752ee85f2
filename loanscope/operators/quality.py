"""Data-quality profile (raw table) and post-load verification (clean table).

Both are one global aggregation: every metric in a single scan, partial
aggregates per task and one tiny final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import exact_mean, pct


def profile(df: DataFrame, null_cols: list[str], invalid: dict[str, Column] | None = None) -> DataFrame:
    """One row: total_rows, ``<c>_nulls``/``<c>_null_pct`` per column, a count per invalid rule."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for c in null_cols:
        aggs.append((F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nulls"))
    for name, pred in (invalid or {}).items():
        aggs.append(F.count(F.when(pred, 1)).alias(name))
    out = df.agg(*aggs)
    cols = [F.col("total_rows")]
    for c in null_cols:
        cols += [F.col(f"{c}_nulls"), pct(f"{c}_nulls", "total_rows").cast("double").alias(f"{c}_null_pct")]
    cols += [F.col(name) for name in (invalid or {})]
    return out.select(*cols)


def verify(df: DataFrame, null_cols: list[str], invalid: dict[str, Column] | None = None, *,
           stat_col: str = "monthly_income", stat_name: str = "income") -> DataFrame:
    """Counts that must be 0 after cleaning, plus mean/min/max of one column."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    aggs += [(F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nulls") for c in null_cols]
    aggs += [F.count(F.when(pred, 1)).alias(name) for name, pred in (invalid or {}).items()]
    s = F.col(stat_col).cast("double")
    aggs += [exact_mean(s, 2).alias(f"avg_{stat_name}"),
             F.min(s).alias(f"min_{stat_name}"),
             F.max(s).alias(f"max_{stat_name}")]
    return df.agg(*aggs)

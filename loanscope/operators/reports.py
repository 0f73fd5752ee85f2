"""Post-aggregate reports over a segmentation: cohort trend, concentration,
boundary-gap audit, bucket extremes and segment spread.

All of them aggregate the big table once (partial aggregation, one row per
segment per task) and then work on a frame with one row per segment; the
windows here (``lag``, grand totals) run over that tiny frame only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import (
    FLAG_TOTAL,
    TOTAL_LABEL,
    concentration_flag,
    pct,
    trend_label,
)
from loanscope.functions.segments import Segmentation
from loanscope.operators.common import sort_small
from loanscope.operators.rates import segment_counts


def trend(df: DataFrame, seg: Segmentation, flag: str = "default_flag") -> DataFrame:
    """Per segment in order: rate, previous segment's defaults and rate, changes, label."""
    counts = segment_counts(df, seg, flag).withColumn("__rate", pct("defaults", "borrowers"))
    w = Window.orderBy(seg.order_name)      # one row per segment: a tiny single partition
    t = (counts
         .withColumn("prev_defaults", F.lag("defaults").over(w))
         .withColumn("__prev_rate", F.lag("__rate").over(w)))
    return (t.select(
        seg.name, seg.order_name, "borrowers", "defaults",
        F.col("__rate").cast("double").alias("default_rate_pct"),
        F.col("prev_defaults"),
        F.col("__prev_rate").cast("double").alias("prev_rate_pct"),
        (F.col("defaults") - F.col("prev_defaults")).alias("defaults_change"),
        F.round(F.col("__rate") - F.col("__prev_rate"), 2).cast("double").alias("rate_change"),
        trend_label(F.col("defaults") - F.col("prev_defaults"), "prev_defaults").alias("trend"),
    ).transform(lambda d: sort_small(d, seg.order_name)))


def concentration(df: DataFrame, seg: Segmentation, flag: str = "default_flag", *,
                  threshold: Decimal | float = Decimal("5")) -> DataFrame:
    """Share of borrowers vs share of defaults per segment, flag, and a Total row last."""
    counts = segment_counts(df, seg, flag)
    everything = Window.partitionBy()       # grand totals over the per-segment rows
    shares = (counts
              .withColumn("__bshare", pct(F.col("borrowers"), F.sum("borrowers").over(everything)))
              .withColumn("__dshare", pct(F.col("defaults"), F.sum("defaults").over(everything))))
    bands = shares.select(
        seg.name, seg.order_name, "borrowers",
        F.col("__bshare").cast("double").alias("borrower_share_pct"),
        "defaults",
        F.col("__dshare").cast("double").alias("default_share_pct"),
        concentration_flag(F.col("__dshare") - F.col("__bshare"), threshold).alias("concentration_flag"),
    )
    total = counts.agg(F.sum("borrowers").alias("borrowers"), F.sum("defaults").alias("defaults")).select(
        F.lit(TOTAL_LABEL).alias(seg.name),
        F.lit(len(seg.labels) + 1).cast("bigint").alias(seg.order_name),
        F.col("borrowers").cast("bigint").alias("borrowers"),
        F.lit(100.0).alias("borrower_share_pct"),
        F.col("defaults").cast("bigint").alias("defaults"),
        F.lit(100.0).alias("default_share_pct"),
        F.lit(FLAG_TOTAL).alias("concentration_flag"),
    )
    return sort_small(bands.unionByName(total), seg.order_name)


def concentration_gap(df: DataFrame, seg: Segmentation, flag: str = "default_flag") -> DataFrame:
    """Per segment: default share minus borrower share, in points (exact on the rounded shares)."""
    counts = segment_counts(df, seg, flag)
    everything = Window.partitionBy()
    b = pct(F.col("borrowers"), F.sum("borrowers").over(everything))
    d = pct(F.col("defaults"), F.sum("defaults").over(everything))
    return counts.select(seg.name, seg.order_name,
                         (d - b).cast("double").alias("gap_points")).transform(
        lambda f: sort_small(f, seg.order_name))


def gap_audit(df: DataFrame, column: str, edges) -> DataFrame:
    """Rows falling into the holes between consecutive interval buckets.

    ``edges``: (label, low, low_included, high, high_included) in order, None
    unbounded.  Every real hole between bucket i and i+1 gives one row with its
    row count (0 included), from a single aggregation over the table.
    """
    x = F.col(column)
    holes = []
    for (la, _, _, hi, hi_inc), (lb, lo, lo_inc, _, _) in zip(edges, edges[1:]):
        if hi is None or lo is None:
            continue
        if hi > lo or (hi == lo and (hi_inc or lo_inc)):
            continue
        cond = (x >= hi if not hi_inc else x > hi) & (x <= lo if not lo_inc else x < lo)
        holes.append((la, lb, float(hi), float(lo), cond))
    if not holes:
        return df.sparkSession.createDataFrame(
            [], "below_bucket string, above_bucket string, gap_low double, gap_high double, rows_in_gap bigint")
    agg = df.agg(*[F.count(F.when(c, 1)).alias(f"__g{i}") for i, (*_, c) in enumerate(holes)])
    rows = F.array(*[F.struct(F.lit(la).alias("below_bucket"), F.lit(lb).alias("above_bucket"),
                              F.lit(lo_v).alias("gap_low"), F.lit(hi_v).alias("gap_high"),
                              F.col(f"__g{i}").alias("rows_in_gap"))
                     for i, (la, lb, lo_v, hi_v, _) in enumerate(holes)])
    return agg.select(F.inline(rows))


def bucket_extremes(df: DataFrame, seg: Segmentation) -> DataFrame:
    """Per segment: rows, min and max of the segmentation's source column."""
    x = F.col(seg.source)
    return (df.select(seg.label().alias(seg.name), x.alias("__x"))
            .groupBy(seg.name)
            .agg(F.count(F.lit(1)).alias("borrowers"),
                 F.min("__x").alias(f"min_{seg.source}"),
                 F.max("__x").alias(f"max_{seg.source}"))
            .withColumn(seg.order_name, seg.order())
            .transform(lambda d: sort_small(d, seg.order_name)))


def segment_spread(rates: DataFrame, label: str, order: str, name: str) -> DataFrame:
    """Highest against lowest segment rate of a rates frame: ratio and points.

    Ties go to the segment that comes first in report order.
    """
    r = rates.select(F.col(label).cast("string").alias("segment"), F.col(order).alias("__o"),
                     F.col("default_rate_pct").cast("decimal(9,2)").alias("__rate"))
    top = F.min_by(F.struct("segment", "__rate"), F.struct(-F.col("__rate"), F.col("__o")))
    bottom = F.min_by(F.struct("segment", "__rate"), F.struct(F.col("__rate"), F.col("__o")))
    agg = r.agg(top.alias("t"), bottom.alias("b"))
    return agg.select(
        F.lit(name).alias("segmentation"),
        F.col("t.segment").alias("top_segment"),
        F.col("t.__rate").cast("double").alias("top_rate_pct"),
        F.col("b.segment").alias("bottom_segment"),
        F.col("b.__rate").cast("double").alias("bottom_rate_pct"),
        (F.col("t.__rate") - F.col("b.__rate")).cast("double").alias("spread_points"),
        F.round(F.try_divide(F.col("t.__rate"), F.col("b.__rate")), 2).cast("double").alias("spread_ratio"),
    )

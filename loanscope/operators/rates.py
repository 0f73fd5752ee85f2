"""Segment default rates: label rows by a segmentation, count borrowers and
defaults per segment, rate in percent, in logical segment order.

The label is a projection fused into the scan's codegen stage and the
aggregation is partial per task, so however skewed the segments are, each
map task emits one row per segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import pct
from loanscope.functions.segments import Segmentation
from loanscope.operators.common import sort_small


def segment_counts(df: DataFrame, seg: Segmentation, flag: str = "default_flag") -> DataFrame:
    """(label, label order, borrowers, defaults) per non-empty segment."""
    labelled = df.select(seg.label().alias(seg.name), F.col(flag))
    agg = labelled.groupBy(seg.name).agg(
        F.count(F.lit(1)).alias("borrowers"),
        F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).cast("bigint").alias("defaults"),
    )
    return agg.withColumn(seg.order_name, seg.order())


def segment_rates(df: DataFrame, seg: Segmentation, flag: str = "default_flag") -> DataFrame:
    counts = segment_counts(df, seg, flag)
    return (counts.select(seg.name, seg.order_name, "borrowers", "defaults",
                          pct("defaults", "borrowers").cast("double").alias("default_rate_pct"))
            .transform(lambda d: sort_small(d, seg.order_name)))

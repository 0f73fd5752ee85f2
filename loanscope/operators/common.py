"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """Order a frame that has one row per segment (a handful of rows).

    ``orderBy`` would plan a range exchange, whose bounds need a sampling job
    of their own; a frame bounded by the number of segments is merged into
    one partition without a shuffle and sorted there instead.  Never use this
    on a borrower-sized frame - those keep ``orderBy`` (distributed sort).
    """
    return df.coalesce(1).sortWithinPartitions(*cols)

"""Column expressions shared by the operators: segment definitions, the
decimal-exact percentage, caps, trend and concentration labels, and the
sort-key description (``OrderKey``) the scale paths compare tuples with."""

from loanscope.functions.expressions import (
    OrderKey,
    cap,
    concentration_flag,
    pct,
    trend_label,
)
from loanscope.functions.segments import AGE_BANDS, RATIO_BUCKETS, Segmentation

__all__ = [
    "AGE_BANDS",
    "RATIO_BUCKETS",
    "OrderKey",
    "Segmentation",
    "cap",
    "concentration_flag",
    "pct",
    "trend_label",
]

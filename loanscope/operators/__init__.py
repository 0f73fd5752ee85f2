"""Generic, column-parameterised operators (DataFrame in, DataFrame out)."""

from loanscope.operators.common import sort_small
from loanscope.operators.imputation import fill_values, impute, mode_frame
from loanscope.operators.quality import profile, verify
from loanscope.operators.ranking import ranked_peers, top_per_group
from loanscope.operators.rates import segment_counts, segment_rates
from loanscope.operators.reports import (
    bucket_extremes,
    concentration,
    concentration_gap,
    gap_audit,
    segment_spread,
    trend,
)
from loanscope.operators.selection import exact_percentile, select_positions
from loanscope.operators.tiering import assign_tiers, ntile_starts, tier, tier_summary

__all__ = [
    "assign_tiers", "bucket_extremes", "concentration", "concentration_gap", "exact_percentile",
    "fill_values", "gap_audit", "impute", "mode_frame", "ntile_starts", "profile", "ranked_peers",
    "segment_counts", "segment_rates", "segment_spread", "select_positions", "sort_small", "tier",
    "tier_summary", "top_per_group", "trend", "verify",
]

"""Scalar helpers.

Percentages are computed in DECIMAL (``n * 100.0 / d``, exact quotient) and
rounded half-up to two places before being emitted as DOUBLE, so results do
not depend on floating-point summation or division order.  Division by zero
yields NULL (``try_divide``) instead of failing the job.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


# Report labels.
TREND_BASELINE = "Baseline"
TREND_IMPROVING = "Improving"
TREND_WORSENING = "Worsening"
TREND_FLAT = "No Change"
FLAG_OVER = "Overrepresented"
FLAG_UNDER = "Underrepresented"
FLAG_EVEN = "Proportionate"
FLAG_TOTAL = "N/A"
TOTAL_LABEL = "Total"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct(numerator: Column | str, denominator: Column | str, scale: int = 2) -> Column:
    """ROUND(numerator * 100.0 / denominator, scale) as an exact DECIMAL."""
    return F.round(F.try_divide(_c(numerator) * F.lit(Decimal("100.0")), _c(denominator)), scale)


def exact_mean(x: Column | str, scale: int) -> Column:
    """Mean rounded to ``scale`` places, summed in DECIMAL: the same whatever the order of the rows.

    Values enter with ten decimal places; an aggregate expression.
    """
    value = _c(x).cast("decimal(28,10)")
    return F.round(F.try_divide(F.sum(value), F.count(value)), scale).cast("double")


def cap(x: Column | str, limit: float) -> Column:
    """Values above ``limit`` become ``limit``; NULL stays NULL (``least`` would not)."""
    col = _c(x)
    return F.when(col > F.lit(limit), F.lit(limit)).otherwise(col)


def trend_label(change: Column | str, previous: Column | str) -> Column:
    """Baseline when there is no previous segment, else the sign of the change."""
    ch, prev = _c(change), _c(previous)
    return (F.when(prev.isNull(), F.lit(TREND_BASELINE))
            .when(ch < 0, F.lit(TREND_IMPROVING))
            .when(ch > 0, F.lit(TREND_WORSENING))
            .otherwise(F.lit(TREND_FLAT)))


def concentration_flag(gap: Column | str, threshold: Decimal | float = Decimal("5")) -> Column:
    """Over/under-representation of a segment's default share against its size share."""
    g = _c(gap)
    t = F.lit(Decimal(str(threshold)))
    return (F.when(g > t, F.lit(FLAG_OVER))
            .when(g < -t, F.lit(FLAG_UNDER))
            .otherwise(F.lit(FLAG_EVEN)))


@dataclass(frozen=True)
class OrderKey:
    """One column of a sort order, with Spark's default NULL placement
    (ascending: NULLs first; descending: NULLs last) unless overridden."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nulls_come_first(self) -> bool:
        return (not self.descending) if self.nulls_first is None else self.nulls_first

    def sort_col(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_come_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_come_first else c.asc_nulls_last()

"""Equal-population tiers (NTILE) and the tier summary.

An NTILE is fully described by its k-1 boundary rows, at positions fixed by n
and k.  They are found by exact selection (``select_positions``), then every
row gets its tier from k-1 literal tuple comparisons - a projection with no
shuffle at all, so the tier summary is a plain partial/final aggregation.  The
same path runs at every size.  ``tier_cuts`` finds the boundaries once; reports
over one table pass them on instead of looking for them again.

``strategy="builtin"`` is ``ntile(k)`` over a window with no partition, where
Spark moves every row into one task: the form that tests and the bench compare
with.  Ties are broken by a unique id (loan id), so tiers are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import OrderKey, cap, exact_mean, pct
from loanscope.operators.common import sort_small
from loanscope.operators.positional import TupleOrder, with_position
from loanscope.operators.selection import select_positions


def ntile_starts(n: int, k: int) -> list[int]:
    """0-based first positions of tiers 2..k for NTILE(k) over n rows.

    The first n mod k tiers hold n div k + 1 rows, the rest n div k; starts
    that fall at or past n (fewer rows than tiers) are dropped.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    q, r = divmod(n, k)
    starts = []
    for idx in range(1, k):
        s = idx * (q + 1) if idx <= r else r * (q + 1) + (idx - r) * q
        if s < n:
            starts.append(s)
    return starts


def boundaries(df: DataFrame, keys: list[OrderKey], k: int, **select_kw) -> list[tuple]:
    """Key tuples of the first rows of tiers 2..k (fewer if there are fewer rows than tiers)."""
    found = select_positions(df, keys, lambda n: ntile_starts(n, k), **select_kw)
    return [found[position] for position in sorted(found)]


def assign_tiers(df: DataFrame, keys: list[OrderKey], k: int, *, out: str = "tier", strategy: str = "select",
                 cuts: list[tuple] | None = None, **select_kw) -> DataFrame:
    """Add ``out`` = NTILE(k) over the order ``keys`` (last key should be unique)."""
    if strategy == "builtin":
        w = Window.orderBy(*[key.sort_col() for key in keys])
        return df.withColumn(out, F.ntile(k).over(w).cast("bigint"))
    if strategy != "select":
        raise ValueError(f"unknown strategy {strategy}")
    if cuts is None:
        cuts = boundaries(df, keys, k, **select_kw)
    tiered = with_position(df, TupleOrder(df, keys), cuts, out)
    return tiered.withColumn(out, (F.col(out) + F.lit(1)).cast("bigint"))


def _capped(df: DataFrame, column: str, cap_at: float | None, capped: str) -> DataFrame:
    return df.withColumn(capped, cap(column, cap_at) if cap_at is not None else F.col(column))


def tier_cuts(df: DataFrame, column: str = "utilization", k: int = 5, *, cap_at: float | None = 2.0,
              tie: str = "loan_id", **select_kw) -> list[tuple]:
    """Boundary rows (capped value, tie) of the k tiers; pass them to ``tier`` and ``tier_summary``."""
    keys = [OrderKey("__capped"), OrderKey(tie)]
    return boundaries(_capped(df.select(column, tie), column, cap_at, "__capped"), keys, k, **select_kw)


def uncapped_cuts(df: DataFrame, cuts: list[tuple], column: str = "utilization", k: int = 5, *, cap_at: float,
                  tie: str = "loan_id", **select_kw) -> list[tuple]:
    """Boundary rows of the tiers by the raw value, from those by the capped value.

    A cap moves no row past another below it: a boundary below the cap is the same row in both orders, and only the
    positions of the others are looked for, among the rows at or above the cap.
    """
    below = [c for c in cuts if c[0] is None or c[0] < cap_at]
    if len(below) == len(cuts):
        return list(cuts)
    # NaN sorts above every number and is capped like one.
    high = df.select(F.col(column).alias("__capped"), tie).filter(F.col(column) >= cap_at)
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column) >= cap_at).alias("high")).first()
    starts = ntile_starts(counted["n"], k)[len(below):]
    first = counted["n"] - counted["high"]
    found = select_positions(high, [OrderKey("__capped"), OrderKey(tie)], [s - first for s in starts], n=counted["high"], **select_kw)
    return below + [found[position] for position in sorted(found)]


def tier(df: DataFrame, column: str = "utilization", k: int = 5, *, cap_at: float | None = 2.0,
         tie: str = "loan_id", capped: str = "utilization_capped", out: str = "risk_tier", **kw) -> DataFrame:
    """Cap the column (NULL stays NULL), then NTILE(k) on (capped, tie)."""
    return assign_tiers(_capped(df, column, cap_at, capped), [OrderKey(capped), OrderKey(tie)], k, out=out, **kw)


def tier_summary(df: DataFrame, column: str = "utilization", k: int = 5, *,
                 flag: str = "default_flag", cap_at: float | None = 2.0, tie: str = "loan_id",
                 capped: str = "utilization_capped", out: str = "risk_tier", **kw) -> DataFrame:
    """Per tier: borrowers, average capped value (4 dp), defaults, default rate %."""
    tiered = tier(df.select(column, tie, flag), column, k, cap_at=cap_at, tie=tie, capped=capped, out=out, **kw)
    agg = tiered.groupBy(out).agg(
        F.count(F.lit(1)).alias("borrowers"),
        exact_mean(capped, 4).alias("avg_utilization"),
        F.sum(F.col(flag).cast("int")).cast("bigint").alias("defaults"),
    )
    return (agg.withColumn("default_rate_pct", pct("defaults", "borrowers").cast("double"))
            .transform(lambda d: sort_small(d, out)))

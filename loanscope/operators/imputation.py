"""Impute-and-stage: median and mode fill-in, invalid rows dropped.

The fill values come from the **raw** rows (before the row filter), as in the
original process.  They are computed once - a median per column and a mode
per column - and attached as literals, so the clean frame is a pure projection +
filter of the raw scan and every later job over it reads the table once, without
re-running the statistics (the same split as Spark ML's ``Imputer``: fit values,
then transform).  ``attach="join"`` instead attaches the same values as a one-row
frame by a broadcast cross join (a one-row side has a proven size).

Median: exact selection (``exact_percentile``) at every size, so no task ever
holds a map of all distinct values; ``strategy="approx"`` opts into
``percentile_approx`` (one pass), ``"builtin"`` into Spark's ``median`` (the form
tests and the bench compare with).

Mode: heavy hitters.  One pass builds a frequent-items summary of bounded size
(built in; summaries of tasks merge) whose error has a known bound; its candidates
are counted exactly in a second pass, and the most frequent is the mode if its
count is above what any value outside them can have.  Else (no value holds a
noticeable share of the rows) all values are counted, combined before the shuffle,
and reduced by ``min_by``.  Ties go to the lowest value; NULL when all are NULL.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.operators.selection import exact_percentile


# Frequent-items summary: counters, and candidates taken from it.  Fixed by the summary's method: it keeps counters in a
# table of the next power of two above counters / 0.75, and no count is off by more than 3.5 parts in that table's size.
COUNTERS = 10_000
CANDIDATES = 64
_SUMMED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def mode_frame(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row: most frequent non-NULL value, by counting all values; ties go to the lowest value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    return counts.agg(F.min_by(F.col(column), F.struct(-F.col("count"), F.col(column))).alias(alias))


def frequent_values(df: DataFrame, column: str, *, counters: int = COUNTERS, candidates: int = CANDIDATES) -> tuple[list, float]:
    """Candidates for the most frequent value, and a number of rows that no other value exceeds."""
    kind, candidates = df.schema[column].dataType, min(candidates, counters)
    value = F.col(column) + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col(column)
    found = df.agg(F.count(column).alias("rows"), F.call_function("approx_top_k", value, F.lit(candidates), F.lit(counters)).alias("top")).first()
    table = 1 << math.ceil(math.log2(max(counters, 1) / 0.75))
    # Listed are the values whose count is above twice the error for certain, as far as the list goes.
    bound = 2 * 3.5 * found["rows"] / table
    if len(found["top"]) == candidates:
        bound = max(bound, min(r["count"] for r in found["top"]))
    return [r["item"] for r in found["top"] if r["item"] is not None], bound


def mode_value(df: DataFrame, column: str, **summary) -> Any:
    """Most frequent non-NULL value of a column, the lowest of several; None if there is none."""
    if isinstance(df.schema[column].dataType, _SUMMED):
        values, bound = frequent_values(df, column, **summary)
        if values:
            counts = df.filter(F.col(column).isin(values)).groupBy(column).count()
            best = counts.agg(F.min_by(F.struct(F.col(column).alias("value"), "count"), F.struct(-F.col("count"), F.col(column))).alias("b")).first()["b"]
            if best is not None and best["count"] > bound:
                return best["value"]
    return mode_frame(df, column, "m").first()["m"]


def stats_frame(df: DataFrame, median_cols: list[str], mode_cols: list[str]) -> DataFrame | None:
    """One-row frame with ``__median_<c>`` (built-in median) and ``__mode_<c>``."""
    stats = None
    if median_cols:
        stats = df.agg(*[F.median(F.col(c).cast("double")).alias(f"__median_{c}") for c in median_cols])
    for c in mode_cols:
        m = mode_frame(df, c, f"__mode_{c}")
        stats = m if stats is None else stats.crossJoin(m)
    return stats


def fill_values(df: DataFrame, median_cols: list[str], mode_cols: list[str], *,
                strategy: str = "select", **select_kw) -> dict[str, Any]:
    """``{"__median_<c>": float | None, "__mode_<c>": value | None}``."""
    if strategy not in ("builtin", "select", "approx"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "approx":
        # opt-in: one pass, bounded sketch per task; a data value close to the
        # median (relative rank error 1/accuracy), not the interpolated one
        accuracy = int(select_kw.get("accuracy", 10_000))
        values = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"__median_{c}")
                          for c in median_cols]).first().asDict() if median_cols else {}
    elif strategy == "select":
        values = {f"__median_{c}": exact_percentile(df, c, 0.5, **select_kw) for c in median_cols}
    else:
        stats = stats_frame(df, median_cols, mode_cols)
        return {} if stats is None else stats.first().asDict()
    values.update({f"__mode_{c}": mode_value(df, c) for c in mode_cols})
    return values


def impute(df: DataFrame, median_cols: list[str], mode_cols: list[str], *,
           keep: Column | None = None, columns: list[str] | None = None,
           strategy: str = "select", attach: str = "literal", **kw) -> DataFrame:
    """Clean frame: NULLs in ``median_cols`` -> median (as DOUBLE), in ``mode_cols``
    -> mode, rows failing ``keep`` dropped (NULL counts as failing), ``columns`` kept."""
    columns = columns or df.columns
    if attach not in ("literal", "join"):
        raise ValueError(f"unknown attach {attach}")
    values = fill_values(df, median_cols, mode_cols, strategy=strategy, **kw)
    fill = {c: F.lit(values[f"__median_{c}"]).cast("double") for c in median_cols}
    fill.update({c: F.lit(values[f"__mode_{c}"]).cast(df.schema[c].dataType) for c in mode_cols})
    src = df
    if attach == "join" and fill:
        stats = df.sparkSession.range(1).select(*[value.alias(f"__fill_{c}") for c, value in fill.items()])
        src = df.crossJoin(F.broadcast(stats))
        fill = {c: F.col(f"__fill_{c}") for c in fill}
    if keep is not None:
        src = src.filter(keep)
    out = []
    for c in columns:
        if c in median_cols:
            out.append(F.coalesce(F.col(c).cast("double"), fill[c]).alias(c))
        elif c in mode_cols:
            out.append(F.coalesce(F.col(c), fill[c]).alias(c))
        else:
            out.append(F.col(c))
    return src.select(*out)

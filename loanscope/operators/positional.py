"""Positional buckets: the shared block behind the scale paths.

A global order statistic (NTILE boundary, percentile) or a rank inside a huge
group cannot be computed by one sort in one task at 100 TB.  Instead:

1. sample a bounded number of rows, let Spark sort that sample and take
   evenly spaced *cut tuples* (their count is a parameter, never a function
   of the table size);
2. give every row the index of the bucket between two cuts: the cuts are one
   sorted array literal and the index is found by a branch-free binary
   search of log2(#cuts) projection steps - inside whole-stage codegen, no
   shuffle, deterministic when a stage is recomputed, and the generated code
   does not depend on the cut values (compiled once, cached);
3. aggregate per bucket (partial aggregation: one row per bucket leaves each
   map task) and prefix-sum the small result.

Cuts only decide how work is split, never the result: a bad sample makes a
bucket larger, not a rank wrong.  Cutting on (key, unique id) tuples splits a
single hot key value (one third of all rows, say) over many buckets.

Tuples are compared column by column against one primitive array literal per
key column, with each key's direction and NULL placement; NaN sorts above
every number and equals itself, as in Spark's sort.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import OrderKey

# Cuts that one pass of an operator asks for at most: a budget its ranges or
# groups share, which keeps the driver-side sample and the literal small.
MAX_CUTS = 4096
# Up to this many cuts (e.g. NTILE boundaries) the position is one flat CASE
# instead of a chain of search steps.  A chain is a sequence of aliases that
# each refer to the previous step several times; a filter or join on its
# result would be expanded by predicate pushdown, so chains stay internal
# (grouping and window keys only) and user-facing columns use the flat form.
FLAT_CUTS = 32


def sql_literal(v, dtype: T.DataType) -> str:
    """Exact Spark SQL literal text for a Python value of a Spark type."""
    if isinstance(dtype, T.StructType):
        names = ["'" + f.name.replace("\\", "\\\\").replace("'", "\\'") + "'" for f in dtype]
        values = [None if v is None else v[f.name] for f in dtype]
        told = "named_struct(" + ", ".join(f"{n}, {sql_literal(x, f.dataType)}" for n, x, f in zip(names, values, dtype)) + ")"
        return f"if({'TRUE' if v is None else 'FALSE'}, NULL, {told})"
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        v = float(v)
        if math.isnan(v):
            txt = "'NaN'"
        elif math.isinf(v):
            txt = "'Infinity'" if v > 0 else "'-Infinity'"
        else:
            txt = f"'{v!r}'"
        return f"CAST({txt} AS {dtype.simpleString()})"
    if isinstance(dtype, T.LongType):
        return f"{int(v)}L"
    if isinstance(dtype, T.IntegerType):
        return f"CAST({int(v)} AS INT)"
    if isinstance(dtype, T.ShortType):
        return f"{int(v)}S"
    if isinstance(dtype, T.ByteType):
        return f"{int(v)}Y"
    if isinstance(dtype, T.BooleanType):
        return "TRUE" if v else "FALSE"
    if isinstance(dtype, T.StringType):
        return f"CAST(X'{str(v).encode('utf-8').hex()}' AS STRING)"
    if isinstance(dtype, T.DecimalType):
        return f"CAST('{Decimal(v)}' AS {dtype.simpleString()})"
    if isinstance(dtype, T.DateType):
        return f"DATE '{v.isoformat()}'"
    if isinstance(dtype, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(dtype, T.TimestampType):
        # collected timestamps are naive local datetimes; integer epoch microseconds are exact
        delta = v.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
        return f"timestamp_micros({micros}L)"
    raise TypeError(f"no literal for {dtype}")


class TupleOrder:
    """A sort order over key columns (each with its own direction and NULL
    placement), compared column by column on primitive values."""

    def __init__(self, df: DataFrame, keys: list[OrderKey]):
        self.keys = keys
        self.types = [df.schema[k.name].dataType for k in keys]

    def row(self) -> list[Column]:
        return [F.col(k.name) for k in self.keys]

    def literal(self, values: tuple) -> list[Column]:
        return [F.expr(sql_literal(v, t)) for v, t in zip(values, self.types)]

    def arrays(self, cuts: list[tuple]) -> list[Column]:
        """One array literal per key column (cut tuples transposed)."""
        cols = []
        for i, t in enumerate(self.types):
            vals = [c[i] for c in cuts] or [None]
            cols.append(F.expr("array(" + ", ".join(sql_literal(v, t) for v in vals) + ")"))
        return cols

    def lt(self, a: list[Column], b: list[Column]) -> Column:
        """Tuple ``a`` sorts strictly before tuple ``b``; never NULL."""
        expr: Column = F.lit(False)
        for key, x, y in reversed(list(zip(self.keys, a, b))):
            strict = F.coalesce((x > y) if key.descending else (x < y), F.lit(False))
            if key.nulls_come_first:
                less = (x.isNull() & y.isNotNull()) | strict
            else:
                less = (x.isNotNull() & y.isNull()) | strict
            expr = less | (x.eqNullSafe(y) & expr)
        return expr


def with_position(df: DataFrame, order: TupleOrder, cuts: list[tuple], out: str, *,
                  split_equal: bool = False, keep_cuts: str | None = None, one_expression: bool = False) -> DataFrame:
    """Add ``out`` = number of cuts that sort at or before the row (0..len(cuts)).

    With ``split_equal`` the value is a *code*: 2*i for rows strictly between
    cut i-1 and cut i, 2*i - 1 for rows equal to cut i-1, so rows equal to a
    sampled tuple (a heavy duplicate) form their own point bucket.
    ``keep_cuts`` keeps the per-key cut arrays as columns ``<keep_cuts><i>``.
    ``one_expression`` makes the search one expression that a join key may hold.
    """
    n = len(cuts)
    if n <= FLAT_CUTS and not split_equal and not keep_cuts:
        # One flat CASE (first cut the row sorts before): a single expression, so
        # filters and joins on the result can be pushed down without re-expanding
        # a chain of search steps.
        row = order.row()
        expr = None
        for i, c in enumerate(cuts):
            cond = order.lt(row, order.literal(c))
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        return df.withColumn(out, F.lit(0) if expr is None else expr.otherwise(F.lit(n)))
    prefix = keep_cuts or f"{out}__cut"
    names = [f"{prefix}{i}" for i in range(len(order.keys))]
    res = df
    for name, arr in zip(names, order.arrays(cuts)):
        res = res.withColumn(name, arr)
    res = search(res, order, names, n, out, one_expression=one_expression)
    if split_equal:
        # index clamped to 1: the guard alone does not stop eager evaluation
        at_cut = (F.col(out) >= 1) & ~order.lt(_cut_at(names, F.greatest(F.col(out), F.lit(1))), order.row())
        res = res.withColumn(out, F.col(out) * 2 - F.when(at_cut, 1).otherwise(0))
    return res if keep_cuts else res.drop(*names)


def _cut_at(names: list[str], idx: Column) -> list[Column]:
    return [F.try_element_at(F.col(nm), idx) for nm in names]


def search(df: DataFrame, order: TupleOrder, names: list[str], most: int, out: str, *, size: Column | None = None,
           one_expression: bool = False) -> DataFrame:
    """Add ``out`` = number of cuts that sort at or before the row: branch-free binary search.

    The cuts are sorted arrays in the columns ``names``, one for each key; a row has ``size`` of them (``most`` by
    default, which no row may exceed).
    """
    res, row = df.withColumn(out, F.lit(0)), order.row()
    size = F.lit(most) if size is None else size
    if one_expression:
        def further(place: Column, step: Column) -> Column:
            take = (place + step <= size) & ~order.lt(row, _cut_at(names, place + step))
            return F.when(take, place + step).otherwise(place)

        steps = [F.lit(1 << i) for i in reversed(range(most.bit_length()))]
        return df.withColumn(out, F.aggregate(F.array(*steps), F.lit(0), further) if steps else F.lit(0))
    step = 1 << max(0, most.bit_length() - 1) if most else 0
    while step >= 1:
        nxt = F.col(out) + F.lit(step)
        take = (nxt <= size) & ~order.lt(row, _cut_at(names, nxt))
        res = res.withColumn(out, F.when(take, nxt).otherwise(F.col(out)))
        step >>= 1
    return res


def in_range(order: TupleOrder, lower: tuple | None, lower_inclusive: bool,
             upper: tuple | None) -> Column:
    """Row lies in [lower, upper) (or (lower, upper) when not inclusive); None is open."""
    cond: Column = F.lit(True)
    row = order.row()
    if lower is not None:
        low = order.literal(lower)
        cond = cond & (~order.lt(row, low) if lower_inclusive else order.lt(low, row))
    if upper is not None:
        cond = cond & order.lt(row, order.literal(upper))
    return cond


def sample_and_count(df: DataFrame, keys: list[OrderKey], rows: int, *, by: str, seed: int = 17) -> tuple[list[tuple], int]:
    """``rows`` sampled key tuples (all, if there are fewer) in key order, and the number of rows, from one pass.

    The sample is the rows whose ``by``, an id, hashes lowest: a bounded heap in each task, and no need to know
    the number of rows before.
    """
    counted = Observation()
    names = [k.name for k in keys]
    seen = df.observe(counted, F.count(F.lit(1)).alias("rows")).select(*names, F.xxhash64(F.col(by), F.lit(seed)).alias("__h"))
    found = seen.orderBy("__h").limit(rows).orderBy(*[k.sort_col() for k in keys]).collect()
    return [tuple(r[:-1]) for r in found], counted.get["rows"]


def pick_cuts(sorted_rows: list[tuple], n_cuts: int) -> list[tuple]:
    """Evenly spaced, de-duplicated tuples from an already sorted list."""
    m = len(sorted_rows)
    if m == 0 or n_cuts <= 0:
        return []
    cuts: list[tuple] = []
    for i in range(1, n_cuts + 1):
        pos = (i * m) // (n_cuts + 1)
        if pos >= m:
            break
        t = sorted_rows[pos]
        if not cuts or not same_tuple(cuts[-1], t):
            cuts.append(t)
    return cuts


def same_tuple(a: tuple, b: tuple) -> bool:
    """Equality as Spark's sort sees it: NULL = NULL, NaN = NaN."""
    for x, y in zip(a, b):
        if x is None or y is None:
            if not (x is None and y is None):
                return False
        elif x != y and not (x != x and y != y):
            return False
    return True

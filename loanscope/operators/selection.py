"""Exact order statistics by selection (scale path G3, also used by G1).

``select_positions`` returns the key tuples found at given 0-based positions
of a total order without sorting the table.  The first pass counts the rows and
builds a mergeable rank sketch of the first key (KLL, built in: bounded per task,
merged in two steps); the quantiles on both sides of each wanted position, as far
apart as twice the sketch's error, are the first cuts.  Where a range between
cuts is still too large, or the first key is not a number in ascending order, a
round samples cut tuples inside the ranges that still hold a wanted position (one
stratified sample).  Each round numbers the buckets between them with one binary search over a sorted cut
array, counts rows per bucket in one aggregation and keeps only the buckets
holding a target.  Rows equal to a sampled tuple form a point bucket, so a
range made of one repeated tuple resolves at once.  When a range is small
enough (``max_candidates`` rows, a parameter) one window job numbers its
rows, partitioned by range, and only the wanted rows reach the driver.

Cost: one pass for count and sketch and one aggregation over the key columns,
which leave about half a per cent of the rows around each position; then per
further round one bounded sample and one aggregation; the open ranges of a round share one budget of ``fanout`` cuts
(many ranges take several passes), each asking for as many as it needs to reach
``max_candidates``.  A sampled cut always splits its range, so rounds end; how
many there are is not limited.  Nothing proportional to the table is collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import OrderKey
from loanscope.operators.positional import MAX_CUTS, TupleOrder, in_range, pick_cuts, with_position
from loanscope.session import spool

# Open ranges narrowed by one pass over the table.
RANGES_AT_ONCE = 64
# Size of the rank sketch, and its rank error (fixed by the method: 2.296 / SKETCH ** 0.9021 with 99 % confidence).
SKETCH = 4096
SKETCH_ERROR = 2.296 / SKETCH ** 0.9021
# Sketches are merged in this many parts before the last one.
MERGED = 64
_SKETCHED = {T.DoubleType: "double", T.LongType: "bigint", T.IntegerType: "bigint", T.ShortType: "bigint",
             T.ByteType: "bigint"}
_TOP = {T.LongType: (1 << 63) - 1, T.IntegerType: (1 << 31) - 1, T.ShortType: (1 << 15) - 1, T.ByteType: 127}


def count_and_sketch(df: DataFrame, column: str) -> dict:
    """``n``, ``nulls`` and, for a column of numbers, ``sketch``: a KLL sketch and the names of its functions; from one pass."""
    kind = _SKETCHED.get(type(df.schema[column].dataType))
    value = F.col(column)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("nulls")]
    if kind is None:
        return df.agg(*aggs).first().asDict() | {"kind": None}
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("__part")).agg(
        *aggs, F.call_function(f"kll_sketch_agg_{kind}", value.cast(kind), F.lit(SKETCH)).alias("sketch"))
    found = parts.agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"),
                      F.call_function(f"kll_merge_agg_{kind}", F.col("sketch")).alias("sketch")).first().asDict()
    return {"n": found["n"] or 0, "nulls": found["nulls"] or 0, "sketch": found["sketch"], "kind": kind}


def _sketch_cuts(df: DataFrame, order: TupleOrder, state: dict, wanted: list[int]) -> list[tuple]:
    """Cut tuples on both sides of the wanted positions, by the sketch of the first key; none where it cannot tell."""
    key, kind = order.keys[0], state["kind"]
    if kind is None or key.descending or not key.nulls_come_first or not state["sketch"]:
        return []
    spark, numbers = df.sparkSession, state["n"] - state["nulls"]
    held = spark.range(1).select(F.lit(bytes(state["sketch"])).alias("s"))
    if not held.select(F.call_function(f"kll_sketch_get_n_{kind}", F.col("s")).alias("n")).first()["n"]:
        return []
    ranks = set()
    for position in wanted:
        rank = (position - state["nulls"]) / max(numbers, 1)
        if 0 <= rank <= 1:
            ranks |= {max(0.0, rank - 2 * SKETCH_ERROR), min(1.0, rank + 2 * SKETCH_ERROR)}
    if not ranks:
        return []
    quantiles = held.select(F.call_function(f"kll_sketch_get_quantile_{kind}", F.col("s"), F.array(*[F.lit(r) for r in sorted(ranks)])).alias("q"))
    edges = set()
    for q in quantiles.first()["q"]:
        # Before the first row with the value, and behind the last: nulls sort first in the other keys' place.
        edges |= {q, math.nextafter(q, math.inf) if kind == "double" else q + 1}
    top = _TOP.get(type(order.types[0]))
    cast = float if kind == "double" else int
    rest = tuple(None for _ in order.keys[1:])
    if any(not k.nulls_come_first for k in order.keys[1:]):
        return []
    return [(cast(e), *rest) for e in sorted(edges) if top is None or e <= top]




@dataclass
class _Range:
    lower: tuple | None
    lower_inclusive: bool
    upper: tuple | None
    offset: int                      # rows of the whole order before this range
    count: int                       # rows inside the range
    targets: list[int] = field(default_factory=list)
    point: bool = False              # every row equals ``lower``: already resolved


def _range_id(order: TupleOrder, ranges: list[_Range]) -> Column:
    expr = None
    for i, r in enumerate(ranges):
        c = in_range(order, r.lower, r.lower_inclusive, r.upper)
        expr = F.when(c, F.lit(i)) if expr is None else expr.when(c, F.lit(i))
    return expr  # NULL outside every range


def select_positions(df: DataFrame, keys: list[OrderKey], positions: list[int] | Callable[[int], list[int]], *,
                     n: int | None = None, fanout: int = MAX_CUTS,
                     max_candidates: int = 500_000, per_cut: int = 16,
                     seed: int = 29, materialize: bool = False) -> dict[int, tuple]:
    """Map each wanted position to the key tuple at that position.

    ``positions`` may be a function of the number of rows; ``n`` is that number, if the caller knows it (the first
    cuts then come from a sample, as there is no pass that could sketch).
    ``fanout`` caps the buckets of a pass; it uses only as many as it
    takes to bring its ranges under ``max_candidates`` (with 2x slack for
    uneven buckets), so 15M rows need one round and 10^12 rows two.
    ``materialize`` spools the key columns once below the shared folder -
    worth it when ``df`` is an expensive derived frame; a Parquet scan of two
    pruned columns is cheaper to re-read.
    """
    names = [k.name for k in keys]
    base = df.select(*names)
    if materialize:
        base = spool(base, "order-keys")
        n = None
    order = TupleOrder(base, keys)
    state = None
    if callable(positions):
        state = count_and_sketch(base, names[0])
        n = state["n"]
        positions = positions(n)
    elif n is None:
        state = count_and_sketch(base, names[0])
        n = state["n"]
    wanted = sorted(set(int(p) for p in positions))
    if any(p < 0 or p >= n for p in wanted):
        raise ValueError(f"positions {wanted} outside 0..{n - 1}")
    fanout = max(2, min(fanout, MAX_CUTS))
    results: dict[int, tuple] = {}
    active = [_Range(None, True, None, 0, n, wanted)] if wanted else []
    rounds = 0
    if state is not None and active and n > max_candidates:
        first = _sketch_cuts(base, order, state, wanted)
        if first:
            active = _narrow(base, order, active, fanout, per_cut, seed, max_candidates, given=first)
    while active:
        big = [r for r in active if not r.point and r.count > max_candidates]
        small = [r for r in active if r.point or r.count <= max_candidates]
        for i in range(0, len(small), RANGES_AT_ONCE):
            results.update(_finish(base, order, small[i:i + RANGES_AT_ONCE]))
        rounds += 1
        at_once = min(RANGES_AT_ONCE, fanout // 2)           # each range of a pass gets two cuts or more
        active = []
        for i in range(0, len(big), at_once):
            active += _narrow(base, order, big[i:i + at_once], fanout, per_cut, seed + rounds, max_candidates)
    return results


def _narrow(base: DataFrame, order: TupleOrder, ranges: list[_Range],
            fanout: int, per_cut: int, seed: int, max_candidates: int, given: list[tuple] | None = None) -> list[_Range]:
    tagged = base.withColumn("__rid", _range_id(order, ranges)).filter(F.col("__rid").isNotNull())
    cuts = {0: given} if given else _sampled_cuts(tagged, order, ranges, fanout, per_cut, seed, max_candidates)
    return _between(tagged, order, ranges, cuts)


def _sampled_cuts(tagged: DataFrame, order: TupleOrder, ranges: list[_Range], fanout: int, per_cut: int, seed: int,
                  max_candidates: int) -> dict[int, list[tuple]]:
    names = [k.name for k in order.keys]
    # Buckets per range: just enough to get under max_candidates (2x slack), within an equal share of the budget.
    share = max(2, fanout // len(ranges))
    fan = {i: max(2, min(share, -(-2 * r.count // max(max_candidates, 1)))) for i, r in enumerate(ranges)}
    # One stratified sample for all ranges, expected fan*per_cut rows each.
    fractions = {i: min(1.0, fan[i] * per_cut / max(r.count, 1)) for i, r in enumerate(ranges)}
    sample = (tagged.sampleBy("__rid", fractions, seed)
              .orderBy(F.col("__rid"), *[k.sort_col() for k in order.keys])
              .limit(4 * per_cut * sum(fan.values()))
              .collect())
    per_range: dict[int, list[tuple]] = {i: [] for i in range(len(ranges))}
    for row in sample:
        per_range[row["__rid"]].append(tuple(row[nm] for nm in names))
    return {i: pick_cuts(per_range[i], fan[i]) for i in per_range}


def _between(tagged: DataFrame, order: TupleOrder, ranges: list[_Range], cuts: dict[int, list[tuple]]) -> list[_Range]:
    """The parts of the ranges between their cuts that hold a wanted position, with their counts."""
    # Ranges are disjoint and ordered, so their cut lists concatenate into one
    # sorted array; a row's code is then shifted by the cuts of earlier ranges.
    all_cuts: list[tuple] = []
    first_cut: dict[int, int] = {}
    for i in range(len(ranges)):
        first_cut[i] = len(all_cuts)
        all_cuts.extend(cuts[i])
    coded = with_position(tagged, order, all_cuts, "__code", split_equal=True)
    hist = coded.groupBy("__rid", "__code").count().collect()
    by_range: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(ranges))}
    for row in hist:
        i = row["__rid"]
        by_range[i].append((row["__code"] - 2 * first_cut[i], row["count"]))

    nxt: list[_Range] = []
    for i, r in enumerate(ranges):
        cl = cuts[i]
        cum = r.offset
        for code_v, cnt in sorted(by_range[i]):
            lo_pos, hi_pos = cum, cum + cnt
            hit = [t for t in r.targets if lo_pos <= t < hi_pos]
            if hit:
                if code_v % 2 == 1:      # rows equal to a cut: the answer is that cut
                    nxt.append(_Range(cl[(code_v + 1) // 2 - 1], True, None, lo_pos, cnt, hit, point=True))
                else:
                    j = code_v // 2
                    lower = cl[j - 1] if j >= 1 else r.lower
                    lower_inc = False if j >= 1 else r.lower_inclusive
                    upper = cl[j] if j < len(cl) else r.upper
                    nxt.append(_Range(lower, lower_inc, upper, lo_pos, cnt, hit))
            cum = hi_pos
    return nxt


def _finish(base: DataFrame, order: TupleOrder, ranges: list[_Range]) -> dict[int, tuple]:
    out: dict[int, tuple] = {}
    todo = []
    for r in ranges:
        if r.point:
            for t in r.targets:
                out[t] = r.lower
        else:
            todo.append(r)
    if not todo:
        return out
    offset = None
    for i, r in enumerate(todo):
        cond = F.col("__rid") == F.lit(i)
        offset = F.when(cond, F.lit(r.offset)) if offset is None else offset.when(cond, F.lit(r.offset))
    wanted = sorted(t for r in todo for t in r.targets)
    w = Window.partitionBy("__rid").orderBy(*[k.sort_col() for k in order.keys])
    rows = (base.withColumn("__rid", _range_id(order, todo)).filter(F.col("__rid").isNotNull())
            .withColumn("__pos", offset.cast("bigint") + F.row_number().over(w) - 1)
            .filter(F.col("__pos").isin(wanted))
            .collect())
    names = [k.name for k in order.keys]
    for row in rows:
        out[row["__pos"]] = tuple(row[nm] for nm in names)
    return out


def exact_percentile(df: DataFrame, column: str, p: float = 0.5, **kw) -> float | None:
    """PERCENTILE_CONT(p) of a column (NULLs ignored) without a global sort.

    Interpolates between the values at positions floor and ceil of p*(n-1),
    the same definition Spark's ``percentile``/``median`` use.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    vals = df.select(F.col(column).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    place = {}

    def both(n: int) -> list[int]:
        if n:
            place["at"] = p * (n - 1)
        return [math.floor(place["at"]), math.ceil(place["at"])] if n else []

    got = select_positions(vals, [OrderKey("__v")], both, **kw)
    if not got:
        return None
    pos = place["at"]
    lo, hi = math.floor(pos), math.ceil(pos)
    lo_v, hi_v = got[lo][0], got[hi][0]
    if lo == hi:
        return lo_v
    return (hi - pos) * lo_v + (pos - lo) * hi_v

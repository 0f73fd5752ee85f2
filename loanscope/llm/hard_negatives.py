"""Hard-negative mining by coordinate pruning of inner products in length buckets (the LEMP way).

``build_index`` packs all rows into blocks: rows are ranged by the length of
their vectors and each block holds rows of one length bucket, with their
normalised coordinates' sorted lists.  ``search`` takes the anchors in blocks of
bounded size against the whole index.  For an anchor and its score bound a block
is skipped when even its longest vector cannot reach the bound; else the bound
gives a feasible range on each of the anchor's ``FOCUS`` largest coordinates,
binary search finds the ranges in the block's sorted lists, and only rows inside
all of them are multiplied out, exactly.  Where the narrowest range still holds
much of the block, the block's scores come from one matrix product.

Each search runs twice: over the part of the index that holds one row in
``SAMPLE``, whose best scores bound the anchors' from below, and over all rows
with those bounds, so that a task hands on few rows an anchor beside the best
that it must.  Nothing is left out: bounds only skip what cannot be in the result.

Vectors are integers (components scaled and rounded down).  Products are taken in
float32 or float64 where their sums stay exact, else in int64; a table whose
products could pass 2**48 is refused with an error.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; vectors of unequal length are filled up with zeros; an
id names its row: a row is never a positive of an anchor of its own id, rows that
share an id else take part one by one, and of rows that share an anchor's id the
first by label and vector is the anchor; ties go to the smaller id; an anchor
without positives or without rows in a positive's range has no rows in the
result; zero vectors score 0; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm.shared import stored

# Rows of a block, and anchors of a pass.
BLOCK = 4096
ANCHORS = 16_384
# Focus coordinates of an anchor, and the share of a block beyond which it is multiplied out whole.
FOCUS = 4
DENSE = 0.2
# One row in SAMPLE gives the first bounds.
SAMPLE = 16
# Ratio of the shortest to the longest length in a bucket.
BUCKET = 0.9
# Found rows that a task holds before it keeps the best, and scores that it holds at once.
FOUND = 2_000_000
SCORES = 4_000_000
LARGEST = 1 << 48
# Rounding of the feasible ranges.
SLACK = 1e-6
NONE = np.iinfo(np.int64).min

INDEX = "sample boolean, rows int, dims int, ids binary, labels binary, vectors binary, lists binary"


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def prepare(rows: DataFrame, *, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
            vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector) of the rows that take part, components as whole numbers."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    valid = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return valid.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                        whole_numbers(F.col(vector_col), scale).alias("vector"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of int64, filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = flat[offsets[0]:offsets[-1]]
    return out


def _pack(dims: int, block: int):
    """Rows (id, label, vector, bucket, sample), sorted by sample, bucket and id, to blocks of one bucket."""
    def packed(batch: pa.RecordBatch):
        vectors = _matrix(batch.column(2), dims)
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        lists = np.argsort(unit, axis=0, kind="stable").T                  # rows of each coordinate by value
        return [batch.column(4)[0].as_py(), batch.num_rows, dims, batch.column(0).to_numpy().astype(np.int64).tobytes(),
                batch.column(1).to_numpy().astype(np.int64).tobytes(),
                vectors.astype(np.int32 if np.abs(vectors).max(initial=0) < 1 << 31 else np.int64).tobytes(),
                np.ascontiguousarray(lists, np.uint16).tobytes()]

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packed(rows), (
                pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))],
                names=["sample", "rows", "dims", "ids", "labels", "vectors", "lists"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = np.stack([batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(3).to_numpy()])
            cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                now = batch.slice(start, stop - start)
                if held and (held[0].column(3)[0], held[0].column(4)[0]) != (now.column(3)[0], now.column(4)[0]):
                    yield made(_joined(held))
                    held = []
                while now.num_rows:
                    room = block - sum(h.num_rows for h in held)
                    held.append(now.slice(0, room))
                    now = now.slice(min(room, now.num_rows))
                    if sum(h.num_rows for h in held) == block:
                        yield made(_joined(held))
                        held = []
        if held:
            yield made(_joined(held))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def build_index(rows: DataFrame, *, block: int = BLOCK, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """Blocks of prepared rows, stored (ids, labels, vectors, each coordinate's rows sorted by value), and the dimensions."""
    if not 0 < block <= 1 << 16:
        raise ValueError("block must be between 1 and 65536")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.select(F.max(F.size("vector")).alias("dims"), F.max(square).alias("longest")).first()
    if (size["longest"] or 0) >= LARGEST:
        raise ValueError("vectors are too long: their products could pass 2**48")
    bucket = F.when(square > 0, F.floor(F.log(square) / (-2 * float(np.log(BUCKET))))).otherwise(-1).cast("int")
    ranged = rows.withColumns({"bucket": bucket, "sample": F.pmod(F.xxhash64("id"), F.lit(sample)) == 0, "part": F.spark_partition_id()})
    ranged = (ranged.repartitionByRange("sample", "bucket", "id", "part").sortWithinPartitions("sample", "bucket", "id")
              .select("id", "label", "vector", "bucket", "sample"))
    dims = max(size["dims"] or 0, 1)
    return stored(ranged.mapInArrow(_pack(dims, block), INDEX), "inner-product-index"), dims


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for sample, n, dims, ids, labels, vectors, lists in zip(*(c.to_pylist() for c in batch.columns)):
            kind = np.int32 if len(vectors) == 4 * n * dims else np.int64
            yield (np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(n, dims),
                   np.frombuffer(lists, np.uint16).reshape(dims, n))


def _exact_type(largest: float):
    """A float type that holds every partial sum of products up to ``largest`` (below 2**48) as a whole number."""
    return np.float32 if largest < 1 << 24 else np.float64


def _candidates(unit, length, focus, bound, lists, unit_block, lengths):
    """(anchors to multiply out, anchor and row of the other candidates): none that can reach its bound is missing.

    ``bound`` is a score that a row must reach; NONE where there is none.
    """
    n = len(lengths)
    longest = float(lengths.max(initial=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        theta = np.where(bound > 0, bound / (length * longest), 0.0)
    alive = np.flatnonzero((bound <= 0) | ((length > 0) & (longest > 0) & (theta <= 1 + SLACK)))
    free = alive[bound[alive] <= 0]                          # a bound of 0 or less leaves every coordinate free
    tight = alive[bound[alive] > 0]
    t = np.minimum(theta[tight], 1.0)
    slots = focus.shape[1]
    lo, hi = np.zeros((len(tight), slots), np.int64), np.full((len(tight), slots), n, np.int64)
    for slot in range(slots):
        f = focus[tight, slot]
        q = unit[tight, f]
        side = np.sqrt(np.maximum((1 - q * q) * (1 - t * t), 0))
        low = np.where(q <= -t, -1.0, q * t - side) - SLACK
        high = np.where(q >= t, 1.0, q * t + side) + SLACK
        order = np.argsort(f, kind="stable")
        cuts = np.flatnonzero(np.r_[True, f[order][1:] != f[order][:-1]][:len(order)])
        for start, stop in zip(cuts, [*cuts[1:], len(order)]):
            who = order[start:stop]
            values = unit_block[lists[f[who[0]]], f[who[0]]]
            lo[who, slot] = np.searchsorted(values, low[who], "left")
            hi[who, slot] = np.searchsorted(values, high[who], "right")
    width = np.maximum(hi - lo, 0)
    best = width.argmin(1) if len(tight) else np.zeros(0, np.int64)
    narrowest = width[np.arange(len(tight)), best]
    dense = np.r_[free, tight[narrowest > DENSE * n]]
    some = np.flatnonzero((narrowest > 0) & (narrowest <= DENSE * n))
    if not len(some):
        return dense, np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.repeat(some, narrowest[some])
    place = np.arange(len(which)) - np.repeat(np.cumsum(narrowest[some]) - narrowest[some], narrowest[some])
    row = lists[focus[tight[which], best[which]], lo[which, best[which]] + place].astype(np.int64)
    ranks = np.empty_like(lists)
    np.put_along_axis(ranks, lists.astype(np.int64), np.arange(n, dtype=np.uint16)[None, :].repeat(len(lists), 0), 1)
    for slot in range(slots):
        rank = ranks[focus[tight[which], slot], row].astype(np.int64)
        inside = (rank >= lo[which, slot]) & (rank < hi[which, slot])
        which, row = which[inside], row[inside]
    return dense, tight[which], row


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by score descending and id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _finder(anchors: dict, wanted: str, k: int):
    """Tasks' best rows: (slot, id, score) for each slot, an anchor (positives) or an anchor's positive (negatives).

    ``anchors`` holds ids, labels, vectors (of the index's dimensions), and by slot: its anchor, the score that a row
    must reach, the score that it must not pass (NONE: no limit), the positive's id and score.
    """
    def run(batches):
        ids, labels, vectors = anchors["ids"], anchors["labels"], anchors["vectors"]
        owner, least, most = anchors["owner"], anchors["least"].copy(), anchors["most"]
        if not len(owner):
            return
        dims = vectors.shape[1]
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        starts = np.searchsorted(owner, np.arange(len(ids)))              # slots of an anchor are neighbours
        sizes = np.bincount(owner, minlength=len(ids))
        held, rows = [], 0

        def compact():
            nonlocal held, rows
            slot, found, score = (np.concatenate(x) for x in zip(*held))
            at = _first(slot, score, found, k)
            slot, found, score = slot[at], found[at], score[at]
            held, rows = [(slot, found, score)], len(slot)
            last = np.flatnonzero(np.r_[slot[1:] != slot[:-1], True][:len(slot)])
            full = last[np.diff(np.r_[-1, last]) == k]
            least[slot[full]] = np.maximum(least[slot[full]], score[full])

        def take(anchor, row, score, block_ids, block_labels):
            nonlocal rows
            if wanted == "positive":
                right = (block_labels[row] == labels[anchor]) & (block_ids[row] != ids[anchor])
            else:
                right = block_labels[row] != labels[anchor]
            anchor, row, score = anchor[right], row[right], score[right]
            times = sizes[anchor]
            entry = np.repeat(np.arange(len(anchor)), times)
            slot = starts[anchor][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
            right = (score[entry] >= least[slot]) & ((most[slot] == NONE) | (score[entry] <= most[slot]))
            if right.any():
                held.append((slot[right], block_ids[row[entry[right]]], score[entry[right]]))
                rows += int(right.sum())
                if rows > FOUND:
                    compact()

        for block_ids, block_labels, block, lists in _blocks(batches):
            lengths = np.sqrt((block.astype(np.float64) ** 2).sum(1))
            unit_block = block / np.where(lengths > 0, lengths, 1)[:, None]
            bound = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(bound, owner, least)
            dense, anchor, row = _candidates(unit, length, focus, bound.astype(np.float64), lists, unit_block, lengths)
            step = SCORES // dims + 1
            for at in range(0, len(anchor), step):
                a, r = anchor[at:at + step], row[at:at + step]
                take(a, r, np.einsum("ij,ij->i", vectors[a], block[r].astype(np.int64)), block_ids, block_labels)
            kind = _exact_type(float(length.max(initial=0)) * float(lengths.max(initial=0)))
            block, step = block.astype(kind).T, max(1, SCORES // len(block_ids))
            for at in range(0, len(dense), step):
                who = dense[at:at + step]
                scores = vectors[who].astype(kind) @ block
                a, r = np.nonzero(scores >= bound[who].astype(kind)[:, None])
                take(who[a], r, scores[a, r].astype(np.int64), block_ids, block_labels)
        if held:
            compact()
            slot, found, score = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, ids[owner[slot]], anchors["named"][slot], anchors["scored"][slot],
                                                                    found, score)],
                                             names=["slot", "anchor_id", "positive_id", "positive_score", "id", "score"])

    return run


def _found(blocks: DataFrame, anchors: dict, wanted: str, k: int) -> DataFrame:
    """(slot, anchor_id, positive_id, positive_score, id, score, rank): the first k rows of each slot."""
    names = ["slot", "anchor_id", "positive_id", "positive_score", "id", "score"]
    place = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return (blocks.mapInArrow(_finder(anchors, wanted, k), ", ".join(f"{n} bigint" for n in names))
            .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))


def _collected(found: DataFrame) -> tuple[np.ndarray, ...]:
    """(slot, id, score) by slot and rank: at most k rows for each slot of a block of anchors."""
    rows = found.select("slot", "id", "score", "rank").toArrow()
    slot, ids, score, rank = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
    order = np.lexsort((rank, slot))
    return slot[order], ids[order], score[order]


def _search(index: DataFrame, anchors: dict, wanted: str, k: int) -> DataFrame:
    """First k rows of each slot, over all rows; the sampled part gives the bounds."""
    slot, _, score = _collected(_found(index.filter("sample"), anchors, wanted, k))
    least = anchors["least"].copy()
    last = np.flatnonzero(np.r_[slot[1:] != slot[:-1], True][:len(slot)])
    full = last[np.diff(np.r_[-1, last]) == k]                            # k rows are known: the k-th bounds the search
    least[slot[full]] = np.maximum(least[slot[full]], score[full])
    return _found(index, anchors | {"least": least}, wanted, k)


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, block: int = BLOCK, anchors_at_once: int = ANCHORS, sample: int = SAMPLE, id_col: str = "vec_id",
         label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the prepared columns (id, label, vector).  An anchor's positives are its first
    ``positives`` other rows of its label; each gets the first ``negatives`` rows of other labels whose score is
    between ``low`` and ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    ready = stored(prepare(rows, scale=scale, id_col=id_col, label_col=label_col, vector_col=vector_col), "vectors")
    index, dims = build_index(ready, block=block, sample=sample)
    asked = ready.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("first"))
    asked = stored(asked.select("id", "first.label", "first.vector"), "anchors")
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    parts, last = [], None
    while True:
        batch = (asked if last is None else asked.filter(F.col("id") > last)).orderBy("id").limit(anchors_at_once).toArrow().combine_chunks()
        n = batch.num_rows
        if n == 0:
            break
        last = batch.column(0)[n - 1].as_py()
        given = {"ids": batch.column(0).to_numpy().astype(np.int64), "labels": batch.column(1).to_numpy().astype(np.int64),
                 "vectors": _matrix(batch.column(2).combine_chunks(), dims)}
        free, zeros = np.full(n, NONE), np.zeros(n, np.int64)
        own = {"owner": np.arange(n), "least": free, "most": free, "named": zeros, "scored": zeros}
        slot, ids, score = _collected(_search(index, given | own, "positive", positives))
        ranges = {"owner": slot, "least": -((-score * low) // 100), "most": (score * high) // 100, "named": ids, "scored": score}
        parts.append(stored(_search(index, given | ranges, "negative", negatives).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "hard-negatives"))
        if n < anchors_at_once:
            break
    out = parts[0] if parts else spark.createDataFrame([], result)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

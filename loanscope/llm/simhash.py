"""SimHash near-duplicate components by pigeonhole blocks.

Fingerprint: words of the text (A-Z lower-cased, cut at ASCII white space)
form overlapping shingles, repeats included; a bit is 1 if it is set in over
half of the shingles' XXH64 hashes.  Two fingerprints link when at most
``distance`` bits differ.

Distinct fingerprints are split into ``blocks`` runs of bits.  Two that differ
in at most ``distance`` bits leave at least ``blocks - distance`` blocks
untouched, so they share the key of some choice of that many blocks.  A bucket
of fingerprints with one key is linked inside a task by verified Hamming
distances and leaves as a spanning forest, not as all pairs.  A bucket of more
than ``bucket`` members is not gathered: each member emits itself with up to
half of ``distance`` free bits flipped; two members link exactly if they meet
in such a variant, and all that meet in one link to its smallest.  Buckets that
a sample shows to hold a large part of all rows never travel to one task.

Defined cases: a text with fewer words than a shingle is one shingle; null and
empty texts have fingerprint zero and link like any other; equal rows have
equal fingerprints; a null id never names a component unless all its ids are
null; an empty table gives an empty result.  Extra columns are left out by
selecting the named ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm.graph import components
from loanscope.llm.shared import chunks, hash_share, stored

SEED = 42
# Members of a bucket that one task links directly; larger ones go by variants.
BUCKET = 32768
# Buckets with a large part of all fingerprints are known beforehand from a sample of about this many (at least SEEN
# members in it).
SAMPLE = 65536
SEEN = 32
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.array(hashes[i:i + SHINGLES_AT_ONCE], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed number."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bits = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(bits.view(np.int64))], ["id", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` of ``blocks`` runs of the 64 bits, as signed numbers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(choice) for choice in combinations(runs, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(mask: int, most: int) -> list[int]:
    free = [1 << i for i in range(64) if not mask >> i & 1]
    flips = [sum(c) for k in range(most + 1) for c in combinations(free, k)]
    return [f - (1 << 64) if f >> 63 else f for f in flips]


def _forest(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Tree edges of the components of one bucket."""
    a, b, queue, rest = [], [], [], members
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        one = queue.pop()
        near = _apart(rest, one) <= distance
        a += [int(one)] * int(near.sum())
        b += rest[near].tolist()
        queue += list(rest[near])
        rest = rest[~near]
    return a, b


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; numpy counts the bits of a signed number's magnitude, so as unsigned ones."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(c, k, fp): each fingerprint once for every choice ``c`` of blocks, ``k`` its bits in those blocks."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("c"))
    return each.withColumn("k", F.col("fp").bitwiseAND(F.get(F.array(*map(F.lit, masks)), F.col("c"))))


class _Buckets:
    """Cuts sorted rows into buckets, across batches, and links each; an oversized one is only named."""

    def __init__(self, distance: int, most: int):
        self.distance, self.most = distance, most
        self.key, self.held, self.size = None, [], 0
        self.a, self.b, self.c = [], [], []

    def _link(self, key: tuple[int, int], members: np.ndarray | None) -> None:
        if members is None:
            self.a.append(key[1])
            self.b.append(None)
            self.c.append(key[0])
        elif len(members) > 1:
            a, b = _forest(members, self.distance)
            self.a += a
            self.b += b
            self.c += [None] * len(a)

    def _close(self) -> None:
        if self.key is not None:
            self._link(self.key, None if self.size > self.most else np.concatenate(self.held))
        self.key, self.held, self.size = None, [], 0

    def _hold(self, key: tuple[int, int], part: np.ndarray) -> None:
        if key != self.key:
            self._close()
            self.key = key
        self.size += len(part)
        self.held = [] if self.size > self.most else [*self.held, part]

    def add(self, c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> None:
        """Rows that follow those added before in the order of (c, k)."""
        turn = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
        starts, ends = np.append(0, turn), np.append(turn, len(fp))
        self._hold((int(c[0]), int(k[0])), fp[:ends[0]])
        if len(starts) == 1:
            return
        inner = slice(1, -1)
        size = ends[inner] - starts[inner]
        two = starts[inner][size == 2]
        two = two[_apart(fp[two], fp[two + 1]) <= self.distance]
        self.a += fp[two].tolist()
        self.b += fp[two + 1].tolist()
        self.c += [None] * len(two)
        for i in np.flatnonzero(size > 2).tolist():
            at = int(starts[inner][i])
            members = fp[at:at + int(size[i])]
            self._link((int(c[at]), int(k[at])), members if len(members) <= self.most else None)
        self._hold((int(c[-1]), int(k[-1])), fp[starts[-1]:])

    def take(self, all_: bool = False) -> pa.RecordBatch:
        if all_:
            self._close()
        out = pa.record_batch([pa.array(self.a, pa.int64()), pa.array(self.b, pa.int64()), pa.array(self.c, pa.int32())], ["a", "b", "c"])
        self.a, self.b, self.c = [], [], []
        return out


def links(fps: DataFrame, *, distance: int, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``: enough verified links to connect what all links connect."""
    blocks = blocks or distance + 2
    if distance % 2 or blocks <= distance:
        raise ValueError("distance must be even and smaller than blocks")
    masks = block_masks(blocks, blocks - distance)
    keyed = _keyed(fps, masks)
    n = fps.count()
    some = hash_share(fps, "fp", SAMPLE)
    hot = (_keyed(some, masks).groupBy("c", "k").agg(F.count("*").alias("seen"))
           .filter((F.col("seen") >= SEEN) & (F.col("seen") * (n / SAMPLE if n > SAMPLE else 1.0) > bucket)).select("c", "k"))
    # Any bucket not listed is found to be oversized where it is cut, so the list may have a bound.
    hot = stored(hot.limit(2 * len(masks) * SAMPLE // SEEN), "hot-buckets")
    rest = keyed.join(F.broadcast(hot), ["c", "k"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(distance, bucket)
        for batch in batches:
            if batch.num_rows:
                found.add(*(batch.column(i).to_numpy() for i in range(3)))
                yield found.take()
        yield found.take(all_=True)

    ordered = rest.select("c", "k", "fp").repartition("c", "k").sortWithinPartitions("c", "k")
    found = stored(ordered.mapInArrow(run, "a long, b long, c int"), "links")
    large = found.filter("c is not null").select("c", F.col("a").alias("k")).unionByName(hot)
    pairs = found.filter("c is null").select("a", "b")
    if not large.isEmpty():
        pairs = pairs.unionByName(_variant_links(keyed.join(large, ["c", "k"]), masks, distance // 2))
    return pairs.distinct()


def _variant_links(members: DataFrame, masks: list[int], most: int) -> DataFrame:
    """Links inside buckets too large to gather: members that share a variant link to its smallest member."""
    spark = members.sparkSession
    flips = spark.createDataFrame([(c, _flips(m, most)) for c, m in enumerate(masks)], "c int, flips array<long>")
    variants = (members.select("c", "fp").join(F.broadcast(flips), "c")       # one row for each choice of blocks
                .select("c", "fp", F.explode("flips").alias("flip"))
                .select("c", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")))
    least = variants.groupBy("c", "variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return (variants.join(least.select("c", "variant", "a"), ["c", "variant"])
            .filter("a <> fp").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, *, shingle: int, distance: int, blocks: int | None = None, bucket: int = BUCKET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): the smallest id that each document reaches over links, itself included."""
    prints = stored(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    roots = components(links(reps.select("fp"), distance=distance, blocks=blocks, bucket=bucket), "a", "b")
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, *, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest id's, without an id last.

    Rows are told apart by id and text; of rows equal in both one stays.
    """
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
            .withColumn("key", F.struct(F.col("row").getField(id_col).isNull().alias("no_id"), F.col("row").getField(id_col).alias("id"),
                                        F.xxhash64(text).alias("version"))))
    groups = near_duplicates(rows.select("key", text.alias("text")), shingle=shingle, distance=distance, id_col="key", text_col="text")
    chosen = groups.filter("id = component").select(F.col("id").alias("chosen")).distinct()
    kept = rows.join(chosen, F.col("key") == F.col("chosen"), "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return kept.withColumn("first", first).filter("first = 1").select(*columns)


def hex_fingerprint(col):
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))

"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that occurs more than once.

Strings never cross documents and are judged on the input.  To spread the work,
every string picks an anchor, the smallest-hashed run of ``gram`` bytes in it
(the first, if runs tie): equal strings pick equal anchors.  The starts of a
document whose strings share one anchor occurrence are consecutive; with the
bytes their strings cover they form a segment.  So strings can only be equal
if their segments share an anchor, and

- a segment that occurs again as it stands, by a 128-bit digest of its bytes,
  repeats all its starts;
- the distinct segments of an anchor that has several are gathered by anchor
  hash into shards of about ``SHARD_BYTES``, and each shard is sorted by induced
  sorting; a start whose suffix shares ``length`` bytes with a neighbouring
  segment start is repeated;
- an anchor with more than ``most`` distinct segments (a passage in very many
  surroundings) is not gathered: its strings are grouped by their place before
  the anchor and their 128-bit digests.

The rolling hash only picks anchors, where a collision costs time; what is
equal is told by bytes or by SHA-256, cut to 128 bits, since texts of simple
make (Thue-Morse sequences) collide under a rolling hash modulo 2**64.

Copies are combined before the shuffle, only distinct segments that can match
travel with bytes, and documents meet their own removed spans at the end.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing;
rows that repeat an id are documents of their own (rows equal in id and text
repeat each other); null ids are kept; an empty table gives an empty result.
Removed spans may cut a UTF-8 character, so what is kept is binary.  Extra
columns are left out by selecting the named ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.llm import suffix_array
from loanscope.llm.shared import chunks, stored
from loanscope.llm.tokens import mix, powers

GRAM = 100
SHARD_BYTES = 1 << 20
# Distinct segments of one anchor that one shard takes.
MOST = 1500
# Starts handled at once when a text is scanned.
PIECE = 1 << 20
# Odd multiplier and byte values of the rolling hash.
_BASE = 0x5851F42D4C957F2D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# A segment's digest; its anchor, own starts and offset follow from its bytes.
_KEY = ["h1", "h2"]
_SEGMENT = ["id", "version", "start", "anchor", "own", "offset"]


class Rolling:
    """Hashes of byte strings from prefix sums of one power series."""

    def __init__(self, base: int, n: int):
        self.up, self.down = powers(base, n), powers(pow(base, -1, 1 << 64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128 bits of the SHA-256 of each byte string, as two longs."""
    view = memoryview(data)
    whole = b"".join([hashlib.sha256(view[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    found = np.frombuffer(whole, np.int64).reshape(-1, 4)
    return pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())


def sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive keys (prefix and suffix minima of blocks of that width)."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(data: np.ndarray, limits: np.ndarray, length: int, gram: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, two longs of the digest, first start, own starts, anchor's offset) of the texts joined in ``data``, piece by piece.

    ``limits`` are the texts' bounds.
    """
    for low in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[low:low + PIECE + length - 1]
        sums = rolling.sums(part)
        starts = np.arange(len(part) - gram + 1)
        grams = rolling.hashes(sums, starts, starts + gram)
        key = (grams >> np.uint64(32) << np.uint64(32)) | starts.astype(np.uint64)
        at = (sliding_argmin(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.searchsorted(limits, low + starts[:len(at)], side="right")
        valid = np.flatnonzero(low + starts[:len(at)] + length <= limits[np.minimum(text, len(limits) - 1)])
        if not len(valid):
            continue
        turn = np.flatnonzero(np.append(True, (np.diff(at[valid]) != 0) | (np.diff(valid) != 1)))
        first, last = valid[turn], valid[np.append(turn[1:], len(valid)) - 1]
        anchor = at[first]
        yield grams[anchor], *digests(part, first, last + length), low + first, last - first + 1, anchor - first


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, version, start, anchor, h1, h2, own, offset) of every segment of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(_BASE, PIECE + length)
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            data = np.frombuffer(b"".join(texts), np.uint8)
            limits = np.cumsum([0, *map(len, texts)])
            for anchor, h1, h2, first, own, offset in segments(data, limits, length, gram, rolling):
                row = np.searchsorted(limits, first, side="right") - 1
                take = pa.array(row)
                yield pa.record_batch([batch.column("id").take(take), batch.column("version").take(take),
                                       pa.array((first - limits[row]).astype(np.int64)), pa.array(anchor.view(np.int64)),
                                       h1, h2, pa.array(own.astype(np.int32)), pa.array(offset.astype(np.int32))],
                                      ["id", "version", "start", "anchor", "h1", "h2", "own", "offset"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, version long, start long, anchor long, h1 long, h2 long, own int, offset int")


def repeated_starts(pieces: list[bytes], own: np.ndarray, length: int) -> np.ndarray:
    """Flags of the own starts of each piece, one after the other, whose string is that of another own start."""
    sizes = np.array([len(p) + 1 for p in pieces])
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 2
    text[first + sizes - 1] = 1                             # ends each piece; no string of own starts reaches it
    text = np.append(text, 0).astype(np.uint16)
    sa = suffix_array.suffix_array(text, 258)
    prefix = suffix_array.common_prefixes(text, sa)
    mine = np.zeros(len(text), bool)
    places = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
    mine[places] = True
    rows = np.flatnonzero(mine[sa])
    shared = np.minimum.reduceat(np.append(prefix, 0), np.append(rows + 1, len(prefix))[:len(rows)]) if len(rows) else np.zeros(0)
    # shared[i] is the smallest prefix length after row i up to the next own row, so that row's common prefix with it
    like_next = np.append(shared[:-1] >= length, False) if len(rows) else np.zeros(0, bool)
    flags = np.zeros(len(text), bool)
    flags[sa[rows]] = like_next | np.append(False, like_next[:-1])
    return flags[places]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy().astype(np.int64)
        flags = repeated_starts([b.as_py() for b in table["bytes"]], own, length)
        rows, low, high = [], [], []
        at = np.cumsum(own) - own
        for i in np.flatnonzero(table["n"].to_numpy() == 1).tolist():
            for a, b in _runs(flags[at[i]:at[i] + own[i]]):
                rows.append(i)
                low.append(a)
                high.append(b)
        start = table["start"].take(pa.array(rows, pa.int64())).to_numpy()
        return pa.table({"id": table["id"].take(pa.array(rows, pa.int64())), "version": table["version"].take(pa.array(rows, pa.int64())),
                         "low": pa.array(start + np.array(low, np.int64)), "high": pa.array(start + np.array(high, np.int64))})
    return run


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted segments with the bytes that their strings cover."""
    lists = wanted.groupBy("id", "version").agg(F.collect_list(F.struct("start", "anchor", "own", "offset", "n", "crowded")).alias("parts"))
    same = docs["id"].eqNullSafe(lists["id"]) & (docs["version"] == lists["version"])
    joined = docs.join(lists, same).select(docs["id"], docs["version"], "text", "parts")
    sliced = joined.withColumn("data", F.col("text").cast("binary")).select("id", "version", "data", F.explode("parts").alias("part"))
    return sliced.select("id", "version", "part.*", F.expr(f"substring(data, cast(part.start + 1 as int), part.own + {length - 1})").alias("bytes"))


def _crowded(parts: DataFrame, length: int) -> DataFrame:
    """(id, version, low, high) of repeated starts of anchors with too many segments for a shard."""
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "bytes", 1 << 16):
            texts = batch.column("bytes").to_pylist()
            own = batch.column("own").to_numpy().astype(np.int64)
            limits = np.cumsum([0, *map(len, texts)])
            data = np.frombuffer(b"".join(texts), np.uint8)
            within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            at = np.repeat(limits[:-1], own) + within
            row = pa.array(np.repeat(np.arange(len(texts)), own))
            place = np.repeat(batch.column("offset").to_numpy().astype(np.int64), own) - within
            yield pa.record_batch([batch.column(c).take(row) for c in ("id", "version", "anchor", "n")]
                                  + [pa.array(place), *digests(data, at, at + length), pa.array(np.repeat(batch.column("start").to_numpy(), own) + within)],
                                  ["id", "version", "anchor", "n", "place", "h1", "h2", "start"])

    strings = parts.select("id", "version", "anchor", "n", "own", "offset", "start", "bytes").mapInArrow(
        run, f"id {kind}, version long, anchor long, n long, place long, h1 long, h2 long, start long")
    key = ["anchor", "place", "h1", "h2"]
    # A table of its own, so that the join's sides are plain exchanges and a string that very many rows hold can be split.
    again = stored(strings.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").select(*key), "repeated-strings")
    return strings.filter("n = 1").join(again, key, "left_semi").select("id", "version", F.col("start").alias("low"), (F.col("start") + 1).alias("high"))


def repeated_ranges(docs: DataFrame, *, length: int, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(id, version, low, high): ranges of starts, high excluded, whose strings of ``length`` bytes occur more than once.

    ``docs`` has (id, version, text); a row of the result may occur more than once.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be 1..length")
    found = stored(occurrences(docs, length, gram), "segments")
    distinct = (found.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct(*_SEGMENT)).alias("one"))
                .select(*_KEY, "n", "one.*"))
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    # A table of its own, so that the join's sides are plain exchanges and a segment that very many rows hold can be split.
    copied = stored(distinct.filter("n > 1").select(*_KEY), "repeated-segments")
    whole = (found.join(copied, _KEY, "left_semi")
             .select("id", "version", F.col("start").alias("low"), (F.col("start") + F.col("own")).alias("high")))
    wanted = (distinct.join(anchors, "anchor").withColumn("crowded", F.col("kinds") > most)
              .select(*_SEGMENT, "n", "crowded"))
    parts = stored(_with_bytes(docs, wanted, length), "segment-bytes")
    size = parts.filter(~F.col("crowded")).agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    kind = docs.schema["id"].dataType.simpleString()
    sorted_ = (parts.filter(~F.col("crowded")).withColumn("shard", F.pmod("anchor", F.lit(shards)))
               .select("shard", "id", "version", "start", "own", "n", "bytes").groupBy("shard")
               .applyInArrow(_sort_shard(length), f"id {kind}, version long, low long, high long"))
    return whole.unionByName(sorted_).unionByName(_crowded(parts.filter("crowded"), length))


@F.pandas_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()),
                            T.StructField("n_spans", T.LongType())]))
def _cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
    """Text bytes without the ranges."""
    out = []
    for text, low, high in zip(texts, lows, highs):
        if text is None:
            out.append((None, 0, 0))
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        depth = np.zeros(len(data) + 1, np.int64)
        np.add.at(depth, low, 1)
        np.add.at(depth, high, -1)
        gone = np.cumsum(depth[:-1]) > 0
        spans = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        out.append((data[~gone].tobytes(), int(gone.sum()), spans))
    return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])


def versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): a 64-bit hash of the text and its length tells rows with equal ids apart."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.octet_length(text), text).alias("version"), text.alias("text"))


def remove_repeats(docs: DataFrame, *, length: int, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every document."""
    source = versioned(docs, id_col, text_col)
    ranges = (repeated_ranges(source, length=length, gram=gram, most=most).groupBy("id", "version")
              .agg(F.collect_set(F.struct("low", (F.col("high") + (length - 1)).alias("high"))).alias("spans")))
    same = source["id"].eqNullSafe(ranges["id"]) & (source["version"] == ranges["version"])
    found = source.join(ranges, same, "left").select(source["id"], "text", "spans")
    cut = _cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans.low"), F.col("spans.high"))
    return (found.withColumn("cut", cut)
            .select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("cut.n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("cut.n_spans", F.lit(0)).alias("n_spans"),
                    F.coalesce("cut.kept", F.col("text").cast("binary")).alias("kept")))

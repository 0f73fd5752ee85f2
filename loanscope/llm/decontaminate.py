"""Benchmark decontamination: SimHash windows found by multi-index Hamming blocks.

Words are runs of letters and digits, A-Z lower-cased; five of them make a
shingle (an item of fewer words is one shingle).  An item has the SimHash of
windows of its own size (first, middle and last place of the largest window size
that fits it) and of smaller windows that tile it side by side: so many that legal
edits, which keep ``similarity``, leave a tile untouched (``tile_size``).  Every
document is passed over with windows of the same sizes, one starting at each word.
The 64 bits are four blocks of 16; two fingerprints within ``radius`` bits agree
in some block up to ``radius // 4`` bits, so a table per block that holds every
16-bit value within that distance of an item's block finds all of them.  Tests
measure what these windows find by themselves, at every item length.

``complete`` (on by default) adds the completion, a look-up of single shingles that
proves that nothing is missed: a place that reaches ``similarity`` has at least
that share of the item's shingles, so of one shingle more than may be missing one
is there, whatever the edits (``telling``; those that fewest items share are taken).
Every place whose window holds a hit is compared with
the item exactly, shingles weighted by how often they occur.

The benchmark is the query set; it meets the documents in blocks of at most
``BLOCK_BYTES`` of its text, each broadcast.  Documents never meet each other.

Defined cases: null or empty texts and items have no words and match nothing;
items that repeat are each reported; a document's best place for an item is
reported once, of equal ones the first; null ids are kept as they are; repeated
rows are reported each; with no items or no documents the result is empty.
Extra columns are left out by selecting the named ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.llm import tokens
from loanscope.llm.shared import chunks

SHINGLE = 5
RADIUS = 7
SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20
# Window starts handled at once: 64 counters each, for all window sizes.
AT_ONCE = 1 << 13
BLOCKS = 4
# Sizes of the windows that tile an item.
TILES = (16, 12, 8, 6, 4, 3, 2)
_BLOCK_BITS = np.array([1, 2, 4, 8], np.uint8)


def window_size(shingles: int) -> int:
    """Largest size not above ``shingles`` of the sizes 1, 2, 3, 4, 6, 8, 12, 16, 24, ..."""
    power = 1 << (shingles.bit_length() - 1)
    return power + power // 2 if power > 1 and shingles >= power + power // 2 else power


def tile_size(shingles: int, similarity: float) -> int:
    """Largest of a few sizes whose tiles an item of so many shingles has more of than edits that keep ``similarity`` touch.

    An edited copy of the item's length misses at most (1 - s) / (1 + s) of its shingles.  A changed, put in or left out
    word takes four shingles in a row or more, which touch two tiles; at either end of the item it may take fewer.
    A copy that is cut off misses at most 1 - s of them, in a row at one end.
    """
    missing = int(shingles * (1 - similarity) / (1 + similarity) + 1e-9)
    cut_off = int(shingles * (1 - similarity) + 1e-9)
    for size in TILES:
        touched = max(min(missing, 2 * (missing // 4) + 2), -(-cut_off // size))
        if shingles // size > touched:
            return size
    return 1


def item_windows(shingles: int, similarity: float) -> dict[int, list[int]]:
    """Window sizes of an item of so many shingles, and the windows' offsets in it."""
    whole, tile = window_size(shingles), tile_size(shingles, similarity)
    found = {tile: {*range(0, shingles - tile + 1, tile), shingles - tile}}
    found.setdefault(whole, set()).update({0, (shingles - whole) // 2, shingles - whole})
    return {size: sorted(offsets) for size, offsets in found.items()}


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set before each place; counts wrap, their differences do not."""
    sums = np.zeros((len(hashes) + 1, 64), np.uint16)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint16, out=sums[1:])
    return sums


def simhashes(sums: np.ndarray, size: int, most: int) -> np.ndarray:
    """SimHash of the first ``most`` runs of ``size`` shingle hashes (a bit is set if over half have it)."""
    n = max(0, min(most, len(sums) - size))
    return np.packbits(sums[size:size + n] - sums[:n] > size // 2, axis=1).view(np.uint64).ravel()


class Queries:
    """Fingerprints of item windows of one size, with a table per block of 16 bits."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, offsets: np.ndarray, radius: int):
        self.prints, self.items, self.offsets, self.radius = prints, items, offsets, radius
        flips = [f for f in range(1 << 16) if f.bit_count() <= radius // BLOCKS]
        self.tables = []
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        for b in range(min(BLOCKS, radius + 1)):            # radius + 1 blocks: one of them is equal
            values = (parts[:, b][:, None] ^ np.array(flips, np.uint16)).ravel()
            owner = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << 16)
            self.tables.append((counts, np.cumsum(counts) - counts, owner[order]))
        self.marks = np.zeros(1 << 16, np.uint8)            # bit b: block b of some item has a value near this one
        for b, (counts, _, _) in enumerate(self.tables):
            self.marks[counts > 0] |= 1 << b

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, query) of all pairs within the radius; a pair may occur more than once."""
        values = prints.view(np.uint16)
        marks = self.marks.take(values).reshape(-1, BLOCKS) & _BLOCK_BITS
        some = np.flatnonzero(marks.view(np.uint32))
        parts, marks = values.reshape(-1, BLOCKS)[some], marks[some]
        places, queries = [], []
        for b, (counts, starts, owners) in enumerate(self.tables):
            hit = np.flatnonzero(marks[:, b])
            value = parts[hit, b]
            n = counts[value]
            place = np.repeat(some[hit], n)
            query = owners[np.repeat(starts[value] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[place] ^ self.prints[query]) <= self.radius
            places.append(place[near])
            queries.append(query[near])
        return np.concatenate(places), np.concatenate(queries)


def telling(hashes: np.ndarray, shared: Counter, similarity: float) -> list[int]:
    """Offsets of shingles of an item of which every place that reaches ``similarity`` has one; rare ones first."""
    spare = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9)
    order = sorted(range(len(hashes)), key=lambda i: (shared[int(hashes[i])], int(hashes[i])))
    return order[:spare + 1]


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[str], *, shingle: int, radius: int, similarity: float, complete: bool = True):
        self.words, self.shingle, self.similarity = tokens.Words(), shingle, similarity
        self.items = [self._split(t) for t in items]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        sizes_of = [max(1, min(shingle, len(words))) for words in self.items]
        self.hashes = [tokens.shingles(self._hashes(b" ".join(words))[0], k) for words, k in zip(self.items, sizes_of)]
        self.counts = [Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) for words, k in zip(self.items, sizes_of)]
        shared = Counter(h for hashes in self.hashes for h in set(hashes.tolist()))
        for i, (k, hashes) in enumerate(zip(sizes_of, self.hashes)):
            if not len(hashes):
                continue
            for size, offsets in item_windows(len(hashes), similarity).items():
                prints = simhashes(bit_sums(hashes), size, len(hashes))
                for offset in offsets:
                    found.setdefault((k, size), []).append((int(prints[offset]), i, offset))
            if complete:
                for offset in telling(hashes, shared, similarity):
                    found.setdefault((k, 1), []).append((int(hashes[offset]), i, offset))
        self.queries = {key: Queries(*(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64))),
                                     radius if key[1] > 1 else 0)
                        for key, rows in found.items()}

    def _split(self, text: str) -> list[bytes]:
        data = text.encode().lower()
        flat = np.frombuffer(data, np.uint8)
        return [data[s:e] for s, e in zip(*(x.tolist() for x in self.words.bounds(flat)))]

    def _hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer(data, np.uint8)
        starts, ends = self.words.bounds(flat)
        return self.words.hashes(flat, starts, ends), starts, ends

    def _best(self, item: int, at: int, to: int, shingles: dict[int, tuple[bytes, ...]], lo: int, hi: int) -> tuple[float, int]:
        """(similarity, place) of the first best of the places ``at`` to ``to`` - 1 in a text.

        A place's window is as many shingles from it as the item has, of those from ``lo`` to ``hi`` - 1 in the text;
        ``shingles`` has at least those of the windows that are in the item.
        """
        wanted, n, have = self.counts[item], len(self.hashes[item]), Counter()
        common, best = 0, (0.0, at)
        for i in range(at, to + n - 1):
            new = shingles.get(i)
            if new in wanted:
                have[new] += 1
                common += have[new] <= wanted[new]
            place = i - n + 1
            if place < at:
                continue
            size = min(hi, i + 1) - max(lo, place)
            if size > 0 and (similarity := common / (n + size - common)) > best[0]:
                best = similarity, place
            old = shingles.get(place)
            if old in wanted:
                common -= have[old] <= wanted[old]
                have[old] -= 1
        return best

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best place of each item found in a text."""
        data = [t.encode().lower() for t in texts]
        joined = b" ".join(data)
        hashes, starts, ends = self._hashes(joined)
        limits = np.cumsum([0, *(len(d) + 1 for d in data)])
        owner = np.searchsorted(limits, starts, side="right") - 1        # text of each word
        first = np.searchsorted(starts, limits)                          # first word of each text
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for k in {k for k, _ in self.queries}:
            rolled = tokens.shingles(hashes, k)
            sizes = sorted(size for of, size in self.queries if of == k)
            seen = []
            for at in range(0, len(rolled), AT_ONCE):
                sums = bit_sums(rolled[at:at + AT_ONCE + sizes[-1] - 1]) if sizes[-1] > 1 else None
                for size in sizes:
                    queries = self.queries[k, size]
                    place, query = queries.find(simhashes(sums, size, AT_ONCE) if size > 1 else rolled[at:at + AT_ONCE])
                    place += at
                    same = owner[place] == owner[place + size + k - 2]       # not across two texts
                    seen.append(np.stack([owner[place[same]], queries.items[query[same]], place[same]], axis=1))
            if not seen or not len(hits := np.unique(np.concatenate(seen), axis=0)):
                continue
            # Places whose windows hold a hit, in runs: hits of a text and item no further apart than the item is long.
            reach = np.array([len(h) for h in self.hashes])[hits[1:, 1]]
            joint = (np.diff(hits[:, :2], axis=0) == 0).all(axis=1) & (np.diff(hits[:, 2]) <= reach)
            cuts = (np.flatnonzero(~joint) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(hits)]):
                text, item, start = hits[i].tolist()
                n, lo, hi = len(self.hashes[item]), int(first[text]), int(first[text + 1]) - k + 1
                start, to = start - n + 1, int(hits[j - 1, 2]) + 1
                left = max(start, lo)
                held = np.flatnonzero(np.isin(rolled[left:min(to + n - 1, hi)], self.hashes[item])) + left
                if len(held) < self.similarity * n - 1e-9:
                    continue
                shingles = {p: tuple(joined[starts[w]:ends[w]] for w in range(p, p + k)) for p in held.tolist()}
                similarity, at = self._best(item, start, to, shingles, lo, hi)
                if similarity >= self.similarity and similarity > best.get((text, item), (0.0, 0))[0]:
                    best[text, item] = similarity, max(at, lo) - lo
        for (text, item), (similarity, at) in best.items():
            yield text, item, similarity, at


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        if ids and size + len(row["text"]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield ids, texts


def _queries(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))


def without_contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS,
                         similarity: float = SIMILARITY, complete: bool = True, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found; only the text goes through Python."""
    for _, texts in _item_blocks(_queries(items, item_col, item_text_col)):
        found = _found(docs.sparkSession.sparkContext.broadcast(texts), shingle, radius, similarity, complete)
        docs = docs.filter(~found(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _found(shared, shingle: int, radius: int, similarity: float, complete: bool):
    """Function of a text column: whether any item of the broadcast block is in it."""
    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value, shingle=shingle, radius=radius, similarity=similarity, complete=complete)
        for column in batches:
            hit, at = np.zeros(len(column), bool), 0
            for part in chunks(iter([pa.record_batch([pa.array(column, pa.string())], ["text"])]), "text", 1 << 20):
                for text, *_ in finder.texts(part.column(0).to_pylist()):
                    hit[at + text] = True
                at += part.num_rows
            yield pd.Series(hit)

    return found


def contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS,
                 similarity: float = SIMILARITY, complete: bool = True, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, similarity, first_word): each benchmark item found in each document, at its best place."""
    spark = docs.sparkSession
    if radius >= 16 * BLOCKS or not 0 < similarity <= 1:
        raise ValueError("radius below 64 and similarity above 0 to 1")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = _queries(items, item_col, item_text_col)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("item", queries.schema["id"].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])

    def search(block: tuple[list, list[str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, texts = shared.value
            finder = Finder(texts, shingle=shingle, radius=radius, similarity=similarity, complete=complete)
            for batch in chunks(batches, "text", 1 << 20):
                hits = list(finder.texts(batch.column("text").to_pylist()))
                rows = pa.array([h[0] for h in hits], pa.int64())
                yield pa.record_batch([batch.column("id").take(rows), pa.array([names[h[1]] for h in hits], item_type),
                                       pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int64())],
                                      ["id", "item", "similarity", "first_word"])

        from pyspark.sql.pandas.types import to_arrow_type
        item_type = to_arrow_type(schema["item"].dataType)
        return source.mapInArrow(run, schema)

    found = [search(block) for block in _item_blocks(queries)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

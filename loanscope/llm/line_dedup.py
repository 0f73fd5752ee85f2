"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased.  A key of at least ``min_chars`` code points that occurs in two or
more documents loses all its lines except in the document with the smallest id.

The distinct 128-bit key hashes of all lines are cut into shards by hash.  Each
shard is a minimal perfect hash (of the first 64 bits) over arrays of
fingerprints (the other 64 bits), document counts and smallest document ids.
Lines travel to their shard as hashes with document and position, never as
text, and probe its arrays; no line is joined with a line.  A shard that gets
more than its part of all probes (a line that a third of all documents have) is
copied and its probes are split by document; at most ``PIECES`` shards can be
above that part, so the list of split shards has a proven size.

Defined cases: a null or empty text is one empty line; a null id counts as one
document that comes after all others; rows that share an id are one document
(their lines stay or go together); a table without repeats, or an empty one,
comes back as it is; other columns, whatever their names, are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.llm import mph
from loanscope.llm.shared import SPACES, ascii_lower, stored

SHARD_KEYS = 4096
# A shard is split when it gets more than 1 / PIECES of all probes and more than twice its usual keys.
PIECES = 16384
LAST = (1 << 63) - 1
INDEX = "sizes binary, marks binary, fingerprints binary, counts binary, owners binary, leftover binary"

_ARRAYS = [c.split()[0] for c in INDEX.split(", ")]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, version, line, h1, h2) of every line whose key is long enough; ``version`` is the text's hash."""
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    keys = lines.select("id", "version", "line", line_key(F.col("content")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keys.select("id", "version", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _build_shard(table: pa.Table) -> pa.Table:
    keys = table["h1"].to_numpy().view(np.uint64)
    sizes, marks, order = mph.build(keys)
    left = len(keys) - int(np.unpackbits(marks).sum())
    columns = {"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "sizes": sizes, "marks": marks}
    for name, column in (("fingerprints", "h2"), ("counts", "documents"), ("owners", "owner")):
        columns[name] = table[column].to_numpy()[order]
    columns["leftover"] = keys[order[len(keys) - left:]]
    return pa.table({k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for k, v in columns.items()})


class _Shard:
    def __init__(self, row: dict):
        self.index = mph.Index(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["marks"], np.uint8))
        self.fingerprints, self.counts, self.owners = (
            np.frombuffer(row[k], np.int64) for k in ("fingerprints", "counts", "owners"))
        self.leftover = np.frombuffer(row["leftover"], np.uint64)

    def repeated(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line is also in a document before its own."""
        at = self.index.find(h1.view(np.uint64))
        found = (at >= 0) & (self.fingerprints[at] == h2)
        for i, key in enumerate(self.leftover.tolist(), self.index.placed):     # hashes that agree in their first half
            same = (h1.view(np.uint64) == np.uint64(key)) & (h2 == self.fingerprints[i])
            at[same], found = i, found | same
        return found & (self.counts[at] > 1) & (self.owners[at] != ids)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a shard: its arrays come first, then its probes."""
    shard = None
    for batch in batches:
        heads = [*np.flatnonzero(np.asarray(batch.column("is_probe")) == 0).tolist(), batch.num_rows]
        start = 0
        for head in heads:
            part = batch.slice(start, head - start)
            if part.num_rows:
                h1, h2, ids = (part.column(c).to_numpy() for c in ("h1", "h2", "id"))
                again = pa.array(shard.repeated(h1, h2, ids))
                yield part.select(["id", "version", "line"]).filter(again)
            if head < batch.num_rows:
                shard = _Shard({c: batch.column(c)[head].as_py() for c in _ARRAYS})
            start = head + 1


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, drops: pd.Series) -> pd.Series:
    """Texts without the lines at the given positions; null stays null."""
    out = []
    for text, drop in zip(texts, drops):
        if text is not None:
            gone = set(drop.tolist())
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def drop_repeated_lines(docs: DataFrame, *, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped): each input row as a struct, its text without repeated lines, and line counts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
            .select("row", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"))
            .withColumn("version", F.xxhash64("text")))
    lines = _hashed_lines(rows, min_chars)
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("latest"), F.count("*").alias("n")),
                      "line-hashes")
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    distinct = distinct.withColumn("shard", F.pmod("h1", F.lit(shards))).withColumn(
        "documents", F.when(F.col("owner") < F.col("latest"), F.col("n")).otherwise(1))
    index = stored(distinct.select("shard", "h1", "h2", "documents", "owner").groupBy("shard").applyInArrow(
        _build_shard, f"shard long, {INDEX}"), "line-index")

    total = distinct.agg(F.sum("n")).first()[0] or 0
    part = max(total // PIECES, 2 * SHARD_KEYS)
    split = (distinct.groupBy("shard").agg(F.sum("n").alias("probes")).filter(F.col("probes") > part)     # at most PIECES rows
             .select("shard", F.ceil(F.col("probes") / part).alias("pieces")))
    split = F.broadcast(spark.createDataFrame(split.collect(), "shard long, pieces long"))
    piece = F.coalesce("pieces", F.lit(1))
    probes = (lines.withColumn("shard", F.pmod("h1", F.lit(shards))).join(split, "shard", "left")
              .select("shard", F.pmod(F.xxhash64("id", "version", "line"), piece).alias("piece"), F.lit(1).alias("is_probe"),
                      "id", "version", "line", "h1", "h2"))
    arrays = (index.join(split, "shard", "left")
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), piece - 1))).drop("pieces")
              .withColumn("is_probe", F.lit(0)))
    both = (probes.unionByName(arrays, allowMissingColumns=True).repartition("shard", "piece")
            .sortWithinPartitions("shard", "piece", "is_probe"))
    dropped = (both.mapInArrow(_probe, "id long, version long, line int").groupBy("id", "version")
               .agg(F.collect_set("line").alias("drops")))
    found = rows.join(dropped, ["id", "version"], "left")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(
        _without(F.when(F.col("drops").isNotNull(), F.col("text")), F.col("drops")))
    return found.select("row", kept.alias("kept"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
                        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))

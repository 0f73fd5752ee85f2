"""Connected components of an undirected graph given as edges between long node ids.

Each partition first reduces its edges to a spanning forest of stars.  Then
two steps alternate until nothing changes: every node links its larger
neighbours to its smallest neighbour, and every node links itself and its
smaller neighbours to the smallest of them.  Components end as stars around
their smallest node.  Rounds are written to a scratch table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.shared import stored


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [n for n in list(parent) if root(n) != n]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i:i + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has an edge and is not the smallest of its component, with that smallest node."""
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = stored(pairs.mapInArrow(_stars, "u long, v long"), "edges")
    sum_of = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    before = now.agg(F.count("*"), sum_of).first()
    while before[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        after = now.agg(F.count("*"), sum_of).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

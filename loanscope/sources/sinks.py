"""Sinks: create-table-as / overwrite of a result frame, and tables that are replaced in one step.

``publish`` writes each version of a table to a folder of its own and, once the
write is committed, makes it the current one by creating an empty marker file,
which a file system does in one step.  Readers take the version that the highest
marker names and go on reading it while a new one is written or published; a
write that is cut off has no marker and is never seen.  Markers are named by a
number one above the highest there is and by the version, so two writers that
publish at once both succeed and all readers agree on which of them came last.
``remove_old_versions`` deletes what was replaced, when nobody reads it any more.

``write_clustered`` lays a table out along a Z-order curve of several columns, so
that each file holds a narrow part of every one of them, and keeps the files'
least and greatest values beside it; ``read_clustered`` opens only the files whose
values can meet the given ranges.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of each column's place on the Z-order curve.
Z_BITS = 8
_VERSIONS, _MARKERS = "_versions", "_published"


def write_table(df: DataFrame, target: str, *, mode: str = "overwrite",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write ``df`` to a path (contains ``/``) or to a catalog table.

    ``mode`` is explicit (default overwrite) so a rerun replaces the previous
    staging table instead of failing on it.  ``partition_by`` lays files out
    by a low-cardinality column so report readers prune whole folders.
    """
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)
    return target


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, modification time in seconds) of what is in a folder; nothing if there is none."""
    files, folder = _file_system(spark, path)
    if not files.exists(folder):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in files.listStatus(folder)]


def published_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions of a table, oldest first."""
    return [name.split(".", 1)[1] for name in sorted(n for n, _ in _listed(spark, f"{path}/{_MARKERS}") if not n.startswith("."))]


def publish(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the new version of the table at ``path``; the folder of that version."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    folder = write_table(df, f"{path}/{_VERSIONS}/{version}", mode="errorifexists", partition_by=partition_by)
    markers = sorted(n for n, _ in _listed(spark, f"{path}/{_MARKERS}") if not n.startswith("."))
    number = int(markers[-1].split(".", 1)[0]) + 1 if markers else 1
    files, marker = _file_system(spark, f"{path}/{_MARKERS}/{number:012d}.{version}")
    files.mkdirs(marker.getParent())
    if not files.createNewFile(marker):
        raise FileExistsError(f"{marker} is there already")
    return folder


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version of a table; None if none was published."""
    versions = published_versions(spark, path)
    return f"{path}/{_VERSIONS}/{versions[-1]}" if versions else None


def remove_old_versions(spark: SparkSession, path: str, *, keep: int = 1, unfinished_after: float = 86_400.0) -> list[str]:
    """Delete all but the last ``keep`` published versions, and unpublished ones not touched for so many seconds."""
    versions = published_versions(spark, path)
    old = set(versions[:-keep] if keep else versions)
    now = time.time()
    left = {name for name, changed in _listed(spark, f"{path}/{_VERSIONS}") if name not in versions and now - changed > unfinished_after}
    for name, _ in _listed(spark, f"{path}/{_MARKERS}"):
        if "." in name and name.split(".", 1)[1] in old:
            files, marker = _file_system(spark, f"{path}/{_MARKERS}/{name}")
            files.delete(marker, False)
    for version in old | left:
        files, folder = _file_system(spark, f"{path}/{_VERSIONS}/{version}")
        files.delete(folder, True)
    return sorted(old | left)


def z_order(df: DataFrame, columns: list[str], bits: int = Z_BITS) -> Column:
    """Place of a row on a Z-order curve: the bits of its columns' quantile numbers, interleaved; NULL counts as lowest."""
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), marks, 100 << bits).alias(c) for c in columns]).first()
    place = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        edges = F.array(*[F.lit(float(e)) for e in sorted(set(cuts[c] or []))]).cast("array<double>")
        # Number of edges at or below the value, by binary search in one expression.
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
        value = F.col(c).cast("double")
        number = _edges_below(edges, value, steps)
        for b in range(bits):
            bit = F.shiftright(number, b).bitwiseAND(F.lit(1)).cast("bigint")
            place = place.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return place


def _edges_below(edges: Column, value: Column, steps: Column) -> Column:
    def further(place: Column, step: Column) -> Column:
        take = (place + step <= F.size(edges)) & (F.try_element_at(edges, place + step) <= value)
        return F.when(F.coalesce(take, F.lit(False)), place + step).otherwise(place)

    return F.aggregate(steps, F.lit(0), further)


def write_clustered(df: DataFrame, path: str, columns: list[str], *, files: int) -> str:
    """Write ``df`` in about ``files`` files, each a stretch of the Z-order curve of ``columns`` (numbers), and their value ranges.

    The input is read three times (quantiles, Spark's sample of the range exchange, write).
    """
    spark = df.sparkSession
    placed = df.withColumn("__z", z_order(df, columns))
    # Rows of one place are split by their values, so that a crowded place fills several files.
    ranged = placed.repartitionByRange(files, "__z", *columns).sortWithinPartitions("__z", *columns).drop("__z")
    write_table(ranged, f"{path}/data")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    least = [f(F.col(c)).alias(f"{label}_{c}") for c in columns for label, f in (("min", F.min), ("max", F.max))]
    ranges = spark.read.parquet(f"{path}/data").groupBy(name.alias("file")).agg(*least)
    write_table(ranges.coalesce(1), f"{path}/ranges")
    return path


def clustered_files(spark: SparkSession, path: str, **ranges: tuple[float | None, float | None]) -> list[str]:
    """Files of a clustered table that can hold rows with each column inside its (least, greatest), both included."""
    index = spark.read.parquet(f"{path}/ranges")
    for column, (least, greatest) in ranges.items():
        if least is not None:
            index = index.filter(F.col(f"max_{column}") >= least)
        if greatest is not None:
            index = index.filter(F.col(f"min_{column}") <= greatest)
    return sorted(f"{path}/data/{row['file']}" for row in index.select("file").collect())


def read_clustered(spark: SparkSession, path: str, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows of a clustered table with each column inside its (least, greatest), both included; other files are not opened."""
    whole = spark.read.parquet(f"{path}/data")
    files = clustered_files(spark, path, **ranges)
    found = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    for column, (least, greatest) in ranges.items():
        if least is not None:
            found = found.filter(F.col(column) >= least)
        if greatest is not None:
            found = found.filter(F.col(column) <= greatest)
    return found

"""Helpers shared by the operators: scratch tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes handled at once inside a Python task.
CHUNK_BYTES = 4 << 20
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that driver and executors share.

    ``spark.checkpoint.dir`` (or a folder the application set on its context)
    names it.  Where neither is set a local session uses a temporary folder;
    any other session is refused, because executors could not see one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loanscope-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def hash_share(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """About ``wanted`` of the rows, those whose key hashes lowest; all if there are not many more.

    A filter: no task ranks or gathers rows, and the same rows are chosen again if a stage is recomputed.
    """
    n = rows.count()
    if n <= wanted:
        return rows
    return rows.filter(F.xxhash64(key) < F.lit(-(1 << 63) + (wanted << 64) // n))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``most`` bytes of column ``text`` each; a longer value stays whole."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)

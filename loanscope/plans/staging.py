"""Staging: write the clean table once, let every report read it.

The process builds its clean table once (create-table-as) and all reports read
that table.  ``stage_clean`` writes it to a path the caller names.
``staged_clean`` does the same for a driver folder below the session's shared
folder, under a name made of the source's file list (paths, sizes, modification
times, read through Spark, so any store it can read will do) and a digest of
the modules that define the table: a changed, added or replaced source file is
staged afresh, within one application too.  The table is published in one step
(``sinks.publish``): a write that was cut off does not count, and applications
that stage one source at the same time do not disturb each other.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loanscope
from loanscope.operators.tiering import tier_cuts
from loanscope.plans import portfolio as P
from loanscope.session import shared_folder
from loanscope.sources.fixture import read_loan_book
from loanscope.sources.sinks import publish, published, write_table

_LOCK = threading.Lock()
_CUTS: dict[str, list[tuple]] = {}
_DEFINING = ("sources/fixture.py", "sources/loanbook.py", "sources/sinks.py", "functions/expressions.py",
             "operators/imputation.py", "operators/selection.py", "operators/positional.py", "plans/portfolio.py")


def _code_digest() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1(loanscope.__version__.encode())
    for rel in _DEFINING:
        with open(os.path.join(root, rel), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()


_CODE = _code_digest()


def source_key(spark: SparkSession, source: str) -> str:
    """Digest of the files below ``source``: their paths, sizes and modification times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    listed = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    count, total = files.agg(F.count("*"), F.sum(listed)).first()
    return hashlib.sha1(f"{source}|{count}|{total}|{_CODE}".encode()).hexdigest()[:20]


def stage_clean(spark: SparkSession, raw: DataFrame, path: str, *, mode: str = "overwrite") -> DataFrame:
    """Write the clean table of ``raw`` to ``path`` (a folder or catalog table) and read it back."""
    write_table(P.clean_table(raw), path, mode=mode)
    return spark.read.parquet(path) if "/" in path else spark.table(path)


def staged_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the published clean table of a driver folder, written if there is none."""
    key = source_key(spark, f"{sf_dir}/orders.parquet")
    table = f"{shared_folder(spark)}/loanscope-staging/clean-{key}"
    with _LOCK:
        return published(spark, table) or publish(P.clean_table(read_loan_book(spark, sf_dir)), table)


def staged_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean loan book for a driver folder, written once and read back."""
    return spark.read.parquet(staged_path(spark, sf_dir))


def staged_with_cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple]]:
    """The staged table and its tier boundaries (four rows), found once for each staged table."""
    path = staged_path(spark, sf_dir)
    clean = spark.read.parquet(path)
    with _LOCK:
        if path not in _CUTS:
            _CUTS[path] = tier_cuts(clean, "utilization", P.TIERS, cap_at=P.UTILIZATION_CAP)
        return clean, _CUTS[path]

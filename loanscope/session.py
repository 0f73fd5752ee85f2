"""Session helpers.

The library sets nothing on a session: master, time zone, adaptive execution
and memory are whatever the application or spark-submit chose.  Work tables go
below the folder that the session names in ``spark.checkpoint.dir`` (or that
the application gave to ``setCheckpointDir``), which driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def get_session(app: str = "loanscope", *, master: str | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session; ``master`` and ``conf`` only if the caller gives them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for work tables that every executor can read.

    A local session that names none gets one temporary folder per process; any
    other session is refused, because executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="loanscope-work-"))
    return _LOCAL[0]


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet work table and read it back: later passes scan columns and
    cut lineage, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/loanscope-work/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

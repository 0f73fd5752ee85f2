import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .appName("loanscope-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="loanscope-wh-"))
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loanscope-work-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def sf_dir(sf: str) -> str:
    return f"{TESTDATA}/sf{sf}"


def have(sf: str) -> bool:
    return os.path.exists(f"{sf_dir(sf)}/orders.parquet")

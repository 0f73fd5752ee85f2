"""Staging writes the clean table once per source and reads it back."""

import glob
import os
import shutil
import tempfile

import pytest
from conftest import have, sf_dir

from loanscope.plans import portfolio as P
from loanscope.plans import staging
from loanscope.sources.fixture import read_loan_book


@pytest.mark.skipif(not have("0.001"), reason="no sf0.001")
def test_staged_clean_matches_and_is_reused(spark):
    a = staging.staged_clean(spark, sf_dir("0.001"))
    b = staging.staged_clean(spark, sf_dir("0.001"))
    assert a.inputFiles() == b.inputFiles()
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in a.inputFiles())
    fresh = P.clean_table(read_loan_book(spark, sf_dir("0.001")))
    assert a.count() == 1498
    assert a.exceptAll(fresh).count() == 0 and fresh.exceptAll(a).count() == 0


@pytest.mark.skipif(not have("0.001"), reason="no sf0.001")
def test_changed_source_is_staged_again(spark):
    d = tempfile.mkdtemp(prefix="loanscope-src-")
    shutil.copy(f"{sf_dir('0.001')}/orders.parquet", f"{d}/orders.parquet")
    first = staging.staged_clean(spark, d).inputFiles()
    os.utime(f"{d}/orders.parquet", (1, 1))
    second = staging.staged_clean(spark, d).inputFiles()
    assert first != second


@pytest.mark.skipif(not have("0.001"), reason="no sf0.001")
def test_replaced_part_file_and_cut_off_write(spark):
    d = tempfile.mkdtemp(prefix="loanscope-src-")
    orders = spark.read.parquet(f"{sf_dir('0.001')}/orders.parquet")
    orders.coalesce(1).write.parquet(f"{d}/orders.parquet")
    assert staging.staged_clean(spark, d).count() == 1498
    part = glob.glob(f"{d}/orders.parquet/part-*")[0]
    orders.limit(700).coalesce(1).write.parquet(f"{d}/other")
    shutil.copy(glob.glob(f"{d}/other/part-*")[0], part)
    for crc in glob.glob(f"{d}/orders.parquet/.*.crc"):
        os.remove(crc)
    assert staging.staged_clean(spark, d).count() <= 700
    path = staging.staged_path(spark, d)
    table = path.split("/_versions/")[0].removeprefix("file:")
    for marker in glob.glob(f"{table}/_published/*"):
        os.remove(marker)                                                # as a write that was cut off leaves it
    again = staging.staged_path(spark, d)
    assert again != path and "loan_id" in staging.staged_clean(spark, d).columns


def test_clean_table_to_a_named_path(spark):
    d = tempfile.mkdtemp(prefix="loanscope-named-")
    raw = read_loan_book(spark, sf_dir("0.001"))
    assert staging.stage_clean(spark, raw, f"{d}/clean").count() == 1498

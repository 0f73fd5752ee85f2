"""Sessions: nothing is set by the library, and it runs where no work folder is named."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, sf_dir

ALL_KEYS = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from loanscope.plans import catalog
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name, fn in catalog.queries().items():
    fn(spark, {sf!r}).collect()
assert spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None
print("ALL", len(catalog.queries()))
"""

SUBMITTED = """
import sys; sys.path.insert(0, {root!r})
from loanscope.session import get_session, shared_folder
spark = get_session()
folder = {folder!r}
spark.sparkContext.setCheckpointDir(folder)
assert folder in shared_folder(spark)
print("GOT", spark.sparkContext.master, spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.driver.memory"))
"""


def _python(code: str, submit: str = "") -> str:
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="loanscope-conf-")}
    if submit:
        env["PYSPARK_SUBMIT_ARGS"] = f"{submit} pyspark-shell"
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_all_reports_run_without_a_named_work_folder():
    from loanscope.plans import catalog

    assert f"ALL {len(catalog.queries())}" in _python(ALL_KEYS.format(root=ROOT, sf=sf_dir("0.001")))


def test_submitted_settings_survive():
    out = _python(SUBMITTED.format(root=ROOT, folder=tempfile.mkdtemp()),
                  "--master local[2] --driver-memory 3g --conf spark.sql.session.timeZone=America/New_York --conf spark.ui.enabled=false")
    assert "GOT local[2] America/New_York 3g" in out

"""Scale-up experiment: built-in windows vs the scale paths as rows grow.

Replicates the sf0.1 loan book R times (orders cross-joined with range(R),
order keys shifted so loan ids stay unique; every copy keeps the fixture's
NULLs, ties and hot values), stages it once as Parquet in a scratch folder
(``$SCALEUP_DIR``, else a fresh folder below the session's shared one), then times on the staged table:

  tiers    : tier_summary, built-in NTILE over one window vs G1
  tier_top : top 3 per tier, built-in NTILE + window group limit vs G1 + top values
  watch    : watch list rank/lead, built-in per-band windows vs G2
  median   : built-in median aggregate vs G3 exact selection

Prints one JSON line per R.  Usage: python bench_scaleup.py 20 100
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from loanscope.operators.selection import exact_percentile  # noqa: E402
from loanscope.plans import portfolio as P  # noqa: E402
from loanscope.session import get_session, shared_folder  # noqa: E402
from loanscope.sources.fixture import loan_book_from_orders  # noqa: E402


def _timed(fn):
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 2)


def main() -> None:
    reps = [int(a) for a in sys.argv[1:]] or [20]
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("loanscope-scaleup", master=f"local[{cpus}]", conf={
        "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    scratch = (os.environ.get("SCALEUP_DIR")
               or f"{shared_folder(spark)}/loanscope-scaleup-{uuid.uuid4().hex[:8]}")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    span = orders.agg(F.max("o_orderkey")).first()[0] + 1
    for r in reps:
        grown = (orders.crossJoin(spark.range(r).withColumnRenamed("id", "__copy"))
                 .withColumn("o_orderkey", F.col("o_orderkey") + F.col("__copy") * span)
                 .drop("__copy"))
        path = f"{scratch}/clean_x{r}"
        P.clean_table(loan_book_from_orders(grown)).write.mode("overwrite").parquet(path)
        clean = spark.read.parquet(path)
        n = clean.count()
        noop = lambda df: df.write.format("noop").mode("overwrite").save()
        res = {"copies": r, "rows": n}
        res["tiers_builtin"] = _timed(lambda: P.tier_summary(clean, builtin=True).collect())
        res["tiers_G1"] = _timed(lambda: P.tier_summary(clean).collect())
        res["tier_top_builtin"] = _timed(lambda: P.tier_top(clean, builtin=True).collect())
        res["tier_top_scale"] = _timed(lambda: P.tier_top(clean).collect())
        res["watch_builtin"] = _timed(lambda: noop(P.watchlist(clean, builtin=True, ordered=False)))
        res["watch_G2"] = _timed(lambda: noop(P.watchlist(clean, ordered=False)))
        res["median_builtin"] = _timed(
            lambda: clean.agg(F.median(F.col("utilization"))).collect())
        res["median_G3"] = _timed(lambda: exact_percentile(clean, "utilization", 0.5))
        print(json.dumps(res), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

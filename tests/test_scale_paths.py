"""Scale paths (G1 global tiering, G2 skew-safe rank/lead, G3 exact percentile)
against the built-in window functions on skewed, tied, NULL, NaN and tiny inputs.
Small knobs force several buckets and narrowing rounds."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import OrderKey
from loanscope.operators import ranking, tiering
from loanscope.operators.selection import exact_percentile, select_positions

KNOBS = {"fanout": 8, "max_candidates": 40, "per_cut": 4}


def _frame(spark, n, seed, hot_share=0.35, nulls=0.05, nans=0.02, groups=4, hot_group_share=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        r = rnd.random()
        if r < hot_share:
            v = 0.0                                  # one value holding a third of the rows
        elif r < hot_share + nulls:
            v = None
        elif r < hot_share + nulls + nans:
            v = float("nan")
        else:
            v = round(rnd.random() * 10, 2)          # many ties after rounding
        g = 0 if rnd.random() < hot_group_share else rnd.randrange(groups)
        rows.append((i * 7 % (n * 7 + 1), f"g{g}", v, rnd.randrange(2)))
    return spark.createDataFrame(rows, "id long, grp string, v double, flag int")


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (4, 5), (5, 5), (12, 7), (1000, 5), (997, 15)])
def test_ntile_starts_match_builtin(spark, n, k):
    df = spark.range(n).withColumn("t", F.ntile(k).over(Window.orderBy("id")))
    firsts = [r.id for r in df.groupBy("t").agg(F.min("id").alias("id")).orderBy("t").collect()]
    assert firsts[1:] == tiering.ntile_starts(n, k)


@pytest.mark.parametrize("seed,n,k", [(1, 2000, 5), (2, 777, 7), (3, 9, 5), (4, 1500, 3)])
def test_global_ntile_equals_builtin(spark, seed, n, k):
    df = _frame(spark, n, seed)
    keys = [OrderKey("v"), OrderKey("id")]
    a = tiering.assign_tiers(df, keys, k, out="t", strategy="builtin")
    b = tiering.assign_tiers(df, keys, k, out="t", strategy="select", **KNOBS)
    diff = a.select("id", "t").exceptAll(b.select("id", "t")).count()
    assert diff == 0 and b.count() == n


def test_global_ntile_plan_has_no_single_partition(spark):
    df = _frame(spark, 500, 9)
    b = tiering.assign_tiers(df, [OrderKey("v"), OrderKey("id")], 5, out="t", strategy="select", **KNOBS)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_select_positions_all_positions(spark, seed):
    df = _frame(spark, 300, seed)
    keys = [OrderKey("v"), OrderKey("id")]
    exp = [(r.v, r.id) for r in df.orderBy(F.col("v").asc_nulls_first(), "id").collect()]
    pos = list(range(0, 300, 7)) + [299]
    got = select_positions(df, keys, pos, **KNOBS)
    for p in pos:
        gv, gi = got[p]
        ev, ei = exp[p]
        assert gi == ei and (gv == ev or (gv != gv and ev != ev) or (gv is None and ev is None))


def test_select_positions_value_only_heavy_duplicates(spark):
    # no tie column: a value repeated 70% of the time resolves as a point bucket
    df = spark.createDataFrame([(0.5 if i % 10 < 7 else float(i),) for i in range(400)], "v double")
    exp = sorted(r.v for r in df.collect())
    got = select_positions(df, [OrderKey("v")], [0, 100, 200, 399], **KNOBS)
    assert {p: got[p][0] for p in got} == {p: exp[p] for p in (0, 100, 200, 399)}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_percentile_equals_builtin(spark, p):
    df = _frame(spark, 1001, 21, nans=0.0)
    exp = df.agg(F.percentile(F.col("v"), p)).first()[0]
    assert exact_percentile(df, "v", p, **KNOBS) == pytest.approx(exp, abs=1e-12)


def test_exact_percentile_even_count_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in [5, 10, 20, 35, 40, None]], "x long")
    assert exact_percentile(df, "x", 0.5, max_candidates=1, fanout=2, per_cut=2) == 20.0
    df2 = spark.createDataFrame([(x,) for x in [5, 10, 20, 35]], "x long")
    assert exact_percentile(df2, "x", 0.5, max_candidates=1, fanout=2, per_cut=2) == 15.0
    assert exact_percentile(df2.filter("x > 100"), "x", 0.5) is None


def _peers(df, strategy, **kw):
    return ranking.ranked_peers(df, "grp", "v", "id", ("flag",), rank_name="rk", strategy=strategy, **kw)


@pytest.mark.parametrize("seed,hot_group", [(31, 0.0), (32, 0.6), (33, 0.34)])
def test_ranked_peers_equals_builtin(spark, seed, hot_group):
    df = _frame(spark, 1500, seed, groups=6, hot_group_share=hot_group)
    cols = ["grp", "id", "v", "flag", "rk", "next_id", "next_v", "next_flag"]
    a = _peers(df, "builtin").select(*cols)
    b = _peers(df, "buckets", rows_per_bucket=20, fan=9, per_cut=4).select(*cols)
    assert b.count() == 1500
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ranked_peers_hot_value_is_split(spark):
    # one group, one value holding 60 % of its rows: buckets still cut through it
    df = _frame(spark, 2000, 41, hot_share=0.6, groups=1)
    b = _peers(df, "buckets", rows_per_bucket=50, fan=64, per_cut=4)
    a = _peers(df, "builtin")
    cols = ["id", "rk", "next_id"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(grp" in plan and "__bucket" in plan


def test_top_per_group_uses_window_group_limit(spark):
    df = _frame(spark, 300, 51)
    top = ranking.top_per_group(df, "grp", "v", 3, out="r", strategy="builtin")
    top.count()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    exp = (df.withColumn("r", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.col("v").desc())))
           .filter("r <= 3"))
    assert exp.select("id", "r").exceptAll(top.select("id", "r")).count() == 0


@pytest.mark.parametrize("dense", [True, False])
def test_top_per_group_values_path_with_massive_ties(spark, dense):
    # 60 % of every group shares the top value; NULL and NaN values too
    rows = [(i, f"g{i % 3}", 9.0 if i % 10 < 6 else (None if i % 10 == 6 else
                                                      (float("nan") if i % 10 == 7 else float(i % 13))))
            for i in range(900)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    a = ranking.top_per_group(df, "grp", "v", 3, out="r", dense=dense, strategy="builtin")
    b = ranking.top_per_group(df, "grp", "v", 3, out="r", dense=dense, strategy="values")
    assert a.count() == b.count()
    assert a.select("id", "r").exceptAll(b.select("id", "r")).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "__cut" in plan


def test_top_per_group_values_path_null_group_and_small_groups(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 2}", float(i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    for dense in (True, False):
        a = ranking.top_per_group(df, "grp", "v", 3, out="r", dense=dense, strategy="builtin")
        b = ranking.top_per_group(df, "grp", "v", 3, out="r", dense=dense, strategy="values")
        assert a.select("id", "r").exceptAll(b.select("id", "r")).count() == 0 and a.count() == b.count()


def test_filter_on_tier_stays_small(spark):
    # a user filter on the tier is pushed down through the tier expression:
    # it must not expand (flat CASE, not a chain of search steps)
    df = _frame(spark, 400, 61)
    keys = [OrderKey("v"), OrderKey("id")]
    t = tiering.assign_tiers(df, keys, 20, out="t", strategy="select", **KNOBS)
    q = t.filter(F.col("t") == 20)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
    exp = tiering.assign_tiers(df, keys, 20, out="t", strategy="builtin").filter(F.col("t") == 20)
    assert q.select("id").exceptAll(exp.select("id")).count() == 0 and q.count() == exp.count()


def test_select_positions_materialized_input(spark):
    df = _frame(spark, 300, 71).withColumn("v2", F.col("v") * 2)     # a derived frame
    keys = [OrderKey("v2"), OrderKey("id")]
    a = select_positions(df, keys, [0, 150, 299], **KNOBS)
    b = select_positions(df, keys, [0, 150, 299], materialize=True, **KNOBS)
    assert {p: a[p][1] for p in a} == {p: b[p][1] for p in b}


@pytest.mark.parametrize("seed,hot_share", [(81, 0.35), (82, 0.6)])
def test_ranked_peers_dense_rank(spark, seed, hot_share):
    df = _frame(spark, 1200, seed, hot_share=hot_share, groups=3, hot_group_share=0.5)
    cols = ["id", "rk", "drk", "next_id"]
    a = ranking.ranked_peers(df, "grp", "v", "id", ("flag",), rank_name="rk", dense_name="drk",
                             strategy="builtin").select(*cols)
    b = ranking.ranked_peers(df, "grp", "v", "id", ("flag",), rank_name="rk", dense_name="drk",
                             strategy="buckets", rows_per_bucket=25, fan=8, per_cut=4).select(*cols)
    assert b.count() == 1200 and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
def test_global_ntile_on_other_key_types(spark, kind):
    base = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 997).alias("k"))
    if kind == "string":
        keyed = base.withColumn("key", F.format_string("s%05d", F.col("k")))
    elif kind == "date":
        keyed = base.withColumn("key", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int")))
    else:
        ts = F.timestamp_seconds(F.col("k") * 3600 + F.lit(1_600_000_000))
        keyed = base.withColumn("key", ts if kind == "timestamp" else ts.cast("timestamp_ntz"))
    keys = [OrderKey("key"), OrderKey("id")]
    a = tiering.assign_tiers(keyed, keys, 7, out="t", strategy="builtin")
    b = tiering.assign_tiers(keyed, keys, 7, out="t", strategy="select", **KNOBS)
    assert a.select("id", "t").exceptAll(b.select("id", "t")).count() == 0


def test_ranked_peers_null_group_is_a_group(spark):
    df = _frame(spark, 900, 91, groups=3).withColumn(
        "grp", F.when(F.col("id") % 7 < 4, F.lit(None).cast("string")).otherwise(F.col("grp")))
    cols = ["grp", "id", "rk", "drk", "next_id", "next_v"]
    a = ranking.ranked_peers(df, "grp", "v", "id", ("flag",), rank_name="rk", dense_name="drk",
                             strategy="builtin").select(*cols)
    b = ranking.ranked_peers(df, "grp", "v", "id", ("flag",), rank_name="rk", dense_name="drk",
                             strategy="buckets", rows_per_bucket=20, fan=9, per_cut=4).select(*cols)
    assert b.count() == 900 and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("n,sample", [(10, None), (3, 20), (3, 4)])
def test_top_per_group_values_with_small_samples(spark, monkeypatch, n, sample):
    if sample is not None:
        monkeypatch.setattr(ranking, "LEAST_CELLS", sample)
    df = _frame(spark, 800, 95, groups=5)
    for dense in (True, False):
        a = ranking.top_per_group(df, "grp", "v", n, out="r", dense=dense, strategy="builtin")
        b = ranking.top_per_group(df, "grp", "v", n, out="r", dense=dense)
        assert a.count() == b.count() and a.select("id", "r").exceptAll(b.select("id", "r")).count() == 0


def test_top_values_of_many_groups_have_no_hinted_broadcast(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, double('NaN'), double(id % 1999)) as grp", "cast(id % 7 as double) as v")
    a = ranking.top_per_group(df, "grp", "v", 2, out="r", strategy="builtin")
    b = ranking.top_per_group(df, "grp", "v", 2, out="r")
    assert a.select("id", "r").exceptAll(b.select("id", "r")).count() == 0 and a.count() == b.count()
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    # as many cutoffs as groups: Spark decides by their size
    assert "strategy=broadcast" not in plan and "__cut" in plan


def test_more_tiers_than_one_budget_of_cuts(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id * 7919 % 5003 as double) as v")
    keys = [OrderKey("v"), OrderKey("id")]
    a = tiering.assign_tiers(df, keys, 100, out="t", strategy="builtin")
    b = tiering.assign_tiers(df, keys, 100, out="t", max_candidates=1, fanout=256)
    assert a.select("id", "t").exceptAll(b.select("id", "t")).count() == 0


def test_more_heavy_groups_than_cuts(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, double('NaN'), double(id % 300)) as grp", "cast(id % 11 as double) as v", "1 as flag")
    a = _peers(df, "builtin")
    b = _peers(df, "buckets", rows_per_bucket=5, fan=40)
    c = _peers(df, "buckets", rows_per_bucket=100_000)                   # no group needs a cut: the same plan, one bucket a group
    cols = ["id", "rk", "next_id"]
    for other in (b, c):
        assert a.select(*cols).exceptAll(other.select(*cols)).count() == 0 and other.count() == 6000
    assert "__bucket" in c._jdf.queryExecution().analyzed().toString()


def test_means_do_not_depend_on_partitions(spark):
    from loanscope.functions.expressions import exact_mean

    df = spark.range(50_000).selectExpr("1e9 * sin(id) + id / 7 as x")
    one, many = (df.repartition(n).agg(exact_mean("x", 10).alias("m")).first().m for n in (1, 64))
    assert one == many


@pytest.mark.parametrize("fan,size", [(3, 10), (4, 60), (256, 7), (2, 1)])
def test_ranked_peers_over_a_tree_of_cuts(spark, fan, size):
    # fan * fan buckets at most: with small fans the second level is in use, with 256 the first one alone
    df = _frame(spark, 1300, 17, hot_share=0.5, groups=3, hot_group_share=0.7)
    cols = ["grp", "id", "rk", "drk", "next_id", "next_v", "next_flag"]
    a = _peers(df, "builtin", dense_name="drk").select(*cols)
    b = _peers(df, "buckets", dense_name="drk", rows_per_bucket=size, fan=fan, per_cut=3).select(*cols)
    assert b.count() == 1300 and a.exceptAll(b).count() == 0
    rows = ranking.spool(ranking._placed(df, [OrderKey("grp", True), OrderKey("v", True), OrderKey("id")],
                                         *ranking.sample_and_count(df, [OrderKey("grp", True), OrderKey("v", True), OrderKey("id")], 3 * fan, by="id"),
                                         -(-1300 // max(size, -(-1300 // fan ** 2))) - 1, fan, 3, 5), "placed")
    held = [r["count"] for r in rows.groupBy("__bucket").count().collect()]
    wanted = max(size, 1300 / fan ** 2)
    assert max(held) < 12 * wanted + 40 and len(held) > 1


def test_ranked_peers_plan_holds_no_long_literal(spark):
    df = _frame(spark, 6000, 18, groups=2)
    plan = _peers(df, "buckets", rows_per_bucket=1)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000


def test_sample_and_count_is_one_pass(spark):
    from loanscope.operators.positional import sample_and_count

    df = _frame(spark, 500, 19)
    rows, n = sample_and_count(df, [OrderKey("v"), OrderKey("id")], 40, by="id")
    assert n == 500 and len(rows) == 40
    assert sample_and_count(df, [OrderKey("id")], 1000, by="id")[0] == [(i,) for i in sorted(r.id for r in df.collect())]
    assert sample_and_count(df.filter("id < 0"), [OrderKey("id")], 10, by="id") == ([], 0)


@pytest.mark.parametrize("n", [1, 3, 20])
def test_cutoffs_bound_the_top_values(spark, n):
    df = _frame(spark, 3000, 20, hot_share=0.6, groups=4)
    rows = ranking._above_cutoffs(df, "grp", "v", n)
    distinct = rows.filter("v is not null").groupBy("grp").agg(F.count_distinct("v").alias("d")).collect()
    assert all(n <= r.d <= 2 * n + 20 for r in distinct)
    top = df.withColumn("r", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.col("v").desc()))).filter(F.col("r") <= n)
    assert top.drop("r").exceptAll(rows).count() == 0


@pytest.mark.parametrize("expression", ["id * 7919 % 100003", "double(id * 7919 % 100003) / 7", "if(id % 3 = 0, 5, id)", "if(id % 5 = 0, null, id % 11)",
                                         "if(id % 50 = 0, double('NaN'), -double(id))", "cast(id % 30000 as int)"])
def test_selection_by_a_rank_sketch(spark, expression):
    df = spark.range(30_000).selectExpr("id", f"{expression} as v").repartition(6)
    keys, wanted = [OrderKey("v"), OrderKey("id")], [0, 1, 7499, 15_000, 22_222, 29_999]
    got = select_positions(df, keys, wanted, max_candidates=1500)
    rows = df.orderBy(F.col("v").asc_nulls_first(), "id").collect()
    assert [got[p][1] for p in wanted] == [rows[p].id for p in wanted]


def test_sketch_leaves_few_rows_around_a_position(spark):
    from loanscope.functions.expressions import OrderKey as Key
    from loanscope.operators import selection
    from loanscope.operators.positional import TupleOrder

    df = spark.range(200_000).selectExpr("double(id * 7919 % 200003) as v", "id")
    order = TupleOrder(df, [Key("v"), Key("id")])
    state = selection.count_and_sketch(df, "v")
    assert state["n"] == 200_000 and state["nulls"] == 0
    cuts = selection._sketch_cuts(df, order, state, [100_000])
    parts = selection._between(df.withColumn("__rid", F.lit(0)), order, [selection._Range(None, True, None, 0, 200_000, [100_000])], {0: cuts})
    assert len(parts) == 1 and parts[0].count < 0.02 * 200_000


@pytest.mark.parametrize("expression,same", [("double(id * 7919 % 5003) / 3000", True), ("double(id * 7919 % 5003) / 1000", False),
                                              ("if(id % 9 = 0, null, if(id % 7 = 0, double('NaN'), double(id % 13)))", False),
                                              ("if(id % 3 = 0, 2.0D, double(id % 3))", False)])
def test_uncapped_cuts_from_capped_ones(spark, expression, same):
    df = spark.range(3000).selectExpr("id as loan_id", f"{expression} as utilization")
    for knobs in ({}, KNOBS):
        capped = tiering.tier_cuts(df, "utilization", 5, cap_at=2.0, **knobs)
        raw = tiering.tier_cuts(df, "utilization", 5, cap_at=None, **knobs)
        got = tiering.uncapped_cuts(df, capped, "utilization", 5, cap_at=2.0, **knobs)
        assert [c[1] for c in got] == [c[1] for c in raw] and len(got) == 4
    assert (capped == raw) >= same


def test_ranked_peers_beside_few_cuts_joins_nothing(spark):
    """Offsets as literals: null groups, quotes in names and values, values that sort oddly."""
    values = (None, float("nan"), float("inf"), 1.5, -0.0, 0.0, 2.0)
    rows = [(i, (None, "a'\\`b", "c")[i % 3 if i < 60 else 0], values[i * 5 % 7], ("x'y\\n", None)[i % 2]) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, grp string, v double, `odd na'me` string")
    made = {}
    for strategy, per in (("builtin", None), ("buckets", 9), ("buckets", 3)):
        made[per] = ranking.ranked_peers(df, "grp", "v", "id", ("odd na'me",), dense_name="dense", strategy=strategy, rows_per_bucket=per, fan=64, per_cut=4)
    told = {per: sorted(repr(sorted(r.asDict().items())) for r in m.collect()) for per, m in made.items()}
    assert told[None] == told[9] == told[3]
    plans = {per: m._jdf.queryExecution().executedPlan().toString() for per, m in made.items()}
    assert "Join" not in plans[9] and "Join" in plans[3]        # 15 cuts are few, 46 are not

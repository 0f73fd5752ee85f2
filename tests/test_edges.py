"""Hand-made rows for every label branch and edge the fixture cannot reach."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanscope.functions.expressions import concentration_flag, pct, trend_label
from loanscope.functions.segments import AGE_BANDS, RATIO_BUCKETS
from loanscope.operators import imputation as impute
from loanscope.operators import quality, reports
from loanscope.operators.rates import segment_rates
from loanscope.plans import portfolio as P
from loanscope.sources.loanbook import RAW_SCHEMA


def _book(spark, rows):
    """rows: (loan_id, flag, income, dependents, age, ratio, util, late_90)."""
    full = [(i, f, inc, dep, age, r, u, 0, l90, 0, 0, 0) for i, f, inc, dep, age, r, u, l90 in rows]
    return spark.createDataFrame(full, RAW_SCHEMA)


def test_ratio_bucket_edges(spark):
    vals = [0.0, 0.3499, 0.35, 0.99, 0.9900018, 0.99999, 1.0, 4.999, 5.0, 5.0000001, 329664.0, None,
            float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "debt_ratio double")
    got = [r[0] for r in df.select(RATIO_BUCKETS.label()).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "Medium", "Medium", "High", "High", "High",
                   "Extreme/Artifact", "Extreme/Artifact", "Unknown", "Extreme/Artifact"]


def test_age_band_edges(spark):
    ages = [18, 29, 30, 49, 50, 69, 70, 99, None]
    df = spark.createDataFrame([(a,) for a in ages], "age bigint")
    got = [r[0] for r in df.select(AGE_BANDS.label()).collect()]
    assert got == ["Young", "Young", "Mid-Career", "Mid-Career", "Senior", "Senior", "Retired",
                   "Retired", "Retired"]


def test_order_columns(spark):
    df = spark.createDataFrame([(x,) for x in ["High", "Low", "Unknown", "Medium", "Extreme/Artifact"]],
                               "debt_bucket string")
    got = sorted((r[1], r[0]) for r in df.select("debt_bucket", RATIO_BUCKETS.order()).collect())
    assert [x for _, x in got] == ["Low", "Medium", "High", "Extreme/Artifact", "Unknown"]


def test_trend_labels(spark):
    df = spark.createDataFrame([(None, None), (-3, 5), (4, 5), (0, 5)], "ch bigint, prev bigint")
    got = [r[0] for r in df.select(trend_label("ch", "prev")).collect()]
    assert got == ["Baseline", "Improving", "Worsening", "No Change"]


def test_concentration_flag_at_exactly_five(spark):
    df = spark.createDataFrame([(Decimal("5.00"),), (Decimal("5.01"),), (Decimal("-5.00"),),
                                (Decimal("-5.01"),), (None,)], "g decimal(9,2)")
    got = [r[0] for r in df.select(concentration_flag("g")).collect()]
    assert got == ["Proportionate", "Overrepresented", "Proportionate", "Underrepresented", "Proportionate"]


def test_flag_compares_rounded_shares(spark):
    # Young: 3333 of 10000 borrowers (33.33 %), 1150 of 3000 defaults (38.333.. -> 38.33 %).
    # Unrounded gap 5.0033 > 5, rounded gap exactly 5.00: the flag uses the rounded shares.
    ids = spark.range(10000)
    book = ids.select(
        F.col("id").alias("loan_id"),
        F.when((F.col("id") < 1150) | ((F.col("id") >= 3333) & (F.col("id") < 3333 + 1850)), 1)
         .otherwise(0).cast("int").alias("default_flag"),
        F.when(F.col("id") < 3333, 25).otherwise(40).cast("bigint").alias("age"))
    c = {r.age_band: r for r in P.concentration(book).collect()}
    assert (c["Young"].borrower_share_pct, c["Young"].default_share_pct) == (33.33, 38.33)
    assert c["Young"].concentration_flag == "Proportionate"
    assert c["Mid-Career"].concentration_flag == "Proportionate"
    assert (c["Total"].borrowers, c["Total"].defaults) == (10000, 3000)


def test_pct_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (201, 20000), (0, 0), (5, 0)], "n bigint, d bigint")
    got = [r[0] for r in df.select(pct("n", "d").cast("double")).collect()]
    assert got == [12.5, 33.33, 66.67, 1.01, None, None]


def test_mode_ties_go_to_lowest_value(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,), (None,), (None,)], "dependents bigint")
    assert impute.mode_frame(df, "dependents", "m").first().m == 1


@pytest.mark.parametrize("attach", ["literal", "join"])
def test_mode_of_all_null_keeps_rows(spark, attach):
    df = spark.createDataFrame([(1, None), (2, None)], "loan_id bigint, dependents bigint")
    out = impute.impute(df, [], ["dependents"], strategy="builtin", attach=attach)
    assert out.count() == 2 and out.filter(F.col("dependents").isNull()).count() == 2


def test_join_and_literal_attach_agree(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i * 10, None if i % 4 == 0 else i % 3, 30 + i)
                                for i in range(40)], "loan_id bigint, inc bigint, dep bigint, age bigint")
    a = impute.impute(df, ["inc"], ["dep"], keep=F.col("age") != 35, attach="join", strategy="builtin")
    b = impute.impute(df, ["inc"], ["dep"], keep=F.col("age") != 35, attach="literal", strategy="builtin")
    assert a.count() == 39 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("builtin", [True, False])
def test_even_count_median_and_imputation(spark, builtin):
    rows = [(1, 0, 10, 0, 30, 0.1, 0.1, 0), (2, 0, 20, 1, 30, 0.1, 0.1, 0),
            (3, 1, 40, None, 30, 0.1, 0.1, 0), (4, 0, 35, 1, 30, 0.1, 0.1, 0),
            (5, 0, None, 1, 30, 0.1, 0.1, 0), (6, 0, None, 0, 0, 0.1, 0.1, 0),
            (7, 0, 5, 1, None, 0.1, 0.1, 0)]
    clean = P.clean_table(_book(spark, rows), builtin=builtin, max_candidates=2, fanout=2)
    got = {r.loan_id: (r.monthly_income, r.dependents) for r in clean.collect()}
    # median of 10,20,40,35,5 (raw rows incl. age 0 / NULL age) = 20; mode of deps = 1
    assert got == {1: (10.0, 0), 2: (20.0, 1), 3: (40.0, 1), 4: (35.0, 1), 5: (20.0, 1)}


def test_empty_input(spark):
    empty = _book(spark, [])
    assert tuple(P.raw_profile(empty).first()) == (0, 0, None, 0, None, 0)
    clean = P.clean_table(empty, builtin=True)
    assert clean.count() == 0
    assert P.ratio_buckets(clean).count() == 0
    assert P.concentration(clean).collect()[-1].age_band == "Total"
    assert P.tier_summary(clean).count() == 0
    assert P.watchlist(clean).count() == 0


def test_zero_defaults_give_null_share(spark):
    rows = [(i, 0, 100, 0, 25 + (i % 3) * 20, 0.2, 0.2, 0) for i in range(30)]
    c = P.concentration(_book(spark, rows)).collect()
    assert all(r.default_share_pct is None for r in c[:-1])
    assert [r.concentration_flag for r in c[:-1]] == ["Proportionate"] * 3


def test_verify_counts_bad_rows(spark):
    df = spark.createDataFrame([(None, 1, 0), (2.0, None, 40)], "monthly_income double, dependents bigint, age bigint")
    r = quality.verify(df, ["monthly_income", "dependents"], {"bad_age_rows": F.col("age") == 0}).first()
    assert (r.total_rows, r.monthly_income_nulls, r.dependents_nulls, r.bad_age_rows) == (2, 1, 1, 1)


def test_gap_audit_generic_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.34, 0.35, 0.5, 0.99, 0.995, 1.0, 5.0, 5.5]], "x double")
    edges = (("a", None, False, 0.35, False), ("b", 0.35, True, 0.99, True),
             ("c", 1.0, True, 5.0, True), ("d", 5.0, False, None, False))
    rows = reports.gap_audit(df, "x", edges).collect()
    assert [(r.below_bucket, r.above_bucket, r.gap_low, r.gap_high, r.rows_in_gap) for r in rows] == [
        ("b", "c", 0.99, 1.0, 1)]


def test_segment_rates_skips_empty_segments(spark):
    rows = [(i, i % 2, 100, 0, 40, 0.5, 0.5, 0) for i in range(10)]
    got = segment_rates(_book(spark, rows), RATIO_BUCKETS).collect()
    assert [(r.debt_bucket, r.borrowers, r.defaults, r.default_rate_pct) for r in got] == [("Medium", 10, 5, 50.0)]


def test_approx_median_is_opt_in_and_close(spark):
    df = spark.range(1, 10_001).select(F.col("id").alias("inc"), F.lit(None).cast("bigint").alias("dep"))
    exact = impute.fill_values(df, ["inc"], [], strategy="builtin")["__median_inc"]
    approx = impute.fill_values(df, ["inc"], [], strategy="approx")["__median_inc"]
    assert exact == 5000.5 and abs(approx - exact) <= 10_000 / 10_000 + 1


def test_custom_segmentation_through_generic_reports(spark):
    from loanscope.functions.segments import Segmentation

    rows = [(i, 1 if i % 4 == 0 else 0, 1000 * (i % 10), 0, 40, 0.5, 0.5, 0) for i in range(40)]
    clean = P.clean_table(_book(spark, rows), builtin=True)
    income = Segmentation("income_band", "monthly_income",
                          rules=(("Low", lambda x: x < 3000), ("Middle", lambda x: x < 8000)),
                          default="High")
    got = [(r.income_band, r.borrowers, r.defaults) for r in segment_rates(clean, income).collect()]
    assert got == [("Low", 12, 4), ("Middle", 20, 4), ("High", 8, 2)]
    conc = reports.concentration(clean, income).collect()
    assert [r.income_band for r in conc] == ["Low", "Middle", "High", "Total"]
    assert conc[-1].borrowers == 40 and conc[-1].defaults == 10


@pytest.mark.parametrize("kind,values", [
    ("long", [7] * 400 + list(range(1000, 1600)) + [None] * 50),
    ("long", [7] * 300 + [3] * 300 + [9] * 299),                                   # a tie: the lowest
    ("string", ["b"] * 200 + ["a"] * 200 + [f"x{i}" for i in range(500)]),
    ("double", [0.0] * 150 + [-0.0] * 150 + [float("nan")] * 250 + [1.5] * 200),     # zeros are one value
    ("double", [float("nan")] * 40 + [2.0] * 10),
    ("long", list(range(500))),                                                     # no frequent value: all are counted
    ("date", None), ("boolean", [True, False, False, None]), ("long", [None, None]), ("long", []),
    ("array<long>", [[1], [1], [2]]),                                               # no summary of this type
])
def test_mode_value_equals_counting_all(spark, kind, values):
    import datetime

    if values is None:
        values = [datetime.date(2020, 1, 1 + i % 9 % 5) for i in range(90)]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(5)
    want = impute.mode_frame(df, "x", "m").first().m
    for counters in (10_000, 8):
        got = impute.mode_value(df, "x", counters=counters)
        assert got == want or (got != got and want != want)


def test_frequent_values_are_proven_or_counted(spark):
    # 100 values of one frequency fill the list of candidates: the bound then is theirs, and nothing is proven
    df = spark.range(10_000).selectExpr("id % 100 as x")
    values, bound = impute.frequent_values(df, "x")
    assert len(values) == impute.CANDIDATES and bound >= 100 and impute.mode_value(df, "x") == 0
    hot = spark.range(10_000).selectExpr("case when id % 4 = 0 then 5 else id end as x")
    values, bound = impute.frequent_values(hot, "x")
    assert 5 in values and bound < 2500 and impute.mode_value(hot, "x") == 5


def test_joined_statistics_are_selected(spark):
    df = spark.range(2000).selectExpr("id", "case when id % 9 = 0 then null else id * 37 % 1009 end as inc", "id % 3 as dep", "30 as age")
    joined = impute.impute(df, ["inc"], ["dep"], attach="join", max_candidates=50)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "median" not in plan.lower() and "percentile" not in plan.lower()
    plain = impute.impute(df, ["inc"], ["dep"], strategy="builtin")
    assert joined.exceptAll(plain).count() == 0 and joined.count() == 2000

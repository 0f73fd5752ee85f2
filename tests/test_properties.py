"""Properties of the reports on random loan books (hypothesis) and plan checks."""

import pytest
from conftest import have, sf_dir
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanscope.plans import portfolio as P
from loanscope.sources.fixture import read_loan_book
from loanscope.sources.loanbook import RAW_SCHEMA

row = st.tuples(
    st.integers(0, 1),                                          # default flag
    st.one_of(st.none(), st.integers(0, 20_000)),               # income
    st.one_of(st.none(), st.integers(0, 4)),                    # dependents
    st.one_of(st.just(0), st.integers(18, 95)),                 # age (0 = invalid)
    st.one_of(st.none(), st.sampled_from([0.0, 0.35, 0.99, 1.0, 5.0, 7.5]),
              st.floats(0, 10, allow_nan=False)),               # debt ratio
    st.one_of(st.none(), st.sampled_from([0.0, 2.0, 3.5]), st.floats(0, 4, allow_nan=False)),
    st.integers(0, 3),                                          # 90 days late
)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _book(spark, rows):
    full = [(i, f, inc, dep, age, r, u, 0, l90, 0, 0, 0) for i, (f, inc, dep, age, r, u, l90) in enumerate(rows)]
    return spark.createDataFrame(full, RAW_SCHEMA)


@SETTINGS
@given(st.lists(row, min_size=1, max_size=60))
def test_report_properties(spark, rows):
    raw = _book(spark, rows)
    clean = P.clean_table(raw, builtin=True)
    kept = [r for r in rows if r[3] != 0]
    assert clean.count() == len(kept)
    # imputation leaves non-NULL values untouched
    got = {r.loan_id: (r.monthly_income, r.dependents) for r in clean.collect()}
    for i, r in enumerate(rows):
        if r[3] != 0:
            if r[1] is not None:
                assert got[i][0] == float(r[1])
            if r[2] is not None:
                assert got[i][1] == r[2]
    if not kept:
        return
    # tier sizes differ by at most one, larger tiers first; both paths agree
    a = P.tier_summary(clean, builtin=True).collect()
    b = P.tier_summary(clean, fanout=4, max_candidates=3, per_cut=2).collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
    sizes = [x.borrowers for x in a]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert sum(sizes) == len(kept)
    # concentration: Total row is the sum; shares sum to 100 within rounding
    conc = P.concentration(clean).collect()
    total = conc[-1]
    assert total.age_band == "Total"
    assert total.borrowers == sum(x.borrowers for x in conc[:-1])
    assert total.defaults == sum(x.defaults for x in conc[:-1])
    assert abs(sum(x.borrower_share_pct for x in conc[:-1]) - 100.0) <= 0.005 * len(conc) + 1e-9
    if total.defaults:
        gaps = P.concentration_gap(clean).collect()
        assert abs(sum(x.gap_points for x in gaps)) <= 0.01 * len(gaps) + 1e-9
    # watch list: both paths agree
    w1 = P.watchlist(clean, builtin=True, ordered=False)
    w2 = P.watchlist(clean, ordered=False, rows_per_bucket=2, fan=16, per_cut=4)
    assert w1.exceptAll(w2).count() == 0 and w2.exceptAll(w1).count() == 0


@pytest.mark.skipif(not have("0.001"), reason="no sf0.001")
def test_plans_of_reports(spark):
    from loanscope.plans.staging import staged_clean

    clean = staged_clean(spark, sf_dir("0.001"))
    top = P.tier_top(clean)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "WindowGroupLimit" in plan     # the window is over counted (tier, value) pairs
    plan = P.tier_top(clean, builtin=True)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    summary = P.tier_summary(clean)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    watch = P.watchlist(clean, ordered=False, rows_per_bucket=5, fan=16)
    plan = watch._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Join" not in plan
    clean_fresh = P.clean_table(read_loan_book(spark, sf_dir("0.001")))
    plan = clean_fresh._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan      # fill values attached as literals
    conc = P.concentration(clean)
    plan = conc._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()              # sort_small: no sampling job
    conc.collect()
    assert "ReusedExchange" in conc._jdf.queryExecution().executedPlan().toString()  # Total row
    assert "PushedFilters" in P.watch_population(clean)._jdf.queryExecution().executedPlan().toString()
    assert clean.filter(F.col("late_90") >= 1).count() > 0

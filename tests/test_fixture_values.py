"""Expected values of the loan-book fixture (FIXTURES.md section 4)."""

import pytest
from conftest import have, sf_dir
from pyspark.sql import functions as F

from loanscope.operators.imputation import fill_values
from loanscope.plans import portfolio as P
from loanscope.sources.fixture import read_loan_book

SCALES = [s for s in ("0.001", "0.01", "0.1") if have(s)]

PROFILE = {"0.001": (1500, 300, 20.0, 40, 2.67, 2), "0.01": (15000, 3000, 20.0, 395, 2.63, 15),
           "0.1": (150000, 30000, 20.0, 3948, 2.63, 149)}
MEDIAN = {"0.001": 6398.5, "0.01": 6284.5, "0.1": 6245.0}
VERIFY = {"0.001": (1498, 6323.91, 35.0, 12492.0), "0.01": (14985, 6268.43, 25.0, 12499.0),
          "0.1": (149851, 6250.53, 25.0, 12499.0)}
UTIL_NULLS = {"0.001": 2, "0.01": 14, "0.1": 138}
TOP_ROWS = {"0.001": 15, "0.01": 20, "0.1": 70}
GAP = {"0.001": 12, "0.01": 82, "0.1": 810}
BUCKETS = {
    "0.001": {"Low": (285, 25, 8.77), "Medium": (521, 61, 11.71), "High": (625, 46, 7.36),
              "Extreme/Artifact": (66, 5, 7.58), "Unknown": (1, 0, 0.0)},
    "0.01": {"Low": (2773, 272, 9.81), "Medium": (5216, 469, 8.99), "High": (6335, 626, 9.88),
             "Extreme/Artifact": (651, 44, 6.76), "Unknown": (10, 2, 20.0)},
    "0.1": {"Low": (28051, 2659, 9.48), "Medium": (52250, 4894, 9.37), "High": (62939, 5971, 9.49),
            "Extreme/Artifact": (6511, 615, 9.45), "Unknown": (100, 7, 7.0)},
}
TIERS = {
    "0.001": [(300, 0.0806, 22, 7.33), (300, 0.4830, 33, 11.00), (300, 0.9585, 34, 11.33),
              (299, 1.4119, 19, 6.35), (299, 1.8552, 29, 9.70)],
    "0.01": [(2997, 0.0872, 297, 9.91), (2997, 0.5058, 288, 9.61), (2997, 0.9613, 249, 8.31),
             (2997, 1.4094, 301, 10.04), (2997, 1.8510, 278, 9.28)],
    "0.1": [(29971, 0.0872, 2813, 9.39), (29970, 0.5043, 2803, 9.35), (29970, 0.9560, 2886, 9.63),
            (29970, 1.4091, 2850, 9.51), (29970, 1.8530, 2794, 9.32)],
}
WATCH = {  # band: rows, sum rank, sum next ids, rows without peer, distinct ranks, max ratio
    "0.001": {"Young": (12, 78, 7974, 1, 12, 1.6068094666666668), "Mid-Career": (22, 253, 15912, 1, 22, 1.6355233),
              "Senior": (19, 190, 14040, 1, 19, 4.0), "Retired": (24, 299, 16218, 1, 23, 4.0)},
    "0.01": {"Young": (107, 5768, 857214, 1, 103, 4.0), "Mid-Career": (203, 20700, 1483110, 1, 200, 4.0),
             "Senior": (225, 25419, 1688940, 1, 222, 4.0), "Retired": (234, 27429, 1720026, 1, 223, 4.0)},
    "0.1": {"Young": (964, 464724, 72469764, 1, 936, 4.0), "Mid-Career": (2194, 2405835, 164179638, 1, 2130, 4.0),
            "Senior": (2210, 2439585, 165518568, 1, 2126, 4.0), "Retired": (2316, 2680671, 174118572, 1, 2247, 4.0)},
}


@pytest.fixture(scope="module")
def books(spark):
    out = {}
    for s in SCALES:
        raw = read_loan_book(spark, sf_dir(s))
        out[s] = (raw, P.clean_table(raw))
    return out


@pytest.mark.parametrize("sf", SCALES)
def test_profile(books, sf):
    raw, _ = books[sf]
    r = P.raw_profile(raw).first()
    assert tuple(r) == PROFILE[sf]


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("strategy", ["builtin", "select"])
def test_median_from_raw_rows(books, sf, strategy):
    raw, _ = books[sf]
    stats = fill_values(raw, ["monthly_income"], ["dependents"], strategy=strategy,
                        fanout=16, max_candidates=200)
    assert stats["__median_monthly_income"] == MEDIAN[sf]
    assert stats["__mode_dependents"] == 0


@pytest.mark.parametrize("sf", SCALES)
def test_verify(books, sf):
    _, clean = books[sf]
    r = P.clean_verify(clean).first()
    assert (r.total_rows, r.avg_income, r.min_income, r.max_income) == VERIFY[sf]
    assert (r.monthly_income_nulls, r.dependents_nulls, r.bad_age_rows) == (0, 0, 0)


@pytest.mark.parametrize("sf", SCALES)
def test_utilization_nulls_and_top_rows(books, sf):
    raw, clean = books[sf]
    assert raw.filter(F.col("utilization").isNull()).count() == UTIL_NULLS[sf]
    assert P.tier_top(clean).count() == TOP_ROWS[sf]
    a = P.tier_top(clean, builtin=True)
    b = P.tier_top(clean, fanout=16, max_candidates=300)
    assert b.count() == TOP_ROWS[sf] and a.exceptAll(b).count() == 0
    t1 = P.top_nondefault(clean, builtin=True).collect()
    t2 = P.top_nondefault(clean).collect()
    assert sorted(map(tuple, t1)) == sorted(map(tuple, t2))


@pytest.mark.parametrize("sf", SCALES)
def test_gap_audit_and_cap_effect(books, sf):
    _, clean = books[sf]
    assert P.gap_audit(clean).first().rows_in_gap == GAP[sf]
    assert P.cap_effect(clean).first().tier_changes == 0
    assert P.cap_effect(clean, fanout=16, max_candidates=300).first().tier_changes == 0


@pytest.mark.parametrize("sf", SCALES)
def test_ratio_buckets(books, sf):
    _, clean = books[sf]
    rows = P.ratio_buckets(clean).collect()
    assert [r.debt_bucket for r in rows] == ["Low", "Medium", "High", "Extreme/Artifact", "Unknown"]
    got = {r.debt_bucket: (r.borrowers, r.defaults, r.default_rate_pct) for r in rows}
    assert got == BUCKETS[sf]


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("builtin", [True, False])
def test_tier_summary(books, sf, builtin):
    _, clean = books[sf]
    rows = P.tier_summary(clean, builtin=builtin, fanout=32, max_candidates=500).collect()
    assert [r.risk_tier for r in rows] == [1, 2, 3, 4, 5]
    assert [(r.borrowers, r.avg_utilization, r.defaults, r.default_rate_pct) for r in rows] == TIERS[sf]


@pytest.mark.skipif(not have("0.01"), reason="no sf0.01")
def test_trend_and_concentration_sf001(books):
    _, clean = books["0.01"]
    t = P.cohort_trend(clean).collect()
    assert [(r.age_band, r.borrowers, r.defaults, r.default_rate_pct, r.prev_defaults,
             r.defaults_change, r.rate_change, r.trend) for r in t] == [
        ("Young", 2042, 262, 12.83, None, None, None, "Baseline"),
        ("Mid-Career", 4427, 598, 13.51, 262, 336, 0.68, "Worsening"),
        ("Senior", 4103, 266, 6.48, 598, -332, -7.03, "Improving"),
        ("Retired", 4413, 287, 6.50, 266, 21, 0.02, "Worsening"),
    ]
    c = P.concentration(clean).collect()
    assert [(r.age_band, r.borrowers, r.defaults, r.borrower_share_pct, r.default_share_pct,
             r.concentration_flag) for r in c] == [
        ("Young", 2042, 262, 13.63, 18.54, "Proportionate"),
        ("Mid-Career", 4427, 598, 29.54, 42.32, "Overrepresented"),
        ("Senior", 4103, 266, 27.38, 18.83, "Underrepresented"),
        ("Retired", 4413, 287, 29.45, 20.31, "Underrepresented"),
        ("Total", 14985, 1413, 100.0, 100.0, "N/A"),
    ]


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("builtin", [True, False])
def test_watchlist_per_band(books, sf, builtin):
    _, clean = books[sf]
    w = P.watchlist(clean, builtin=builtin, ordered=False, rows_per_bucket=25, fan=12, per_cut=8)
    agg = (w.groupBy("age_band")
           .agg(F.count(F.lit(1)), F.sum("debt_rank"), F.sum("next_loan_id"),
                F.count(F.when(F.col("next_loan_id").isNull(), 1)), F.countDistinct("debt_rank"),
                F.max("debt_ratio"))
           .collect())
    got = {r[0]: tuple(r[1:]) for r in agg}
    assert got == WATCH[sf]

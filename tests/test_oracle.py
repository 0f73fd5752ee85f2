"""The driver's correctness gate, replayed: every catalog query against its
DuckDB statement (row count, column names, order-insensitive values)."""

import math

import duckdb
import pytest
from conftest import have, sf_dir

import __spark_entry__ as E
from loanscope.plans import catalog

SF = "0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def _canon(rows, cols):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in idx) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir(SF)}/{t}.parquet')")
    return c


def test_every_report_has_an_oracle():
    assert set(catalog.queries()) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not have(SF), reason="no sf0.001")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, sf_dir(SF))
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _canon(srows, df.columns) == _canon(orows, ocols)


@pytest.mark.skipif(not have(SF), reason="no sf0.001")
def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r.age_band for r in rows] == ["Young", "Mid-Career", "Senior", "Retired", "Total"]


@pytest.mark.skipif(not have(SF), reason="no sf0.001")
def test_builtin_forms_match_too(spark, con):
    for name, fn in catalog.queries(builtin=True).items():
        df = fn(spark, sf_dir(SF))
        res = con.execute(E.oracle_sql()[name])
        ocols = [d[0] for d in res.description]
        assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(res.fetchall(), ocols), name


@pytest.mark.skipif(not have("0.01"), reason="no sf0.01")
def test_registered_reports_run_the_scale_plan(spark):
    # analysed, not optimised: where a table is one bucket, the bucket's number is a constant that folds away
    plans = {n: catalog.queries()[n](spark, sf_dir("0.01"))._jdf.queryExecution().analyzed().toString()
             for n in ("watchlist", "mart_borrower", "ranked_peers", "tier_summary", "tier_top", "mart_risk")}
    for name in ("watchlist", "mart_borrower", "ranked_peers"):
        assert "__bucket" in plans[name] and "__run" in plans[name], name
    for name in ("tier_summary", "tier_top", "mart_risk", "mart_borrower"):
        assert "ntile" not in plans[name].lower() and "CASE WHEN" in plans[name], name
    assert "__cut" in plans["tier_top"]

"""End-to-end process on the sf0.001 loan book and on a CSV through the CLI."""

import tempfile

import pytest
from conftest import have, sf_dir

from loanscope.plans.process import run_process
from loanscope.sources.fixture import read_loan_book


@pytest.mark.skipif(not have("0.001"), reason="no sf0.001")
def test_run_process(spark):
    out_dir = tempfile.mkdtemp(prefix="loanscope-proc-")
    paths = run_process(spark, read_loan_book(spark, sf_dir("0.001")), out_dir)
    read = lambda k: spark.read.parquet(paths[k])
    assert read("profile").first().total_rows == 1500
    assert read("clean").count() == 1498
    v = read("clean_verify").first()
    assert (v.monthly_income_nulls, v.dependents_nulls, v.bad_age_rows) == (0, 0, 0)
    assert read("tier_top").count() == 15
    assert read("concentration").count() == 5
    assert read("watchlist").count() == 77
    assert read("mart_borrower").count() == 77
    assert set(r.age_band for r in read("watchlist").select("age_band").distinct().collect()) == {
        "Young", "Mid-Career", "Senior", "Retired"}


def test_cli_on_csv(spark):
    from loanscope.__main__ import main

    d = tempfile.mkdtemp(prefix="loanscope-cli-")
    header = (",SeriousDlqin2yrs,RevolvingUtilizationOfUnsecuredLines,age,NumberOfTime30-59DaysPastDueNotWorse,"
              "DebtRatio,MonthlyIncome,NumberOfOpenCreditLinesAndLoans,NumberOfTimes90DaysLate,"
              "NumberRealEstateLoansOrLines,NumberOfTime60-89DaysPastDueNotWorse,NumberOfDependents")
    with open(f"{d}/cs.csv", "w") as fh:
        fh.write(header + "\n")
        for i in range(1, 41):
            inc = "NA" if i % 5 == 0 else str(1000 + 37 * i)
            dep = "NA" if i % 7 == 0 else str(i % 3)
            fh.write(f"{i},{i % 4 == 0 and 1 or 0},{(i % 9) / 4},{20 + i % 60},0,{(i % 11) / 5},{inc},3,"
                     f"{i % 3},1,0,{dep}\n")
    main(["--csv", f"{d}/cs.csv", "--out", f"{d}/out"])
    assert spark.read.parquet(f"{d}/out/clean").count() == 40
    assert spark.read.parquet(f"{d}/out/concentration").count() >= 2
    main(["--parquet", f"{d}/out/raw", "--out", f"{d}/out_scale"])
    a = spark.read.parquet(f"{d}/out/tier_top")
    b = spark.read.parquet(f"{d}/out_scale/tier_top")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    w1 = spark.read.parquet(f"{d}/out/watchlist")
    w2 = spark.read.parquet(f"{d}/out_scale/watchlist")
    assert w1.count() == w2.count() and w1.exceptAll(w2).count() == 0

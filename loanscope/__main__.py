"""Command line: ``python -m loanscope --csv <files> --out <folder>`` (or ``--parquet``).

Runs the whole process (profile, clean table, verification, reports, marts)
on a raw loan book and prints where each table was written.
"""

from __future__ import annotations

import argparse
import json

from loanscope.plans.process import run_process
from loanscope.session import get_session
from loanscope.sources.loanbook import read_loan_csv, read_table


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="loanscope")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", nargs="+", help="raw loan-book CSV file(s) with a header row")
    src.add_argument("--parquet", help="raw loan book already in Parquet (our column names)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--mode", default="overwrite", help="write mode for every table")
    ap.add_argument("--master", default=None, help="Spark master, e.g. local[8]; else what spark-submit or the defaults say")
    args = ap.parse_args(argv)
    spark = get_session(master=args.master)
    raw = read_loan_csv(spark, args.csv) if args.csv else read_table(spark, args.parquet)
    print(json.dumps(run_process(spark, raw, args.out, mode=args.mode), indent=1))


if __name__ == "__main__":
    main()

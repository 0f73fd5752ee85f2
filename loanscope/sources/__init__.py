"""Readers and writers: the raw loan book (CSV or Parquet), the clean table,
and the derived loan-book fixture used by the tests, bench and oracles."""

from loanscope.sources.loanbook import (
    CLEAN_COLUMNS,
    RAW_SCHEMA,
    header_census,
    read_loan_csv,
    read_table,
)
from loanscope.sources.fixture import loan_book_from_orders, loan_book_sql
from loanscope.sources.sinks import (
    clustered_files,
    publish,
    published,
    published_versions,
    read_clustered,
    remove_old_versions,
    write_clustered,
    write_table,
)

__all__ = [
    "CLEAN_COLUMNS",
    "RAW_SCHEMA",
    "clustered_files",
    "header_census",
    "publish",
    "published",
    "published_versions",
    "read_clustered",
    "read_loan_csv",
    "read_table",
    "remove_old_versions",
    "loan_book_from_orders",
    "loan_book_sql",
    "write_clustered",
    "write_table",
]

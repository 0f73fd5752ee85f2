"""The loan book: schema, CSV ingest and table/Parquet scans.

Column names are our own; ``CSV_HEADER_NAMES`` maps the public data set's
header names onto them once, at ingest, so every later step uses one name
per column (the raw export names its row id column with an empty header).
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Clean-table column order: id, flag, the two imputed columns, then the rest.
CLEAN_COLUMNS = [
    "loan_id",
    "default_flag",
    "monthly_income",
    "dependents",
    "age",
    "debt_ratio",
    "utilization",
    "open_lines",
    "late_90",
    "real_estate_lines",
    "late_60_89",
    "late_30_59",
]

RAW_SCHEMA = T.StructType([
    T.StructField("loan_id", T.LongType(), False),
    T.StructField("default_flag", T.IntegerType(), True),
    T.StructField("monthly_income", T.LongType(), True),
    T.StructField("dependents", T.LongType(), True),
    T.StructField("age", T.LongType(), True),
    T.StructField("debt_ratio", T.DoubleType(), True),
    T.StructField("utilization", T.DoubleType(), True),
    T.StructField("open_lines", T.LongType(), True),
    T.StructField("late_90", T.LongType(), True),
    T.StructField("real_estate_lines", T.LongType(), True),
    T.StructField("late_60_89", T.IntegerType(), True),
    T.StructField("late_30_59", T.IntegerType(), True),
])

# Header names of the public credit data set (hyphens or
# underscores both occur after import), mapped to our column names.
CSV_HEADER_NAMES = {
    "": "loan_id",
    "_c0": "loan_id",
    "column1": "loan_id",
    "id": "loan_id",
    "SeriousDlqin2yrs": "default_flag",
    "RevolvingUtilizationOfUnsecuredLines": "utilization",
    "age": "age",
    "NumberOfTime30-59DaysPastDueNotWorse": "late_30_59",
    "DebtRatio": "debt_ratio",
    "MonthlyIncome": "monthly_income",
    "NumberOfOpenCreditLinesAndLoans": "open_lines",
    "NumberOfTimes90DaysLate": "late_90",
    "NumberRealEstateLoansOrLines": "real_estate_lines",
    "NumberOfTime60-89DaysPastDueNotWorse": "late_60_89",
    "NumberOfDependents": "dependents",
}


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


_BY_NORM = {_norm(k): v for k, v in CSV_HEADER_NAMES.items()}


def header_census(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header, from one job whatever the number of files; files without a line are left out.

    Every file's first line is the first row of its first block: a partial minimum by file, so tasks hand on one line
    a file.  Paths may be files, folders or patterns; Spark lists and reads them.
    """
    lines = spark.read.text(paths).filter("_metadata.file_block_start = 0")
    # Rows of a block are read in order by one task, so the number rises along the file.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))      # as a URI; a plus is a plus
    numbered = lines.select(path.alias("file"), "value", F.monotonically_increasing_id().alias("row"))
    first = numbered.groupBy("file").agg(F.min_by("value", "row").alias("line"))
    by_line = first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(by_line.collect(), key=lambda r: r["files"][0]):
        header = tuple(name.strip() for name in next(csv.reader([row["line"]]), []))
        found.setdefault(header, []).extend(row["files"])
    return found


def _read_with_header(spark: SparkSession, files: list[str], header: tuple[str, ...], null_value: str) -> DataFrame:
    by_name = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    fields, chosen = [], {}
    for i, h in enumerate(header):
        target = _BY_NORM.get(_norm(h))
        if target is not None and target not in chosen:
            chosen[target] = f"c{i}"
            fields.append(T.StructField(f"c{i}", by_name[target], True))
        else:
            fields.append(T.StructField(f"c{i}", T.StringType(), True))
    missing = [f.name for f in RAW_SCHEMA.fields if f.name not in chosen]
    if missing:
        raise ValueError(f"loan-book CSV {files[0]} lacks columns for {missing}; header was {list(header)}")
    raw = (spark.read.schema(T.StructType(fields))
           .option("header", True)
           .option("enforceSchema", True)
           .option("nullValue", null_value)
           .option("mode", "FAILFAST")
           .csv(files))
    return raw.select([F.col(chosen[f.name]).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


def read_loan_csv(spark: SparkSession, path: str | list[str], *,
                  null_value: str = "NA") -> DataFrame:
    """Read raw loan-book CSV files into ``RAW_SCHEMA``.

    Columns are matched by header name, not position, for every file: one job
    finds the header lines of all files (``header_census``), files with the same
    header are read together by a typed schema laid out in their column order,
    and the parts are put together by name - no inference pass and no string
    columns to cast afterwards.  Malformed values fail the job (FAILFAST)
    instead of turning silently into NULL; empty files are skipped.
    """
    paths = [path] if isinstance(path, str) else list(path)
    parts = [_read_with_header(spark, files, header, null_value) for header, files in header_census(spark, paths).items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RAW_SCHEMA)


def read_table(spark: SparkSession, source: str, *, fmt: str = "parquet") -> DataFrame:
    """Scan a loan-book table: a catalog table name or a Parquet/ORC path."""
    if "/" in source or source.endswith(".parquet"):
        return spark.read.format(fmt).load(source)
    return spark.table(source)

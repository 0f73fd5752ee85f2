"""Loan-book fixture derived from the driver's ``orders`` table.

The driver tables hold no NULLs, ties or artifacts, which every portfolio
query needs, so one loan is derived from each order with integer arithmetic
and one double division (Spark and DuckDB agree bit for bit).  The frame is a
pure projection of ``orders``: it grows with the table, keeps the Parquet scan
column-pruned, and costs no shuffle.

``loan_book_sql`` is the same rule set as SQL text; DuckDB oracles inline it
as a CTE because only the driver's own tables are registered there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def loan_book_from_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    p = F.col("o_totalprice")
    status = F.col("o_orderstatus")
    prio = F.col("o_orderpriority")
    flag = (status == "F") & ((prio == "1-URGENT") | ((prio == "2-HIGH") & (c % 70 < 29)))
    null_double = F.lit(None).cast("double")
    return orders.select(
        k.alias("loan_id"),
        F.when(flag, 1).otherwise(0).cast("int").alias("default_flag"),
        F.when(k % 5 == 2, F.lit(None).cast("bigint"))
         .otherwise(F.floor(p / 40)).cast("bigint").alias("monthly_income"),
        F.when(k % 38 == 1, F.lit(None).cast("bigint"))
         .when(k % 10 < 6, F.lit(0))
         .when(k % 10 < 8, F.lit(1))
         .otherwise(c % 4 + 2).cast("bigint").alias("dependents"),
        F.when(k % 1009 == 8, F.lit(0)).otherwise(c % 70 + 21).cast("bigint").alias("age"),
        F.when(k % 1511 == 3, null_double)
         .when(k % 23 == 4, p)
         .when(k % 29 == 5, F.lit(5.0))
         .when(k % 31 == 6, F.lit(4.0))
         .otherwise(p / 300000).alias("debt_ratio"),
        F.when(k % 13 == 0, F.lit(0.0))
         .when(k % 1013 == 12, null_double)
         .when(k % 2500 == 17, F.lit(600000.0))
         .when(k % 601 == 9, p)
         .otherwise(p / 240000).alias("utilization"),
        (c % 9).cast("bigint").alias("open_lines"),
        F.when(k % 18 == 0, c % 4 + 1).otherwise(0).cast("bigint").alias("late_90"),
        (c % 3).cast("bigint").alias("real_estate_lines"),
        F.when(k % 20 == 0, 1).otherwise(0).cast("int").alias("late_60_89"),
        F.when(k % 7 == 0, 1).otherwise(0).cast("int").alias("late_30_59"),
    )


def read_loan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan book for a driver scale-factor folder."""
    return loan_book_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def loan_book_sql(name: str = "loans_raw") -> str:
    """The fixture as a CTE body ``name AS (...)`` for DuckDB oracles."""
    return f"""{name} AS (
  SELECT
    o_orderkey AS loan_id,
    CAST(CASE WHEN o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT'
              OR (o_orderpriority = '2-HIGH' AND o_custkey % 70 < 29)) THEN 1 ELSE 0 END AS INTEGER) AS default_flag,
    CAST(CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE floor(o_totalprice / 40) END AS BIGINT) AS monthly_income,
    CAST(CASE WHEN o_orderkey % 38 = 1 THEN NULL WHEN o_orderkey % 10 < 6 THEN 0
              WHEN o_orderkey % 10 < 8 THEN 1 ELSE 2 + o_custkey % 4 END AS BIGINT) AS dependents,
    CAST(CASE WHEN o_orderkey % 1009 = 8 THEN 0 ELSE 21 + o_custkey % 70 END AS BIGINT) AS age,
    CAST(CASE WHEN o_orderkey % 1511 = 3 THEN NULL WHEN o_orderkey % 23 = 4 THEN o_totalprice
              WHEN o_orderkey % 29 = 5 THEN 5.0 WHEN o_orderkey % 31 = 6 THEN 4.0
              ELSE o_totalprice / 300000 END AS DOUBLE) AS debt_ratio,
    CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 1013 = 12 THEN NULL
              WHEN o_orderkey % 2500 = 17 THEN 600000.0 WHEN o_orderkey % 601 = 9 THEN o_totalprice
              ELSE o_totalprice / 240000 END AS DOUBLE) AS utilization,
    CAST(o_custkey % 9 AS BIGINT) AS open_lines,
    CAST(CASE WHEN o_orderkey % 18 = 0 THEN 1 + o_custkey % 4 ELSE 0 END AS BIGINT) AS late_90,
    CAST(o_custkey % 3 AS BIGINT) AS real_estate_lines,
    CAST(CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS INTEGER) AS late_60_89,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS late_30_59
  FROM orders
)"""

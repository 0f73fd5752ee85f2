"""Independent DuckDB statements for every catalog query.

Each statement inlines the loan-book fixture as a CTE (only the driver's own
tables are registered in DuckDB) and then states the report with plain SQL
window functions and aggregates - NTILE, RANK, LEAD, median - so the oracle
and the Spark scale paths share no method.

Percentages are rounded half-up in exact integer arithmetic:
ROUND(n * 100.0 / d, 2) = ((20000 n + d) DIV (2 d)) / 100 for n, d >= 0,
the value Spark computes in DECIMAL.  Explicit NULLS FIRST/LAST everywhere,
since DuckDB's default NULL order differs from Spark's.
"""

from __future__ import annotations

from loanscope.sources.fixture import loan_book_sql


def _h(n: str, d: str) -> str:
    """Hundredths of n*100/d, rounded half-up (NULL when d = 0)."""
    return f"(CASE WHEN ({d}) = 0 THEN NULL ELSE (({n}) * 20000 + ({d})) // (2 * ({d})) END)"


def _pct(n: str, d: str) -> str:
    return f"CAST({_h(n, d)} AS DOUBLE) / 100"


# The report labels and edges of the two segmentations, their report
# order, and the utilization cap, as SQL text.
AGE_BAND = ("CASE WHEN age < 30 THEN 'Young' WHEN age BETWEEN 30 AND 49 THEN 'Mid-Career' "
            "WHEN age BETWEEN 50 AND 69 THEN 'Senior' ELSE 'Retired' END")
AGE_ORDER = ("CAST(CASE age_band WHEN 'Young' THEN 1 WHEN 'Mid-Career' THEN 2 WHEN 'Senior' THEN 3 "
             "WHEN 'Retired' THEN 4 END AS BIGINT)")
RATIO_BUCKET = ("CASE WHEN debt_ratio < 0.35 THEN 'Low' "
                "WHEN debt_ratio >= 0.35 AND debt_ratio < 1.00 THEN 'Medium' "
                "WHEN debt_ratio >= 1.00 AND debt_ratio <= 5.00 THEN 'High' "
                "WHEN debt_ratio > 5.00 THEN 'Extreme/Artifact' ELSE 'Unknown' END")
RATIO_ORDER = ("CAST(CASE debt_bucket WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 "
               "WHEN 'Extreme/Artifact' THEN 4 WHEN 'Unknown' THEN 5 END AS BIGINT)")
CAPPED = "CASE WHEN utilization > 2.0 THEN CAST(2.0 AS DOUBLE) ELSE utilization END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((loan_book_sql("loans_raw"),) + ctes) + "\n"


CLEAN = """fill AS (
  SELECT quantile_cont(CAST(monthly_income AS DOUBLE), 0.5) AS med FROM loans_raw
),
mode_dep AS (
  SELECT dependents AS mode_v FROM loans_raw WHERE dependents IS NOT NULL
  GROUP BY dependents ORDER BY count(*) DESC, dependents ASC LIMIT 1
),
clean AS (
  SELECT r.loan_id, r.default_flag,
         COALESCE(CAST(r.monthly_income AS DOUBLE), f.med) AS monthly_income,
         COALESCE(r.dependents, m.mode_v) AS dependents,
         r.age, r.debt_ratio, r.utilization, r.open_lines, r.late_90,
         r.real_estate_lines, r.late_60_89, r.late_30_59
  FROM loans_raw r CROSS JOIN fill f CROSS JOIN mode_dep m
  WHERE r.age <> 0
)"""

BAND_AGG = f"""band_agg AS (
  SELECT age_band, {AGE_ORDER} AS age_band_order, CAST(count(*) AS BIGINT) AS borrowers,
         CAST(sum(CASE WHEN default_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS defaults
  FROM (SELECT {AGE_BAND} AS age_band, default_flag FROM clean) b
  GROUP BY age_band
)"""

TREND = f"""trend AS (
  SELECT *, lag(defaults) OVER (ORDER BY age_band_order) AS prev_defaults,
         lag(rate_h) OVER (ORDER BY age_band_order) AS prev_h
  FROM (SELECT *, {_h('defaults', 'borrowers')} AS rate_h FROM band_agg) r
)"""

TREND_SELECT = """SELECT age_band, age_band_order, borrowers, defaults,
       CAST(rate_h AS DOUBLE) / 100 AS default_rate_pct,
       CAST(prev_defaults AS BIGINT) AS prev_defaults,
       CAST(prev_h AS DOUBLE) / 100 AS prev_rate_pct,
       CAST(defaults - prev_defaults AS BIGINT) AS defaults_change,
       CAST(rate_h - prev_h AS DOUBLE) / 100 AS rate_change,
       CASE WHEN prev_defaults IS NULL THEN 'Baseline'
            WHEN defaults - prev_defaults < 0 THEN 'Improving'
            WHEN defaults - prev_defaults > 0 THEN 'Worsening'
            ELSE 'No Change' END AS trend
FROM trend"""

CONCENTRATION = f"""shares AS (
  SELECT *, {_h('borrowers', 'sum(borrowers) OVER ()')} AS b_h,
            {_h('defaults', 'sum(defaults) OVER ()')} AS d_h
  FROM band_agg
),
conc AS (
  SELECT age_band, age_band_order, borrowers, CAST(b_h AS DOUBLE) / 100 AS borrower_share_pct,
         defaults, CAST(d_h AS DOUBLE) / 100 AS default_share_pct,
         CASE WHEN d_h - b_h > 500 THEN 'Overrepresented'
              WHEN d_h - b_h < -500 THEN 'Underrepresented'
              ELSE 'Proportionate' END AS concentration_flag
  FROM shares
  UNION ALL
  SELECT 'Total', CAST(5 AS BIGINT), CAST(sum(borrowers) AS BIGINT), CAST(100.0 AS DOUBLE),
         CAST(sum(defaults) AS BIGINT), CAST(100.0 AS DOUBLE), 'N/A'
  FROM band_agg
)"""

TIERS = f"""capped AS (
  SELECT loan_id, utilization, default_flag, {CAPPED} AS utilization_capped FROM clean
),
tiers AS (
  SELECT *, CAST(ntile(5) OVER (ORDER BY utilization_capped ASC NULLS FIRST, loan_id ASC) AS BIGINT)
         AS risk_tier
  FROM capped
)"""

TIER_AGG = f"""tier_agg AS (
  SELECT risk_tier, CAST(count(*) AS BIGINT) AS borrowers,
         round(avg(utilization_capped), 4) AS avg_utilization,
         CAST(sum(default_flag) AS BIGINT) AS defaults,
         {_h('sum(default_flag)', 'count(*)')} AS rate_h
  FROM tiers GROUP BY risk_tier
)"""

BUCKET_AGG = f"""bucket_agg AS (
  SELECT debt_bucket, {RATIO_ORDER} AS debt_bucket_order, CAST(count(*) AS BIGINT) AS borrowers,
         CAST(sum(CASE WHEN default_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS defaults
  FROM (SELECT {RATIO_BUCKET} AS debt_bucket, default_flag FROM clean) b
  GROUP BY debt_bucket
)"""

WATCH = f"""pop AS (
  SELECT {AGE_BAND} AS age_band, loan_id, debt_ratio, default_flag
  FROM clean WHERE late_90 >= 1 AND debt_ratio < 5.0
),
watch AS (
  SELECT age_band, loan_id, debt_ratio, default_flag,
         CAST(rank() OVER (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST) AS BIGINT) AS debt_rank,
         lead(loan_id) OVER w AS next_loan_id,
         lead(debt_ratio) OVER w AS next_debt_ratio,
         lead(default_flag) OVER w AS next_default_flag
  FROM pop
  WINDOW w AS (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST, loan_id ASC)
)"""

WATCH_COLS = ("age_band, loan_id, debt_ratio, default_flag, debt_rank, next_loan_id, "
              "next_debt_ratio, next_default_flag")


def _spread(rates: str, label: str, order: str, name: str) -> str:
    return f"""SELECT '{name}' AS segmentation,
       t.seg AS top_segment, CAST(t.rate_h AS DOUBLE) / 100 AS top_rate_pct,
       b.seg AS bottom_segment, CAST(b.rate_h AS DOUBLE) / 100 AS bottom_rate_pct,
       CAST(t.rate_h - b.rate_h AS DOUBLE) / 100 AS spread_points,
       CAST({_h('t.rate_h', 'b.rate_h * 100')} AS DOUBLE) / 100 AS spread_ratio
FROM (SELECT CAST({label} AS VARCHAR) AS seg, rate_h FROM {rates}
      ORDER BY rate_h DESC, {order} ASC LIMIT 1) t,
     (SELECT CAST({label} AS VARCHAR) AS seg, rate_h FROM {rates}
      ORDER BY rate_h ASC, {order} ASC LIMIT 1) b"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["profile"] = _with() + f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) - count(monthly_income) AS BIGINT) AS monthly_income_nulls,
       {_pct('count(*) - count(monthly_income)', 'count(*)')} AS monthly_income_null_pct,
       CAST(count(*) - count(dependents) AS BIGINT) AS dependents_nulls,
       {_pct('count(*) - count(dependents)', 'count(*)')} AS dependents_null_pct,
       CAST(count(CASE WHEN age = 0 THEN 1 END) AS BIGINT) AS bad_age_rows
FROM loans_raw"""
    q["clean_table"] = _with(CLEAN) + "SELECT * FROM clean"
    q["csv_import"] = _with() + "SELECT * FROM loans_raw"
    q["clean_table_joined"] = q["clean_table"]
    q["clean_verify"] = _with(CLEAN) + """SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) - count(monthly_income) AS BIGINT) AS monthly_income_nulls,
       CAST(count(*) - count(dependents) AS BIGINT) AS dependents_nulls,
       CAST(count(CASE WHEN age = 0 THEN 1 END) AS BIGINT) AS bad_age_rows,
       round(avg(monthly_income), 2) AS avg_income,
       min(monthly_income) AS min_income, max(monthly_income) AS max_income
FROM clean"""
    q["ratio_buckets"] = _with(CLEAN, BUCKET_AGG) + f"""SELECT debt_bucket, debt_bucket_order, borrowers,
       defaults, {_pct('defaults', 'borrowers')} AS default_rate_pct
FROM bucket_agg"""
    q["tier_summary"] = _with(CLEAN, TIERS, TIER_AGG) + """SELECT risk_tier, borrowers, avg_utilization,
       defaults, CAST(rate_h AS DOUBLE) / 100 AS default_rate_pct
FROM tier_agg"""
    q["tier_top"] = _with(CLEAN, TIERS) + """SELECT risk_tier, loan_id, raw_utilization, utilization_capped,
       default_flag, util_rank
FROM (SELECT risk_tier, loan_id, utilization AS raw_utilization, utilization_capped, default_flag,
             CAST(dense_rank() OVER (PARTITION BY risk_tier ORDER BY utilization DESC NULLS LAST)
                  AS BIGINT) AS util_rank
      FROM tiers) r
WHERE util_rank <= 3"""
    q["cohort_trend"] = _with(CLEAN, BAND_AGG, TREND) + TREND_SELECT
    q["watchlist"] = _with(CLEAN, WATCH) + f"SELECT {WATCH_COLS} FROM watch"
    q["concentration"] = _with(CLEAN, BAND_AGG, CONCENTRATION) + "SELECT * FROM conc"

    q["headline_rate"] = _with(CLEAN) + f"""SELECT CAST(count(*) AS BIGINT) AS borrowers,
       CAST(sum(default_flag) AS BIGINT) AS defaults,
       {_pct('sum(default_flag)', 'count(*)')} AS default_rate_pct
FROM clean"""
    q["gap_audit"] = _with(CLEAN) + """SELECT 'Medium' AS below_bucket, 'High' AS above_bucket,
       CAST(0.99 AS DOUBLE) AS gap_low, CAST(1.0 AS DOUBLE) AS gap_high,
       CAST(count(CASE WHEN debt_ratio > 0.99 AND debt_ratio < 1.0 THEN 1 END) AS BIGINT) AS rows_in_gap
FROM clean"""
    q["bucket_extremes"] = _with(CLEAN) + f"""SELECT debt_bucket, CAST(count(*) AS BIGINT) AS borrowers,
       min(debt_ratio) AS min_debt_ratio, max(debt_ratio) AS max_debt_ratio,
       {RATIO_ORDER} AS debt_bucket_order
FROM (SELECT {RATIO_BUCKET} AS debt_bucket, debt_ratio FROM clean) b
GROUP BY debt_bucket"""
    q["segment_spread"] = (_with(CLEAN, TIERS, TIER_AGG, BAND_AGG,
                                 f"age_rates AS (SELECT *, {_h('defaults', 'borrowers')} AS rate_h FROM band_agg)")
                           + _spread("tier_agg", "risk_tier", "risk_tier", "risk_tier")
                           + "\nUNION ALL\n"
                           + _spread("age_rates", "age_band", "age_band_order", "age_band"))
    q["concentration_gap"] = _with(CLEAN, BAND_AGG) + f"""SELECT age_band, age_band_order,
       CAST({_h('defaults', 'sum(defaults) OVER ()')} - {_h('borrowers', 'sum(borrowers) OVER ()')}
            AS DOUBLE) / 100 AS gap_points
FROM band_agg"""
    q["impute_effect"] = _with(CLEAN) + """SELECT r.raw_avg_income, c.clean_avg_income,
       round(c.clean_avg_income - r.raw_avg_income, 2) AS avg_shift, r.filled_rows
FROM (SELECT round(avg(CAST(monthly_income AS DOUBLE)), 2) AS raw_avg_income,
             CAST(count(CASE WHEN monthly_income IS NULL AND age <> 0 THEN 1 END) AS BIGINT) AS filled_rows
      FROM loans_raw) r,
     (SELECT round(avg(monthly_income), 2) AS clean_avg_income FROM clean) c"""
    q["tie_audit"] = _with(CLEAN, WATCH) + """SELECT age_band, debt_ratio, CAST(count(*) AS BIGINT) AS tied_rows
FROM pop GROUP BY age_band, debt_ratio HAVING count(*) > 1"""
    q["cap_effect"] = _with(CLEAN) + """SELECT CAST(count(*) AS BIGINT) AS borrowers,
       CAST(count(CASE WHEN a <> b THEN 1 END) AS BIGINT) AS tier_changes
FROM (SELECT ntile(5) OVER (ORDER BY CASE WHEN utilization > 2.0 THEN CAST(2.0 AS DOUBLE)
                                          ELSE utilization END ASC NULLS FIRST, loan_id) AS a,
             ntile(5) OVER (ORDER BY utilization ASC NULLS FIRST, loan_id) AS b
      FROM clean) t"""
    q["top_nondefault"] = _with(CLEAN, WATCH) + f"""SELECT age_band, CAST(count(*) AS BIGINT) AS top_rows,
       CAST(count(CASE WHEN default_flag = 0 THEN 1 END) AS BIGINT) AS non_default_rows,
       {_pct('count(CASE WHEN default_flag = 0 THEN 1 END)', 'count(*)')} AS non_default_pct
FROM watch WHERE debt_rank <= 3 GROUP BY age_band"""
    q["volume_rate_split"] = _with(CLEAN, BAND_AGG, TREND) + """SELECT age_band, age_band_order,
       defaults_change, rate_change, volume_direction, rate_direction,
       CAST(CASE WHEN volume_direction <> 'Baseline' AND volume_direction <> rate_direction
                 THEN 1 ELSE 0 END AS BIGINT) AS diverges
FROM (SELECT age_band, age_band_order,
             CAST(defaults - prev_defaults AS BIGINT) AS defaults_change,
             CAST(rate_h - prev_h AS DOUBLE) / 100 AS rate_change,
             CASE WHEN prev_defaults IS NULL THEN 'Baseline' WHEN defaults < prev_defaults THEN 'Improving'
                  WHEN defaults > prev_defaults THEN 'Worsening' ELSE 'No Change' END AS volume_direction,
             CASE WHEN prev_h IS NULL THEN 'Baseline' WHEN rate_h < prev_h THEN 'Improving'
                  WHEN rate_h > prev_h THEN 'Worsening' ELSE 'No Change' END AS rate_direction
      FROM trend) v"""
    q["mart_executive"] = _with(CLEAN, BAND_AGG, CONCENTRATION) + f"""SELECT c.*,
       h.portfolio_borrowers, h.portfolio_defaults, h.portfolio_rate_pct
FROM conc c CROSS JOIN (
  SELECT CAST(count(*) AS BIGINT) AS portfolio_borrowers, CAST(sum(default_flag) AS BIGINT) AS portfolio_defaults,
         {_pct('sum(default_flag)', 'count(*)')} AS portfolio_rate_pct FROM clean) h"""
    q["mart_risk"] = _with(CLEAN, BUCKET_AGG, TIERS, TIER_AGG) + f"""SELECT 'debt_bucket' AS dimension,
       debt_bucket AS segment, debt_bucket_order AS segment_order, borrowers, defaults,
       {_pct('defaults', 'borrowers')} AS default_rate_pct, CAST(NULL AS DOUBLE) AS avg_utilization
FROM bucket_agg
UNION ALL
SELECT 'risk_tier', CAST(risk_tier AS VARCHAR), risk_tier, borrowers, defaults,
       CAST(rate_h AS DOUBLE) / 100, avg_utilization
FROM tier_agg"""
    q["mart_borrower"] = _with(CLEAN, f"""tiered AS (
  SELECT loan_id, age, late_90, debt_ratio, default_flag,
         CAST(ntile(5) OVER (ORDER BY {CAPPED} ASC NULLS FIRST, loan_id ASC) AS BIGINT) AS risk_tier
  FROM clean
),
pop AS (
  SELECT {AGE_BAND} AS age_band, loan_id, debt_ratio, default_flag, risk_tier
  FROM tiered WHERE late_90 >= 1 AND debt_ratio < 5.0
),
watch AS (
  SELECT *, CAST(rank() OVER (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST) AS BIGINT) AS debt_rank,
         lead(loan_id) OVER w AS next_loan_id, lead(debt_ratio) OVER w AS next_debt_ratio,
         lead(default_flag) OVER w AS next_default_flag
  FROM pop
  WINDOW w AS (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST, loan_id ASC)
)""") + f"""SELECT {WATCH_COLS}, {RATIO_BUCKET} AS debt_bucket, risk_tier,
       CAST(CASE WHEN ({RATIO_BUCKET}) = 'High' THEN 1 ELSE 0 END AS BIGINT) AS high_debt_flag,
       CAST(CASE WHEN risk_tier = 5 THEN 1 ELSE 0 END AS BIGINT) AS top_tier_flag,
       CAST(CASE WHEN debt_rank <= 3 THEN 1 ELSE 0 END AS BIGINT) AS priority_flag
FROM watch"""
    q["global_ntile"] = _with(CLEAN, TIERS) + "SELECT loan_id, utilization_capped, risk_tier FROM tiers"
    q["ranked_peers"] = q["watchlist"]
    q["ranked_peers_all"] = _with(CLEAN, f"""banded AS (
  SELECT {AGE_BAND} AS age_band, loan_id, debt_ratio, default_flag FROM clean
)""") + """SELECT age_band, loan_id, debt_ratio, default_flag,
       CAST(rank() OVER r AS BIGINT) AS debt_rank, CAST(dense_rank() OVER r AS BIGINT) AS debt_dense_rank,
       lead(loan_id) OVER w AS next_loan_id, lead(debt_ratio) OVER w AS next_debt_ratio,
       lead(default_flag) OVER w AS next_default_flag
FROM banded
WINDOW r AS (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST),
       w AS (PARTITION BY age_band ORDER BY debt_ratio DESC NULLS LAST, loan_id ASC)"""
    q["exact_percentile"] = _with() + """SELECT quantile_cont(CAST(monthly_income AS DOUBLE), 0.5) AS median_income,
       CAST(count(monthly_income) AS BIGINT) AS income_values
FROM loans_raw"""
    return q

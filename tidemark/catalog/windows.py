"""Look-back, latest-row, top-k and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.summaries import MONTHLY
from tidemark.operators import ranks
from tidemark.operators.checks import row_count_anomaly
from tidemark.operators.history import lookback_history
from tidemark.plans import marts


@query("wn01_lookback_history", v.with_tables(*v.ADMISSION_TABLES, v.HISTORY, """SELECT admission_id, patient_id, strftime(admission_date, '%Y-%m-%d') AS admission_date, prior_admissions_12m, prior_admissions_90d, prior_readmissions_1y, prior_icu_stays,
 h.mean2 AS prior_los_avg_days, strftime(last_discharge_date, '%Y-%m-%d') AS last_discharge_date, CAST(days_since_last_discharge AS BIGINT) AS days_since_last_discharge, high_utilizer_flag
 FROM history JOIN (SELECT c.admission_id, coalesce(""" + v.mean_sql("p.length_of_stay_days", 2) + """, 0) AS mean2 FROM stg_admissions c LEFT JOIN stg_admissions p ON p.patient_id = c.patient_id
 AND p.admission_date < c.admission_date AND p.admission_date >= c.admission_date - INTERVAL 12 MONTH GROUP BY 1) h USING (admission_id)"""))
def lookback(spark, sf):
    return lookback_history(v.admissions(spark, sf))


@query("wn02_lag_and_delta", v.with_tables(*v.ADMISSION_TABLES, MONTHLY, """SELECT department_name, strftime(period_start, '%Y-%m-%d') AS period_start, lag(readmission_rate) OVER w AS previous,
 round(readmission_rate - lag(readmission_rate) OVER w, 4) AS delta FROM monthly WINDOW w AS (PARTITION BY department_name ORDER BY period_start)"""))
def lag_and_delta(spark, sf):
    found = marts.department_performance(v.admissions(spark, sf), _no_benchmarks(spark))
    previous = F.col("prior_month_readmission_rate")
    return found.select("department_name", "period_start", previous.alias("previous"), F.round(F.col("readmission_rate") - previous, 4).alias("delta"))


def _no_benchmarks(spark):
    return spark.createDataFrame([], "department_name string, benchmark_readmission_rate decimal(10,4)")


@query("wn03_rolling_mean_of_three_rows", v.with_tables(*v.ADMISSION_TABLES, MONTHLY, "SELECT department_name, strftime(period_start, '%Y-%m-%d') AS period_start, "
       + v.mean_sql("readmission_rate", 4, 1, "OVER (PARTITION BY department_name ORDER BY period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)") + " AS rolling_3m_avg FROM monthly"))
def rolling(spark, sf):
    found = marts.department_performance(v.admissions(spark, sf), _no_benchmarks(spark))
    return found.select("department_name", "period_start", "rolling_3m_avg")


@query("wn04_latest_row_per_key", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def latest_row(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return ranks.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("wn05_highest_score_per_entity", v.with_tables(v.SCORES, "SELECT DISTINCT ON (patient_id) patient_id, CAST(risk_score AS DOUBLE) AS risk_score, risk_tier, prediction_id FROM scores ORDER BY patient_id, scores.risk_score DESC, prediction_id DESC"))
def highest_score(spark, sf):
    return ranks.best_row(
        v.scores(spark, sf), ["patient_id"], F.struct("risk_score", "prediction_id"), ["risk_score", "risk_tier", "prediction_id"]
    )


@query("wn06_top_k_per_category_then_overall", """SELECT o_custkey, o_orderpriority, o_orderkey, overall FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS overall FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2) WHERE overall <= 4""")
def top_k(spark, sf):
    best = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    orders = v.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    per_category = ranks.top_per_group(orders, ["o_custkey", "o_orderpriority"], best, 2).drop("position")
    return ranks.top_per_group(per_category, ["o_custkey"], best, 4).select(
        "o_custkey", "o_orderpriority", "o_orderkey", F.col("position").alias("overall")
    )


@query("wn07_score_history_with_delta", v.with_tables(v.SCORES, """SELECT prediction_id, patient_id, CAST(risk_score AS DOUBLE) AS risk_score, CAST(lag(scores.risk_score) OVER w AS DOUBLE) AS previous_risk_score, CAST(scores.risk_score - lag(scores.risk_score) OVER w AS DOUBLE) AS delta
 FROM scores WINDOW w AS (PARTITION BY patient_id ORDER BY predicted_at, prediction_id)"""))
def score_history(spark, sf):
    scores = v.scores(spark, sf).select("prediction_id", "patient_id", "risk_score", "predicted_at")
    found = ranks.chunked_lag(scores, ["patient_id"], ["predicted_at", "prediction_id"], ["risk_score"], F.date_trunc("day", "predicted_at"))
    return found.withColumn("delta", F.col("risk_score") - F.col("previous_risk_score")).drop("predicted_at")


@query("wn08_row_count_anomaly", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), h AS (SELECT count(*) AS days, avg(n) AS m, stddev_pop(n) AS s FROM d WHERE day BETWEEN DATE '2024-01-20' - INTERVAL 31 DAY AND DATE '2024-01-19'),
c AS (SELECT coalesce(sum(n), 0) AS today FROM d WHERE day = DATE '2024-01-20')
SELECT 'row_count' AS check_name, 'events' AS table_name, CAST(today AS BIGINT) AS today_count, CAST(days AS BIGINT) AS history_days, round(m, 1) AS mean, round(s, 1) AS std, round(CASE WHEN s > 0 THEN (today - m) / s ELSE 0 END, 2) AS z_score,
 CASE WHEN days < 5 THEN 'skip' WHEN abs((today - m) / s) > 4.5 THEN 'critical' WHEN abs((today - m) / s) > 3 THEN 'warning' ELSE 'ok' END AS status FROM h, c""")
def row_count(spark, sf):
    return row_count_anomaly(v.table(spark, sf, "events"), "events", "ts", "2024-01-20")

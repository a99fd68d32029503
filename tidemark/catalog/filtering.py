"""Filter, search, order, paging and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.functions import scoring
from tidemark.operators import filters as f
from tidemark.plans import marts

NEWEST = "(SELECT max(o_orderdate) FROM orders)"


@query("fl01_dynamic_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def dynamic_filter(spark, sf):
    found = f.filter_by(
        v.table(spark, sf, "orders"), {"o_orderstatus": "F", "o_custkey": None}, o_totalprice__gte=200000,
        o_orderpriority=["1-URGENT", "5-LOW"],
    )
    return found.select("o_orderkey", "o_totalprice")


@query("fl02_page_with_totals", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 25) AS BIGINT) AS pages
 FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def page(spark, sf):
    rows = v.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return f.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], number=3, size=25)


@query("fl03_nulls_last_page", v.with_tables(*v.ADMISSION_TABLES, """SELECT admission_id, CAST(icu_days AS BIGINT) AS icu_days, (SELECT count(DISTINCT admission_id) FROM stg_admissions) AS total, CAST(ceil((SELECT count(DISTINCT admission_id) FROM stg_admissions) / 100) AS BIGINT) AS pages
 FROM stg_admissions ORDER BY icu_days ASC NULLS LAST, admission_id LIMIT 100 OFFSET 0"""))
def nulls_last(spark, sf):
    rows = v.admissions(spark, sf).select("admission_id", "icu_days")
    return f.page(rows, [F.asc_nulls_last("icu_days"), F.asc("admission_id")], size=100, key="admission_id")


@query("fl04_severity_order", v.with_tables(v.SCORES, """SELECT prediction_id, severity, CAST(r AS BIGINT) AS severity_rank FROM (SELECT prediction_id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS r, predicted_at FROM
 (SELECT prediction_id, predicted_at, CASE risk_tier WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'info' ELSE risk_tier END AS severity FROM scores)) ORDER BY r, predicted_at DESC LIMIT 50"""))
def severity_order(spark, sf):
    severity = F.when(F.col("risk_tier") == "medium", "warning").when(F.col("risk_tier") == "low", "info").otherwise(F.col("risk_tier"))
    ranked = v.scores(spark, sf).withColumn("severity", severity).withColumn("severity_rank", scoring.severity_rank("severity"))
    return ranked.orderBy("severity_rank", F.desc("predicted_at")).limit(50).select("prediction_id", "severity", "severity_rank")


@query("fl04_status_and_cohort_ranks", """SELECT event_id, CAST(CASE event_type WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS BIGINT) AS status_rank, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 4 END AS BIGINT) AS cohort_rank FROM events""")
def status_ranks(spark, sf):
    cohort = F.when(F.col("event_type") == "error", "T1_CatastrophicRisk").otherwise("T4_LowRisk")
    return v.table(spark, sf, "events").select(
        "event_id", scoring.status_rank("event_type").alias("status_rank"), scoring.cohort_rank(cohort).alias("cohort_rank")
    )


@query("fl05_last_days", f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= CAST({NEWEST} AS DATE) - INTERVAL 30 DAY")
def last_days(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return f.since_days(orders, "day", f.latest_value(orders, "day"), 30).select("o_orderkey")


@query("fl05_last_months", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= date_trunc('month', CAST({NEWEST} AS DATE) - INTERVAL 6 MONTH)")
def last_months(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return f.since_months(orders, "day", f.latest_value(orders, "day"), 6).select("o_orderkey")


@query("fl05_last_seconds", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def last_seconds(spark, sf):
    events = v.table(spark, sf, "events")
    return f.since_seconds(events, "ts", f.latest_value(events, "ts"), 3600).select("event_id")


@query("fl06_current_month", f"SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = date_trunc('month', {NEWEST})")
def current_month(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("period_start", F.trunc("o_orderdate", "month"))
    return f.current_period(orders, "period_start", f.latest_value(orders, F.to_date("o_orderdate"))).select("o_orderkey")


@query("fl07_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license')")
def text_search(spark, sf):
    return f.search(v.table(spark, sf, "documents"), "LICENSE", ["text", "source", "lang"]).select("doc_id")


@query("fl08_threshold_list", v.with_tables(v.SCORES, "SELECT prediction_id, CAST(risk_score AS DOUBLE) AS risk_score FROM scores WHERE risk_score * 100 >= 70 AND model_name = 'error'"))
def threshold_list(spark, sf):
    return f.at_or_above(v.scores(spark, sf), "risk_score", 70, "error", "model_name").select("prediction_id", "risk_score")


@query("fl09_top_n_by_key", v.with_tables(v.SCORES, "SELECT prediction_id, risk_tier, CAST(risk_score AS DOUBLE) AS risk_score FROM scores WHERE risk_tier IN ('critical', 'high') ORDER BY scores.risk_score DESC, prediction_id LIMIT 25"))
def top_n(spark, sf):
    rows = v.scores(spark, sf).select("prediction_id", "risk_tier", "risk_score")
    return f.top_n(rows, "risk_score", 25, ["critical", "high"], tiebreak=["prediction_id"])


@query("fl10_five_number_summary", v.with_tables(*v.ADMISSION_TABLES, """SELECT department, count(*) AS n, CAST(min(length_of_stay_days) AS DOUBLE) AS lowest, quantile_cont(length_of_stay_days, 0.25) AS q1, quantile_cont(length_of_stay_days, 0.5) AS median,
 quantile_cont(length_of_stay_days, 0.75) AS q3, CAST(max(length_of_stay_days) AS DOUBLE) AS highest FROM stg_admissions WHERE length_of_stay_days < 30 GROUP BY 1"""))
def five_numbers(spark, sf):
    return f.five_numbers(v.admissions(spark, sf), "department", "length_of_stay_days", 30)


@query("fl11_entity_with_latest_children", """SELECT c_custkey, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o WHERE o.o_custkey = c_custkey AND r <= 20), '') AS latest FROM customer""")
def latest_children(spark, sf):
    orders = v.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nested = f.with_latest_children(
        v.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey",
        [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderkey", "o_orderdate"],
    )
    return nested.select("c_custkey", F.array_join(F.transform("latest", lambda x: x["o_orderkey"].cast("string")), ",").alias("latest"))


@query("fl12_every_third_point", v.with_tables(*v.ADMISSION_TABLES, """SELECT department_name, strftime(period_start, '%Y-%m-%d') AS period_start, total_admissions FROM (SELECT *, row_number() OVER (PARTITION BY department_name ORDER BY period_start) AS r FROM
 (SELECT coalesce(department, 'Unknown') AS department_name, date_trunc('month', admission_date) AS period_start, count(*) AS total_admissions FROM stg_admissions GROUP BY 1, 2)) WHERE (r - 1) % 3 = 0"""))
def every_third(spark, sf):
    monthly = marts.monthly_by_department(v.admissions(spark, sf)).select("department_name", "period_start", "total_admissions")
    return f.every_nth(monthly, ["department_name"], [F.col("period_start")], 3)

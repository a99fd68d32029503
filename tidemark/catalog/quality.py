"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.operators import checks as q


def rules_sql(table: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    """(name, value SQL, status SQL over x) per rule."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, x AS value, {status} AS check_status FROM (SELECT CAST(coalesce({value}, 0) AS DOUBLE) AS x FROM {source})"
        for name, value, status in rules
    )


ZERO = "CASE WHEN x > 0 THEN 'FAIL' ELSE 'PASS' END"
DAMAGED_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 12 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 30 = 0 THEN 'X' || CAST(o_orderkey % 90 AS VARCHAR) WHEN o_orderkey % 31 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority,
 o_orderkey // 2 * 2 AS pair_key FROM orders)"""


def damaged(spark, sf):
    return v.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 12 <> 0 THEN o_custkey END AS o_custkey",
        "CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 30 = 0 THEN concat('X', CAST(o_orderkey % 90 AS STRING)) WHEN o_orderkey % 31 <> 0 THEN o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority",
        "o_orderkey div 2 * 2 AS pair_key",
    )


@query("dq01_source_requirements", """SELECT 'orders' AS table_name, count(*) AS row_count, '' AS missing_columns, CASE WHEN count(*) >= 500 THEN 'PASS' ELSE 'FAIL' END AS check_status FROM orders
 UNION ALL SELECT 'customer', count(*), 'c_birthday', 'FAIL' FROM customer""")
def source_requirements(spark, sf):
    tables = {t: v.table(spark, sf, t) for t in ("orders", "customer")}
    return q.source_requirements(tables, {"orders": 500, "customer": 100}, {"orders": ["o_orderkey"], "customer": ["c_custkey", "c_birthday"]})


@query("dq02_null_rates", rules_sql("orders", DAMAGED_SQL, [
    ("null_rate_o_custkey", "avg(CAST(o_custkey IS NULL AS INTEGER))", "CASE WHEN x > 0.05 THEN 'FAIL' ELSE 'PASS' END"),
    ("null_rate_o_orderstatus", "avg(CAST(o_orderstatus IS NULL AS INTEGER))", "CASE WHEN x > 0.05 THEN 'FAIL' ELSE 'PASS' END"),
]))
def null_rates(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [q.null_rate("o_custkey", 0.05), q.null_rate("o_orderstatus", 0.05)])


@query("dq03_range_violations", rules_sql("orders", DAMAGED_SQL, [
    ("range_o_totalprice", "count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 450000)", ZERO),
    ("range_o_custkey", "count(*) FILTER (WHERE o_custkey < 0)", ZERO),
]))
def ranges(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [q.in_range("o_totalprice", 0, 450000), q.in_range("o_custkey", 0)])


@query("dq04_domain_violations", rules_sql("orders", DAMAGED_SQL, [
    ("domain_o_orderstatus", "count(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P'))", ZERO)]))
def domains(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [q.in_domain("o_orderstatus", ["F", "O", "P"])])


@query("dq04_domain_samples", f"""SELECT column_name, bad_value, position FROM (SELECT column_name, bad_value, row_number() OVER (PARTITION BY column_name ORDER BY bad_value ASC NULLS FIRST) AS position FROM (
 SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS bad_value FROM {DAMAGED_SQL} WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P')
 UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM {DAMAGED_SQL} WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('5-LOW'))) WHERE position <= 3""")
def domain_samples(spark, sf):
    return q.domain_samples(damaged(spark, sf), {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["5-LOW"]})


@query("dq05_duplicate_keys", rules_sql("orders", DAMAGED_SQL, [
    ("unique_pair_key", "count(*) - count(DISTINCT pair_key)", ZERO), ("unique_o_custkey", "count(*) - count(DISTINCT o_custkey) - 1", ZERO)]))
def duplicates(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [q.unique("pair_key"), q.unique("o_custkey")])


@query("dq06_missing_keys", rules_sql("orders", DAMAGED_SQL, [
    ("null_o_orderpriority", "count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority = '')", ZERO), ("null_o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", ZERO)]))
def missing_keys(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [q.key_present("o_orderpriority"), q.key_present("o_orderkey")])


@query("dq07_orphans", rules_sql("orders", f"{DAMAGED_SQL} d LEFT JOIN customer ON c_custkey = d.o_custkey WHERE c_custkey IS NULL", [("orphan_o_custkey", "count(*)", ZERO)]))
def orphans(spark, sf):
    return q.orphan_check(damaged(spark, sf), v.table(spark, sf, "customer"), "o_custkey", "c_custkey", "orders")


@query("dq08_date_order", rules_sql("lineitem", "lineitem JOIN orders ON o_orderkey = l_orderkey", [("order_o_orderdate_l_shipdate", "count(*) FILTER (WHERE l_shipdate < o_orderdate)", ZERO)]))
def date_order(spark, sf):
    joined = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return q.run_rules(joined, "lineitem", [q.date_order("o_orderdate", "l_shipdate")])


@query("dq09_rate_bounds", rules_sql("orders", "orders", [
    ("finished_rate", "avg(CAST(o_orderstatus = 'F' AS INTEGER))", "CASE WHEN x > 0.5 THEN 'FAIL' WHEN x > 0.35 OR x < 0.05 THEN 'WARN' ELSE 'PASS' END")]))
def rate_bounds(spark, sf):
    return q.run_rules(v.table(spark, sf, "orders"), "orders", [q.rate_within("finished_rate", F.col("o_orderstatus") == "F", (0.05, 0.35), 0.5)])


@query("dq10_stay_and_vital_ranges", v.with_tables(*v.ADMISSION_TABLES, "SELECT * FROM (" + rules_sql("stg_admissions", "stg_admissions", [("range_length_of_stay_days", "count(*) FILTER (WHERE length_of_stay_days < 0 OR length_of_stay_days > 365)", ZERO)])
       + " UNION ALL " + rules_sql("events", "events", [("range_value", "count(*) FILTER (WHERE value < 0 OR value > 30)", ZERO)]) + ")"))
def stay_and_vitals(spark, sf):
    stays = q.run_rules(v.admissions(spark, sf), "stg_admissions", [q.in_range("length_of_stay_days", 0, 365)])
    return stays.unionByName(q.run_rules(v.table(spark, sf, "events"), "events", [q.in_range("value", 0, 30)]))


def gate_rules(spark, sf):
    return q.run_rules(damaged(spark, sf), "orders", [
        q.key_present("o_orderkey"), q.key_present("o_orderpriority"), q.in_range("o_totalprice", 0),
        q.Rule("null_share_o_custkey", F.avg(F.col("o_custkey").isNull().cast("int")), fail_above=0.5, warn_above=0.05),
    ])


@query("dq11_rule_summary", f"""SELECT count(*) AS total_checks, count(*) FILTER (WHERE s = 'PASS') AS passed, count(*) FILTER (WHERE s = 'WARN') AS warned, count(*) FILTER (WHERE s = 'FAIL') AS failed FROM (
 SELECT unnest([CASE WHEN count(*) FILTER (WHERE o_orderkey IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority = '') > 0 THEN 'FAIL' ELSE 'PASS' END,
 CASE WHEN count(*) FILTER (WHERE o_totalprice < 0) > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN avg(CAST(o_custkey IS NULL AS INTEGER)) > 0.5 THEN 'FAIL' WHEN avg(CAST(o_custkey IS NULL AS INTEGER)) > 0.05 THEN 'WARN' ELSE 'PASS' END]) AS s FROM {DAMAGED_SQL})""")
def rule_summary(spark, sf):
    return q.summarise(gate_rules(spark, sf))


@query("dq12_column_tests", rules_sql("orders", DAMAGED_SQL, [
    ("not_null_o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", ZERO), ("unique_o_orderkey", "count(*) - count(DISTINCT o_orderkey)", ZERO),
    ("domain_o_orderstatus", "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P'))", ZERO), ("range_o_totalprice", "count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 1000000)", ZERO)]))
def column_tests(spark, sf):
    tests = [
        q.ColumnTests("o_orderkey", not_null=True, unique=True), q.ColumnTests("o_orderstatus", accepted=["F", "O", "P"]),
        q.ColumnTests("o_totalprice", low=0, high=1_000_000),
    ]
    return q.run_column_tests(damaged(spark, sf), "orders", tests)


def watched(spark, sf):
    return v.table(spark, sf, "events").withColumns({
        "props": F.when(~((F.col("event_id") % 5 == 0) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))), F.col("props")),
        "user_id": F.when(F.col("event_id") % 500 != 0, F.col("user_id")),
    })


WATCHED = "(SELECT event_id, ts, CASE WHEN NOT (event_id % 5 = 0 AND ts >= '2024-01-20') THEN props END AS props, CASE WHEN event_id % 500 <> 0 THEN user_id END AS user_id FROM events)"
NULL_CHANGE = " UNION ALL ".join(f"""SELECT 'null_rate' AS check_name, 'events' AS table_name, '{c}' AS column_name, round(now, 4) AS current_null_rate, round(was, 4) AS baseline_null_rate, round(now - was, 4) AS delta, {required} AS required,
 CASE WHEN {required} AND now > 0 THEN 'critical' WHEN now - was > 0.2 THEN 'critical' WHEN now - was > 0.05 THEN 'warning' ELSE 'ok' END AS status
 FROM (SELECT coalesce(avg(CAST({c} IS NULL AS INTEGER)) FILTER (WHERE CAST(ts AS DATE) = '2024-01-20'), 0) AS now, coalesce(avg(CAST({c} IS NULL AS INTEGER)) FILTER (WHERE CAST(ts AS DATE) < '2024-01-20' AND CAST(ts AS DATE) >= DATE '2024-01-20' - INTERVAL 30 DAY), 0) AS was FROM {WATCHED})"""
    for c, required in (("event_id", "TRUE"), ("user_id", "TRUE"), ("props", "FALSE")))


@query("dq13_null_rate_change", NULL_CHANGE)
def null_change(spark, sf):
    return q.null_rate_change(watched(spark, sf), "events", "ts", "2024-01-20", ["event_id", "user_id"], ["props"])


@query("dq14_category_drift", """WITH c AS (SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) = '2024-01-20') AS o, count(*) FILTER (WHERE CAST(ts AS DATE) < '2024-01-20') AS b FROM events WHERE CAST(ts AS DATE) <= '2024-01-20' AND CAST(ts AS DATE) >= DATE '2024-01-20' - INTERVAL 30 DAY GROUP BY 1),
t AS (SELECT sum(o) / sum(b) AS r FROM c), x AS (SELECT sum(pow(o + 0.5::DOUBLE - (b * r + 0.5::DOUBLE), 2) / (b * r + 0.5::DOUBLE)) AS chi FROM c, t)
SELECT 'distribution_drift' AS check_name, 'events' AS table_name, 'event_type' AS column_name, round(chi, 4) AS chi2_statistic, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value, CASE WHEN exp(-chi / 2) * (1 + chi / 2) < 0.01 THEN 'critical' ELSE 'ok' END AS status FROM x""")
def category_drift(spark, sf):
    return q.category_drift(v.table(spark, sf, "events"), "events", "event_type", "ts", "2024-01-20")


@query("dq15_monitor_summary", f"""SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'ok') AS passed, count(*) FILTER (WHERE status = 'warning') AS warned, count(*) FILTER (WHERE status = 'critical') AS failed FROM (
 SELECT status FROM ({NULL_CHANGE}) UNION ALL SELECT 'critical' UNION ALL SELECT (WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN count(*) < 5 THEN 'skip' WHEN abs(((SELECT n FROM d WHERE day = '2024-01-20') - avg(n)) / stddev_pop(n)) > 4.5 THEN 'critical' WHEN abs(((SELECT n FROM d WHERE day = '2024-01-20') - avg(n)) / stddev_pop(n)) > 3 THEN 'warning' ELSE 'ok' END FROM d WHERE day < '2024-01-20')
 UNION ALL SELECT (WITH c AS (SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) = '2024-01-20') AS o, count(*) FILTER (WHERE CAST(ts AS DATE) < '2024-01-20') AS b FROM events WHERE CAST(ts AS DATE) <= '2024-01-20' GROUP BY 1), t AS (SELECT sum(o) / sum(b) AS r FROM c), x AS (SELECT sum(pow(o + 0.5 - (b * r + 0.5), 2) / (b * r + 0.5)) AS chi FROM c, t) SELECT CASE WHEN exp(-chi / 2) * (1 + chi / 2) < 0.01 THEN 'critical' ELSE 'ok' END FROM x))""")
def monitor_summary(spark, sf):
    tables = {
        "events": q.Monitored(watched(spark, sf), "ts", ["event_id", "user_id"], ["props"], ["event_type"]),
        "orders": q.Monitored(v.table(spark, sf, "orders"), "created_at"),
    }
    return q.summarise(q.run_monitor(tables, "2024-01-20"), "status")


@query("dq16_row_count_delta", """WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS row_count FROM events GROUP BY 1), p AS (SELECT *, lag(row_count) OVER (ORDER BY day) AS previous_count FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, row_count, previous_count, round(abs(row_count - previous_count) * 100 / previous_count, 2) AS delta_pct, CASE WHEN round(abs(row_count - previous_count) * 100 / previous_count, 2) >= 2 THEN 'warn' ELSE 'pass' END AS status FROM p""")
def row_count_delta(spark, sf):
    return q.row_count_delta(v.table(spark, sf, "events").withColumn("day", F.to_date("ts")), "day")


@query("dq16_outliers", "SELECT count(*) FILTER (WHERE abs(value - m) > 3 * s) AS outlier_rows, count(value) AS rows_checked FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def outliers(spark, sf):
    return q.outlier_count(v.table(spark, sf, "events"), "value")


def check_results(spark, sf):
    status = F.when(F.col("value") > 30, "fail").when(F.col("value") > 15, "warn").otherwise("pass")
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("check_id"), F.col("event_type").alias("check_name"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("table_name"),
        F.col("ts").alias("checked_at"), status.alias("status"), F.col("value").alias("actual_value"),
    )


@query("dq17_latest_checks", """SELECT DISTINCT ON (event_type, user_id % 7) event_id AS check_id, event_type AS check_name, 't' || CAST(user_id % 7 AS VARCHAR) AS table_name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS checked_at,
 CASE WHEN value > 30 THEN 'fail' WHEN value > 15 THEN 'warn' ELSE 'pass' END AS status, value AS actual_value FROM events ORDER BY event_type, user_id % 7, ts DESC, event_id DESC""")
def latest_checks(spark, sf):
    return q.latest_checks(check_results(spark, sf))


def runs(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("pipeline_name"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ended_at"), F.when(F.col("value") < 12, "success").otherwise("failed").alias("status"),
    )


@query("dq18_latest_runs", "SELECT DISTINCT ON (event_type) event_id AS run_id, event_type AS job, CASE WHEN value < 12 THEN 'success' ELSE 'failed' END AS status FROM events ORDER BY event_type, ts DESC, event_id DESC")
def latest_runs(spark, sf):
    return q.latest_runs(runs(spark, sf)).select("run_id", F.col("pipeline_name").alias("job"), "status")


@query("dq18_recent_runs", "SELECT event_id AS run_id, event_type AS job FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_runs(spark, sf):
    return q.recent_runs(runs(spark, sf), 30, "error").select("run_id", F.col("pipeline_name").alias("job"))


@query("dq19_freshness", """SELECT strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS last_successful_run, round(floor((epoch_us(TIMESTAMP '2024-02-02 00:00:00') - epoch_us(t)) / 1000000) / 3600, 1) AS hours_since_last_run,
 floor((epoch_us(TIMESTAMP '2024-02-02 00:00:00') - epoch_us(t)) / 1000000) / 3600 < 6 AS freshness_sla_met, CAST(6 AS BIGINT) AS freshness_sla_threshold_hours FROM (SELECT max(ts + INTERVAL 5 MINUTE) AS t FROM events WHERE value < 12)""")
def freshness(spark, sf):
    return q.freshness(runs(spark, sf), F.lit("2024-02-02").cast("timestamp_ntz"))

"""Timeline, audit, alert, catalog and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.quality import runs
from tidemark.functions.scoring import severity_rank
from tidemark.operators import checks as q
from tidemark.operators import drift as d
from tidemark.operators import events as e
from tidemark.operators import filters as f
from tidemark.operators import lineage as g

ALERTS_SQL = """alerts AS (SELECT event_id AS alert_id, event_type AS alert_type, CASE WHEN value > 30 THEN 'critical' WHEN value > 20 THEN 'high' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity, event_type || ' by ' || CAST(user_id AS VARCHAR) AS title,
 props AS description, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 MINUTE END AS acknowledged_at, CASE WHEN event_id % 3 = 0 THEN 'dr' END AS acknowledged_by, event_id % 11 = 0 AS auto_dismissed, CAST(user_id AS VARCHAR) AS related_patient_id FROM events)"""


def alerts(spark, sf):
    value = F.col("value")
    severity = F.when(value > 30, "critical").when(value > 20, "high").when(value > 10, "warning").otherwise("info")
    done = F.col("event_id") % 3 == 0
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), F.col("event_type").alias("alert_type"), severity.alias("severity"),
        F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("title"), F.col("props").alias("description"),
        F.col("ts").alias("created_at"), F.when(done, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("acknowledged_at"),
        F.when(done, "dr").alias("acknowledged_by"), F.lit(None).cast("string").alias("acknowledged_note"),
        (F.col("event_id") % 11 == 0).alias("auto_dismissed"), F.col("user_id").cast("string").alias("related_patient_id"),
    )


TIMELINE_SQL = """tl AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS admission_id, 'admission' AS event_type, o_orderdate AS event_at, 'Patient Admitted' AS title, o_orderpriority AS subtitle FROM orders
 UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), event_type, ts, 'Reading', CAST(value AS VARCHAR) FROM events)"""


def full_timeline(spark, sf):
    orders = e.timeline_rows(
        v.table(spark, sf, "orders"), "admission", "o_orderdate", "Patient Admitted", F.col("o_orderpriority"), ["o_totalprice", "o_orderstatus"],
        "o_custkey", "o_orderkey",
    )
    readings = e.timeline_rows(
        v.table(spark, sf, "events"), F.col("event_type"), "ts", "Reading", F.col("value").cast("string"), ["value", "props"], "user_id", "event_id"
    )
    return e.build_timeline([orders, readings])


@query("ev01_entity_timeline", v.with_tables(TIMELINE_SQL, "SELECT admission_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S.%f') AS event_at FROM tl WHERE patient_id = '17' AND event_type = 'click' ORDER BY tl.event_at DESC LIMIT 100"))
def entity_timeline(spark, sf):
    return e.timeline(full_timeline(spark, sf), "17", "click").select("admission_id", "event_type", "event_at")


@query("ev02_timeline_rows", v.with_tables(TIMELINE_SQL, "SELECT patient_id, admission_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S.%f') AS event_at, title, subtitle, 'system' AS actor FROM tl"))
def timeline_rows(spark, sf):
    return full_timeline(spark, sf).drop("detail_json", "event_id")


AUDIT_SQL = "lg AS (SELECT event_id, ts, event_type, CAST(user_id AS VARCHAR) AS actor, CASE WHEN event_id % 2 = 0 THEN '/api/v1/patients/PAT-' || CAST(user_id AS VARCHAR) || '/detail' WHEN event_id % 5 = 0 THEN '/health' ELSE '/api/v1/rules' END AS path, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'post' WHEN 'error' THEN 'OPTIONS' WHEN 'purchase' THEN 'DELETE' ELSE 'PATCH' END AS method FROM events)"


def access_log(spark, sf):
    user, n, kind = F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type")
    path = F.when(n % 2 == 0, F.concat(F.lit("/api/v1/patients/PAT-"), user, F.lit("/detail"))).when(n % 5 == 0, "/health").otherwise("/api/v1/rules")
    method = F.when(kind == "view", "GET").when(kind == "click", "post").when(kind == "error", "OPTIONS").when(kind == "purchase", "DELETE").otherwise("PATCH")
    return v.table(spark, sf, "events").select(n.alias("audit_id"), F.col("ts").alias("event_at"), kind, user.alias("actor_user_id"), path.alias("path"), method.alias("method"))


@query("ev03_audit_query", v.with_tables(AUDIT_SQL, "SELECT event_id AS audit_id, actor AS actor_user_id FROM lg WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50"))
def audit_query(spark, sf):
    return e.audit_query(access_log(spark, sf), event_type="click", offset=50).select("audit_id", "actor_user_id")


@query("ev04_access_log", v.with_tables(AUDIT_SQL, "SELECT event_id AS audit_id, nullif(regexp_extract(path, '/patients/([^/]+)', 1), '') AS patient_id, CASE upper(method) WHEN 'GET' THEN 'read' WHEN 'POST' THEN 'create' WHEN 'PUT' THEN 'update' WHEN 'PATCH' THEN 'update' WHEN 'DELETE' THEN 'delete' ELSE lower(method) END AS action FROM lg WHERE contains(path, '/patients/')"))
def parsed_log(spark, sf):
    return e.parse_access_log(access_log(spark, sf), "path", "method").select("audit_id", "patient_id", "action")


@query("ev04_page_paths", "SELECT page_id, nullif(regexp_extract(url, '//([^/]+)', 1), '') AS patient_id FROM pages")
def page_paths(spark, sf):
    pages = v.table(spark, sf, "pages").withColumn("method", F.lit("GET"))
    return e.parse_access_log(pages, "url", "method", pattern=r"//([^/]+)", only=None).select("page_id", "patient_id")


@query("ev05_alert_list", v.with_tables(ALERTS_SQL, "SELECT alert_id, severity, alert_type FROM alerts WHERE acknowledged_at IS NULL AND NOT auto_dismissed ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, created_at DESC, alert_id LIMIT 50 OFFSET 10"))
def alert_list(spark, sf):
    return e.alert_list(alerts(spark, sf), acknowledged=False, offset=10).select("alert_id", "severity", "alert_type")


@query("ev05_unread_counts", v.with_tables(ALERTS_SQL, "SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM alerts WHERE acknowledged_at IS NULL AND NOT auto_dismissed"))
def unread_counts(spark, sf):
    return e.unread_counts(alerts(spark, sf))


@query("ev06_bulk_acknowledge", v.with_tables(ALERTS_SQL, "SELECT alert_id, CASE WHEN severity = 'critical' AND acknowledged_at IS NULL THEN 'nurse' ELSE acknowledged_by END AS acknowledged_by, strftime(CASE WHEN severity = 'critical' AND acknowledged_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE acknowledged_at END, '%Y-%m-%d %H:%M:%S.%f') AS acknowledged_at FROM alerts"))
def bulk_acknowledge(spark, sf):
    changed, _ = e.acknowledge(alerts(spark, sf), F.col("severity") == "critical", "nurse", "Bulk acknowledged", F.lit("2024-02-01").cast("timestamp_ntz"))
    return changed.select("alert_id", "acknowledged_by", "acknowledged_at")


@query("ev06_affected_rows", v.with_tables(ALERTS_SQL, "SELECT count(*) AS affected FROM alerts WHERE severity = 'critical' AND acknowledged_at IS NULL"))
def affected(spark, sf):
    return e.acknowledge(alerts(spark, sf), F.col("severity") == "critical", "nurse", "Bulk acknowledged", F.lit("2024-02-01").cast("timestamp_ntz"))[1]


@query("ev06_dismiss", v.with_tables(ALERTS_SQL, "SELECT alert_id, auto_dismissed OR severity = 'info' AS auto_dismissed FROM alerts"))
def dismiss(spark, sf):
    return e.dismiss(alerts(spark, sf), F.col("severity") == "info").select("alert_id", "auto_dismissed")


def generated(spark, sf):
    scores = v.scores(spark, sf)
    vitals = v.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("patient_id"), F.col("ts").alias("recorded_at"), F.col("value").alias("heart_rate"))
    as_of = F.lit("2024-02-02").cast("timestamp_ntz")
    events = v.table(spark, sf, "events").withColumn("skewed", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value") * F.dayofmonth("ts")))
    drift = d.feature_drift(*d.week_slices(events, "ts", "2024-01-22"), ["skewed"])
    return e.raise_alerts([
        e.critical_admission_alerts(scores), e.score_spike_alerts(scores), e.vital_alerts(vitals, {"heart_rate": (0, 40)}),
        e.failed_run_alerts(runs(spark, sf)), e.stale_alerts(q.freshness(runs(spark, sf), as_of), "events", as_of), e.drift_alerts(drift, as_of),
    ])


@query("ev07_generated_alerts", v.with_tables(v.SCORES, """sp AS (SELECT *, lag(scores.risk_score) OVER w AS p, lag(predicted_at) OVER w AS pa FROM scores WINDOW w AS (PARTITION BY patient_id ORDER BY predicted_at, prediction_id))""",
"""SELECT 'new_critical_admission' AS alert_type, 'critical' AS severity, count(*) AS n FROM scores WHERE risk_tier = 'critical' UNION ALL SELECT 'risk_score_spike', 'high', count(*) FROM sp WHERE sp.risk_score - p >= 0.25 AND predicted_at <= pa + INTERVAL 6 HOUR
 UNION ALL SELECT 'vital_anomaly', 'high', count(*) FROM events WHERE value < 0 OR value > 40 UNION ALL SELECT 'pipeline_failure', 'warning', count(*) FROM events WHERE value >= 12 UNION ALL SELECT 'sla_breach', 'warning', 1 UNION ALL SELECT 'model_drift_detected', 'warning', 1"""))
def generated_alerts(spark, sf):
    return generated(spark, sf).groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("ev07_score_spikes", v.with_tables(v.SCORES, "sp AS (SELECT *, lag(scores.risk_score) OVER w AS p, lag(predicted_at) OVER w AS pa FROM scores WINDOW w AS (PARTITION BY patient_id ORDER BY predicted_at, prediction_id))",
       "SELECT prediction_id, patient_id, CAST(p AS DOUBLE) AS previous_risk_score, CAST(sp.risk_score - p AS DOUBLE) AS delta FROM sp WHERE sp.risk_score - p >= 0.25 AND predicted_at <= pa + INTERVAL 6 HOUR"))
def score_spikes(spark, sf):
    return e.score_spikes(v.scores(spark, sf)).select("prediction_id", "patient_id", "previous_risk_score", "delta")


@query("ev08_open_by_severity", v.with_tables(ALERTS_SQL, "SELECT severity, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS newest FROM alerts WHERE acknowledged_at IS NULL AND NOT auto_dismissed GROUP BY 1"))
def open_by_severity(spark, sf):
    return e.open_by_severity(alerts(spark, sf))


@query("ev09_migration_checksums", "SELECT doc_id AS version, doc_id % 3 <> 0 AS checksum_ok FROM documents")
def checksums(spark, sf):
    kept = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("version"), F.col("doc_id").alias("applied_at"), F.col("text").alias("sql_up"),
        F.when(F.col("doc_id") % 3 != 0, F.sha2(F.col("text"), 256)).otherwise(F.sha2(F.concat(F.col("text"), F.lit(" ")), 256)).alias("checksum"),
    )
    return g.migration_history(kept).select("version", "checksum_ok")


TABLE_EDGES = [
    ("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem"),
]


@query("ev10_lineage_nodes", "WITH ed(s, d) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TABLE_EDGES) + "), c(node, row_count) AS (" + " UNION ALL ".join(f"SELECT '{t}', count(*) FROM {t}" for t in v.ALL_TABLES) + """)
 SELECT node, CAST(sum(up) AS BIGINT) AS upstream, CAST(sum(down) AS BIGINT) AS downstream, row_count FROM (SELECT s AS node, 0 AS up, 1 AS down FROM ed UNION ALL SELECT d, 1, 0 FROM ed) JOIN c USING (node) GROUP BY node, row_count""")
def lineage_nodes(spark, sf):
    return g.lineage_nodes(spark.createDataFrame(TABLE_EDGES, "source string, target string"), {t: v.table(spark, sf, t) for t in v.ALL_TABLES})


@query("ev10_lineage_paths", """SELECT DISTINCT r_name AS ancestor, n_name AS descendant, CAST(1 AS BIGINT) AS hops FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT n_name, n_name || ':' || c_mktsegment, 1 FROM nation JOIN customer ON n_nationkey = c_nationkey
 UNION ALL SELECT DISTINCT r_name, n_name || ':' || c_mktsegment, 2 FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey""")
def lineage_paths(spark, sf):
    region, nation, customer = (v.table(spark, sf, t) for t in ("region", "nation", "customer"))
    segment = F.concat_ws(":", "n_name", "c_mktsegment")
    edges = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    return g.lineage_paths(edges.unionByName(nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("source"), segment.alias("target"))))


CATALOG_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type, row_number() OVER () AS position, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})" for t in v.ALL_TABLES)
KINDS = [("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("float", "FLOAT"), ("timestamp_ntz", "TIMESTAMP"), ("date", "DATE"), ("array<float>", "FLOAT[]"), ("array<double>", "DOUBLE[]")]


@query("ev11_catalog", f"SELECT table_name, column_name, CASE column_type {' '.join(f'WHEN {chr(39)}{d}{chr(39)} THEN {chr(39)}{k}{chr(39)}' for k, d in KINDS)} ELSE column_type END AS data_type, TRUE AS nullable, position, row_count FROM ({CATALOG_SQL})")
def table_catalog(spark, sf):
    return g.table_catalog(spark, {t: v.table(spark, sf, t) for t in v.ALL_TABLES})


@query("ev05_alert_search", v.with_tables(ALERTS_SQL, "SELECT alert_id, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank FROM alerts WHERE contains(lower(title), 'by 12') OR contains(lower(description), 'by 12') OR contains(lower(related_patient_id), 'by 12')"))
def alert_search(spark, sf):
    found = f.search(alerts(spark, sf), "BY 12", ["title", "description", "related_patient_id"])
    return found.select("alert_id", severity_rank("severity").alias("severity_rank"))

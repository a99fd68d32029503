"""Streaming queries, run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.events import ALERTS_SQL, alerts
from tidemark.session import shared_folder
from tidemark.sources.versions import Tables
from tidemark.streaming import streams as s


def event_stream(spark, sf):
    return s.read_stream(spark, sf, v.table(spark, sf, "events"), "events.parquet")


@query("st01_open_alert_feed", v.with_tables(ALERTS_SQL, "SELECT alert_id, severity FROM alerts WHERE acknowledged_at IS NULL AND NOT auto_dismissed"))
def alert_feed(spark, sf):
    folder = shared_folder(spark, "alerts")
    once = alerts(spark, sf)
    once.unionByName(once.filter("alert_id % 5 = 0")).write.parquet(folder)
    feed = s.open_alert_feed(s.read_stream(spark, folder, once))
    return s.run_to_end(feed.select("alert_id", "severity"), "alert-feed")


@query("st02_vital_anomalies", "SELECT CAST(user_id AS VARCHAR) AS related_patient_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM events WHERE value < 0.5 OR value > 30")
def vital_anomalies(spark, sf):
    vitals = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("patient_id"), F.col("ts").alias("recorded_at"), F.col("value").alias("heart_rate"))
    found = s.run_to_end(s.vital_anomaly_stream(vitals, {"heart_rate": (0.5, 30)}), "vitals")
    return found.select("related_patient_id", "created_at")


@query("st03_windowed_counts", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS w, event_type FROM events)
 WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY w, event_type""")
def windowed_counts(spark, sf):
    return s.run_to_end(s.windowed_counts(event_stream(spark, sf), "event_type", "ts"), "counts")


@query("st03_heartbeat_counts", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, event_type, coalesce(n, 0) AS n
 FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', min(ts)), (SELECT date_trunc('hour', max(ts) - INTERVAL 1 HOUR) - INTERVAL 1 HOUR FROM events), INTERVAL 1 HOUR)) AS w FROM events GROUP BY event_type)
 LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY ALL) USING (event_type, w)""")
def heartbeat_counts(spark, sf):
    return s.run_to_end(s.heartbeat_counts(event_stream(spark, sf), "event_type", "ts"), "heartbeat")


@query("st04_score_spikes", v.with_tables("sp AS (SELECT user_id, ts, event_id, value % 1.0 AS sc, lag(value % 1.0) OVER w AS p, lag(ts) OVER w AS pa FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value % 1.0))",
       "SELECT CAST(user_id AS VARCHAR) AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, round(p, 4) AS previous, round(sc, 4) AS score FROM sp WHERE sc - p >= 0.25 AND ts <= pa + INTERVAL 6 HOUR AND ts < date_trunc('hour', (SELECT max(ts) FROM events) - INTERVAL 1 DAY)"))
def spikes(spark, sf):
    """Final spikes: those of hours that the watermark has passed."""
    scored = event_stream(spark, sf).withColumn("risk_score", F.col("value") % 1.0)
    found = s.run_to_end(s.score_spike_stream(scored, "user_id", "ts"), "spikes")
    return found.select("entity", "at", F.round("previous", 4).alias("previous"), F.round("score", 4).alias("score"))


@query("st05_incremental_features", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 2 = 0 OR o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 2 = 0) - INTERVAL 90 DAY")
def incremental_features(spark, sf):
    source, target = shared_folder(spark, "feature-source"), shared_folder(spark, "feature-table")
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    for part in (0, 1):
        rows.filter(F.col("o_orderkey") % 2 == part).repartition(4).write.mode("append").parquet(source)
    stream = s.read_stream(spark, source, rows, files_per_batch=4)
    merge = s.append_features(target, "o_orderkey", "day", 90)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/_state").trigger(availableNow=True).start().awaitTermination()
    return Tables(spark, target).read("rows").select("o_orderkey", "day")

"""Timelines, access logs and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col
from tidemark.functions.scoring import ALERT_VITAL_RANGES, outside, severity_rank
from tidemark.operators.aggregates import conditional_counts
from tidemark.operators.filters import filter_by
from tidemark.operators.ranks import chunked_lag

# Severities, actions and alert limits.
SEVERITIES = ["critical", "high", "warning", "info"]
METHOD_ACTIONS = {"GET": "read", "POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
SKIPPED_PREFIXES = ["/health", "/metrics", "/docs", "/openapi", "/auth/", "/static"]
SPIKE_HOURS, SPIKE_DELTA = 6, 0.25
DRIFT_LIMIT, DRIFT_NEAR = 0.20, 0.18
ALERT_COLUMNS = ["alert_type", "severity", "title", "description", "metadata", "created_at", "related_patient_id", "related_pipeline"]


def timeline(events: DataFrame, entity: str, event_type: str | None = None, limit: int = 100, key: str = "patient_id") -> DataFrame:
    """An entity's events, newest first."""
    return filter_by(events, {key: entity, "event_type": event_type}).orderBy(F.desc("event_at"), "event_id").limit(limit)


def timeline_rows(
    df: DataFrame, event_type: str | Column, at: str, title: Column | str, subtitle: Column, detail: Sequence[str], entity: str = "patient_id",
    reference: str = "admission_id", actor: Column | None = None,
) -> DataFrame:
    """Rows of one source as timeline rows, with the given columns as JSON detail."""
    kind = event_type if isinstance(event_type, Column) else F.lit(event_type)
    return df.select(
        F.col(entity).cast("string").alias("patient_id"), F.col(reference).cast("string").alias("admission_id"), kind.alias("event_type"),
        F.col(at).cast("timestamp_ntz").alias("event_at"), (title if isinstance(title, Column) else F.lit(title)).alias("title"),
        subtitle.alias("subtitle"), (actor if actor is not None else F.lit("system")).alias("actor"), F.to_json(F.struct(*detail)).alias("detail_json"),
    )


def build_timeline(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources as one table with an id that is the same on every run."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.withColumn("event_id", F.md5(F.to_json(F.struct("patient_id", "admission_id", "event_type", "event_at", "detail_json")).cast("binary")))


def parse_access_log(log: DataFrame, path: str, method: str, pattern: str = r"/patients/([^/]+)", only: str | None = "/patients/") -> DataFrame:
    """Accessed entity and action of each request; requests outside the watched paths are left out."""
    p, m = F.col(path), F.upper(F.col(method))
    kept = log.filter(~F.coalesce(F.greatest(*[p.startswith(x) for x in SKIPPED_PREFIXES]), F.lit(False)))
    if only:
        kept = kept.filter(p.contains(only))
    action = F
    for name, verb in METHOD_ACTIONS.items():
        action = action.when(m == name, verb)
    return kept.withColumns(
        {"patient_id": F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")), "action": action.otherwise(F.lower(F.col(method)))}
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("acknowledged_at").isNull() & ~F.col("auto_dismissed"))


def alert_list(
    alerts: DataFrame, severity: str | None = None, alert_type: str | None = None, acknowledged: bool | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Filtered alerts, most severe and newest first."""
    found = filter_by(alerts, severity=severity, alert_type=alert_type)
    if acknowledged is True:
        found = found.filter(F.col("acknowledged_at").isNotNull())
    elif acknowledged is False:
        found = open_alerts(found)
    return found.orderBy(severity_rank("severity"), F.desc("created_at"), "alert_id").offset(offset).limit(limit)


def unread_counts(alerts: DataFrame) -> DataFrame:
    return conditional_counts(open_alerts(alerts), "severity", SEVERITIES)


def open_by_severity(alerts: DataFrame) -> DataFrame:
    """Open alerts per severity that has any, most severe first."""
    grouped = open_alerts(alerts).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    return grouped.orderBy(severity_rank("severity"))


def acknowledge(alerts: DataFrame, which: Column, by: str, note: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """New snapshot with the chosen open alerts acknowledged, and the number of rows changed."""
    hit = F.coalesce(which & F.col("acknowledged_at").isNull(), F.lit(False))
    changed = alerts.withColumns(
        {
            "acknowledged_by": F.when(hit, by).otherwise(F.col("acknowledged_by")),
            "acknowledged_note": F.when(hit, note).otherwise(F.col("acknowledged_note")),
            "acknowledged_at": F.when(hit, at).otherwise(F.col("acknowledged_at")),
        }
    )
    return changed, alerts.agg(F.count_if(hit).alias("affected"))


def dismiss(alerts: DataFrame, which: Column) -> DataFrame:
    return alerts.withColumn("auto_dismissed", F.col("auto_dismissed") | F.coalesce(which, F.lit(False)))


def _alert(df: DataFrame, kind: str | Column, severity: str, title: str, description: Column, metadata: Sequence[Column | str], at: str, patient: Column | None = None, job: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("alert_type"), F.lit(severity).alias("severity"), F.lit(title).alias("title"),
        description.alias("description"), F.to_json(F.struct(*metadata)).alias("metadata"), F.col(at).alias("created_at"),
        (patient if patient is not None else none).alias("related_patient_id"), (job if job is not None else none).alias("related_pipeline"),
    )


def _percent(score: str) -> Column:
    return F.format_string("%d%%", F.round(F.col(score).cast("double") * 100).cast("long"))


def critical_admission_alerts(scores: DataFrame, entity: str = "patient_id", at: str = "predicted_at") -> DataFrame:
    rows = scores.filter(F.col("risk_tier") == "critical")
    text = F.concat(F.col(entity), F.lit(" admitted with risk score "), _percent("risk_score"))
    return _alert(rows, "new_critical_admission", "critical", "New Critical Admission", text, [entity, "risk_score"], at, F.col(entity))


def score_spikes(scores: DataFrame, entity: str = "patient_id", at: str = "predicted_at", tiebreak: str = "prediction_id", hours: int = SPIKE_HOURS, delta: float = SPIKE_DELTA) -> DataFrame:
    """Scores that rose by at least ``delta`` over the entity's previous score within some hours."""
    found = chunked_lag(scores.select(entity, at, tiebreak, "risk_score"), [entity], [at, tiebreak], [at, "risk_score"], F.date_trunc("day", at))
    near = F.col(at) <= F.col(f"previous_{at}") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return found.withColumn("delta", F.col("risk_score") - F.col("previous_risk_score")).filter(near & (F.col("delta") >= delta))


def score_spike_alerts(scores: DataFrame, entity: str = "patient_id", at: str = "predicted_at", tiebreak: str = "prediction_id", hours: int = SPIKE_HOURS, delta: float = SPIKE_DELTA) -> DataFrame:
    rows = score_spikes(scores, entity, at, tiebreak, hours, delta)
    text = F.concat(
        F.col(entity), F.lit(" risk increased from "), _percent("previous_risk_score"), F.lit(" to "), _percent("risk_score"), F.lit(f" in last {hours}h")
    )
    return _alert(rows, "risk_score_spike", "high", "Risk Score Spike", text, [entity, "previous_risk_score", "risk_score", "delta"], at, F.col(entity))


def vital_alerts(vitals: DataFrame, ranges: Mapping[str, tuple[float, float]] = ALERT_VITAL_RANGES, entity: str = "patient_id", at: str = "recorded_at") -> DataFrame:
    """One alert per reading and vital outside its range."""
    checks = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("vital"), F.col(name).cast("double").alias("value"), F.lit(f"{low}-{high}").alias("expected"),
                    F.coalesce(outside(name, low, high), F.lit(False)).alias("bad"),
                )
                for name, (low, high) in ranges.items()
            ]
        ),
        lambda x: x["bad"],
    )
    rows = vitals.select(F.col(entity), F.col(at), F.inline(checks))
    text = F.concat(F.col(entity), F.lit(": "), F.col("vital"), F.lit(" = "), F.col("value").cast("string"), F.lit(" (expected "), F.col("expected"), F.lit(")"))
    return _alert(rows, "vital_anomaly", "high", "Vital Sign Anomaly", text, [entity, "vital", "value", "expected"], at, F.col(entity))


def failed_run_alerts(runs: DataFrame) -> DataFrame:
    rows = runs.filter(F.col("status") == "failed")
    text = F.concat(F.col("pipeline_name"), F.lit(" failed at "), F.date_format("started_at", "HH:mm"), F.lit("."))
    return _alert(rows, "pipeline_failure", "warning", "Pipeline Failed", text, ["pipeline_name", "started_at"], "started_at", job=F.col("pipeline_name"))


def stale_alerts(freshness: DataFrame, table: str, as_of: Column) -> DataFrame:
    rows = freshness.filter(~F.col("freshness_sla_met")).withColumn("_at", as_of)
    hours = F.format_string("%.0f", "hours_since_last_run")
    text = F.concat(F.lit(f"{table} has not been updated in "), hours, F.lit("h (SLA: "), F.format_string("%.0f", F.col("freshness_sla_threshold_hours").cast("double")), F.lit("h)"))
    return _alert(rows, "sla_breach", "warning", "Data Freshness SLA Breach", text, ["hours_since_last_run"], "_at")


def drift_alerts(drift: DataFrame, as_of: Column, limit: float = DRIFT_LIMIT, near: float = DRIFT_NEAR) -> DataFrame:
    """Alerts for drift results over, or close to, the limit."""
    rows = drift.filter(F.col("psi") > near).withColumn("_at", as_of)
    number = F.format_string("%.2f", "psi")
    text = F.when(F.col("psi") > limit, F.concat(F.lit("PSI = "), number, F.lit(f" exceeds threshold {limit:.2f}. Retraining recommended."))).otherwise(
        F.concat(F.lit("PSI = "), number, F.lit(f" approaching threshold {limit:.2f}. Monitor closely."))
    )
    return _alert(rows, "model_drift_detected", "warning", "Model Drift Detected", text, ["psi"], "_at")


def raise_alerts(parts: Sequence[DataFrame]) -> DataFrame:
    """All new alerts as open rows with a stable id."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    none = F.lit(None)
    return merged.withColumns(
        {
            "alert_id": F.md5(F.to_json(F.struct(*ALERT_COLUMNS)).cast("binary")), "acknowledged_at": none.cast("timestamp_ntz"),
            "acknowledged_by": none.cast("string"), "acknowledged_note": none.cast("string"), "auto_dismissed": F.lit(False),
        }
    )


def audit_query(log: DataFrame, event_type: str | None = None, actor_user_id: str | None = None, patient_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Audit rows by type, actor or patient, newest first."""
    found = filter_by(log, {"event_type": event_type, "actor_user_id": actor_user_id, "patient_id": patient_id})
    return found.orderBy(F.desc("event_at"), "audit_id").offset(offset).limit(limit)


def latest_of(df: DataFrame, c: Column | str) -> Column:
    return df.agg(F.max(col(c)).alias("latest")).scalar()

"""The daily batch: check extracts, mask, stage, gate, build the star schema, refresh marts, score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import checks
from tidemark.operators.features import admission_features, comorbidity_scores
from tidemark.operators.history import lookback_history
from tidemark.operators.masking import MASKED_COLUMNS, mask_table
from tidemark.operators.ranks import latest_per_key
from tidemark.plans import marts, star
from tidemark.plans.staging import stage_admissions, stage_diagnoses, stage_patients
from tidemark.session import written
from tidemark.sources.files import load_staging
from tidemark.sources.versions import Tables, latest_day

TRACKED = ["age_group", "gender", "race_ethnicity", "zip_code_prefix", "state", "primary_language", "insurance_category", "comorbidity_count"]


def quality_rules(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """The gate over staged text tables: keys, orphans, date order, outcome rate, stay."""
    typed = admissions.select(
        "admission_id", "patient_id", F.to_date(F.trim("admission_date")).alias("admission_date"),
        F.nullif(F.trim("discharge_date"), F.lit("")).try_cast("date").alias("discharge_date"),
        F.trim("los_days").try_cast("int").alias("los_days"),
        F.when(F.col("readmitted_30_day").isin("0", "1"), F.col("readmitted_30_day").cast("int")).alias("outcome"),
    )
    found = checks.run_rules(patients, "raw_patients", [checks.key_present("patient_id")])
    found = found.unionByName(
        checks.run_rules(
            typed, "raw_admissions",
            [
                checks.key_present("admission_id"), checks.date_order("admission_date", "discharge_date"), checks.in_range("los_days", 0, 365),
                checks.rate_within("readmission_rate_bounds", "outcome", (0.05, 0.35), 0.50),
            ],
        )
    )
    return found.unionByName(checks.orphan_check(typed, patients, "patient_id", "patient_id", "raw_admissions"))


def _touched(tables: Tables, today: DataFrame, admissions: DataFrame) -> DataFrame:
    """``patient_id`` of the patients who are new or changed today, or have admissions in today's extract."""
    tracked = [c for c in today.columns if c != "loaded_at"]
    own = today.select("patient_id", F.xxhash64(*tracked).alias("_hash"))
    known = tables.read_or_none_of("typed_patients", today).select("patient_id", F.xxhash64(*tracked).alias("_hash"))
    return own.join(known, ["patient_id", "_hash"], "left_anti").select("patient_id").unionByName(admissions.select("patient_id")).distinct()


def run_daily(
    raw: Mapping[str, DataFrame], root: str, key: bytes, as_of: Column, benchmarks: DataFrame, departments: DataFrame,
    min_rows: Mapping[str, int] = checks.SOURCE_MIN_ROWS, diagnosis_dimension: DataFrame | None = None, procedure_dimension: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run every step for the day's extracts ``patients`` and ``admissions``, and ``diagnoses``, ``procedures`` and
    ``vitals`` where given; raises where a gate fails, before any mart.

    All tables live below ``root`` and keep what earlier days have brought: typed rows, facts, features and histories are
    merged by key, so that a corrected admission counts everywhere, and the patient dimension keeps its history. Histories,
    features and the dashboard are made anew only for the patients and months that today's extracts touch. Everything but
    the log of checks becomes known at once, at the end; a run that dies changes nothing, and so does one that is repeated for
    its day.
    """
    spark = raw["admissions"].sparkSession
    checks.gate(checks.source_requirements(raw, min_rows).select("table_name", F.lit("source").alias("check_name"), F.col("row_count").alias("value"), "check_status"))
    staged = {
        name: load_staging(mask_table(df, MASKED_COLUMNS.get(name, {}), key), f"{root}/staging/{name}", as_of.cast("timestamp_ntz"))
        for name, df in raw.items()
    }
    tables, day = Tables(spark, root), latest_day(as_of, spark)
    results = written(quality_rules(staged["patients"], staged["admissions"]), "gate").withColumn("checked_at", as_of)
    tables.put("audit_checks", results, part=day)
    tables.publish()
    checks.gate(results)

    today = written(latest_per_key(stage_patients(staged["patients"], as_of), ["patient_id"], [F.desc("loaded_at")]), "today")
    new_admissions = written(stage_admissions(staged["admissions"]), "new-admissions")
    touched = written(_touched(tables, today, new_admissions), "touched")
    earlier = tables.read_or_none_of("typed_patients", today)
    patients = tables.put("typed_patients", earlier.join(today.select("patient_id"), "patient_id", "left_anti").unionByName(today))
    tables.merge("typed_admissions", new_admissions, "admission_id", "admission_date")
    admissions = tables.read("typed_admissions")
    comorbidity = written(comorbidity_scores(patients), "comorbidity")
    own = written(admissions.join(touched, "patient_id", "left_semi"), "touched-admissions")
    tables.merge("history", lookback_history(own), "admission_id", "admission_date")
    known = tables.read("dim_patient") if "dim_patient" in tables else None
    dimension = tables.put("dim_patient", star.apply_history(known, today, "patient_id", TRACKED, as_of))

    children = {name: staged.get(name) for name in ("procedures", "vitals")}
    children["diagnoses"] = stage_diagnoses(staged["diagnoses"], diagnosis_dimension) if "diagnoses" in staged and diagnosis_dimension is not None else None
    fresh = star.admission_facts(new_admissions, dimension, departments, diagnoses=children["diagnoses"], diagnosis_dimension=diagnosis_dimension)
    tables.merge("fact_admissions", fresh, "admission_id", "admission_date")
    facts = tables.read("fact_admissions")

    def load_new(rows: DataFrame, name: str, keys: list[str]) -> None:
        others = tables.read(name, [p for p in tables.tables[name]["parts"] if p != day]) if name in tables else rows.limit(0)
        tables.put(name, star.insert_if_absent(others, rows, keys), part=day)

    if children["diagnoses"] is not None:
        load_new(star.bridge(children["diagnoses"], facts, diagnosis_dimension, "icd10_code", "diagnosis_key"), "bridge_diagnoses", ["admission_key", "diagnosis_key"])
    if children["procedures"] is not None and procedure_dimension is not None:
        load_new(star.bridge(children["procedures"], facts, procedure_dimension, "cpt_code", "procedure_key"), "bridge_procedures", ["admission_key", "procedure_key"])
    if children["vitals"] is not None:
        measures = [c for c in children["vitals"].columns if c not in ("vital_id", "admission_id", "recorded_at", "loaded_at")]
        load_new(star.vital_facts(children["vitals"], facts, measures), "fact_vitals", ["vital_id"])

    history = tables.read("history")
    months = tables.merge("features", admission_features(own, patients, history, comorbidity), "admission_id", "admission_date")
    in_months = admissions.filter(F.coalesce(F.date_format("admission_date", "yyyy-MM"), F.lit("none")).isin(months))
    period = F.coalesce(F.date_format("period_start", "yyyy-MM"), F.lit("none"))
    tables.put_parts("dashboard", marts.dashboard(in_months, patients, comorbidity, history).withColumn("_month", period), "_month", months)
    features = tables.read("features")
    scores = features.select("admission_id", "patient_id", F.round(scoring.heuristic_score(), 4).alias("risk_score")).withColumns(
        {
            "risk_tier": scoring.risk_tier("risk_score"), "predicted_at": as_of.cast("timestamp_ntz"), "prediction_id": F.col("admission_id"),
            "model_name": F.lit("heuristic"), "model_version": F.lit("1"), "clinician_reviewed": F.lit(False), "actual_outcome": F.lit(None).cast("boolean"),
        }
    )
    aggregates = {
        "predictions": scores,
        "department_performance": marts.department_performance(admissions, benchmarks),
        "risk_cohorts": marts.patient_risk_cohorts(admissions, patients, comorbidity, history),
        "stay_by_category_and_payer": marts.stay_by_category_and_payer(admissions.join(patients.select("patient_id", "insurance_category"), "patient_id"), ["department", "insurance_category"]),
        "score_distribution": marts.score_distribution(scores),
        "high_risk": marts.high_risk_list(scores, admissions, patients.drop("loaded_at"), as_of),
    }
    star.refresh(aggregates, tables)
    return {name: tables.read(name) for name in ("dim_patient", "fact_admissions", "features", "dashboard", *aggregates)}

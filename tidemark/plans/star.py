"""Star schema: dimensions with history, facts, bridges, incremental loads and full views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cleaning import blank_to_null_cast, date_key
from tidemark.operators.joins import insert_if_absent, latest_with_ties, lookup_key
from tidemark.operators.ranks import latest_per_key
from tidemark.sources.versions import Tables

OPEN_END = "9999-12-31"
SPINE_START, SPINE_END = "2019-01-01", "2026-12-31"


def date_spine(spark: SparkSession, start: str = SPINE_START, end: str = SPINE_END) -> DataFrame:
    """One row per day from start to end, both included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(days).alias("full_date"))


def spine_between(df: DataFrame, date: str) -> DataFrame:
    """One row per day from the first to the last date of a table."""
    span = df.agg(F.to_date(F.min(date)).alias("a"), F.to_date(F.max(date)).alias("b")).filter(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("full_date"))


def date_dimension(days: DataFrame, date: str = "full_date") -> DataFrame:
    """Calendar attributes per day: ISO week and weekday, October fiscal year, season."""
    d, month = F.col(date), F.month(date)
    season = (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Fall")
    )
    return days.select(
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        month.alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        (F.floor(F.pmod(month + 2, F.lit(12)) / 3) + 1).cast("int").alias("fiscal_quarter"),
        (F.year(d) + F.when(month >= 10, 1).otherwise(0)).alias("fiscal_year"),
        season.alias("season"),
    )


def surrogate_key(*columns: str | Column) -> Column:
    """Stable key of 128 bits from the business key, as hexadecimal text; the same on every run and in every task."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the tracked columns, with NULL told apart from blank."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def apply_history(
    current: DataFrame | None, incoming: DataFrame, key: str, tracked: Sequence[str], as_of: Column,
    key_column: str = "patient_key",
) -> DataFrame:
    """Type 2 history: expire changed rows, add their new version, insert new keys, keep the rest.

    ``incoming`` holds one row per key. Open rows and incoming rows meet in one full outer join on the key; each pair
    gives one or two rows through an array, so neither side is read twice.
    """
    fresh = incoming.select(key, *tracked).withColumn("row_hash", row_hash(list(tracked)))
    columns = [key_column, key, *tracked, "row_hash", "effective_date", "expiry_date", "is_current"]
    if current is None:
        return fresh.withColumn("effective_date", as_of).withColumns(
            {"expiry_date": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True), key_column: surrogate_key(key, "effective_date")}
        ).select(*columns)
    closed = current.filter(~F.col("is_current")).select(*columns)
    old, new = current.filter("is_current").select(F.struct(*columns).alias("old"), F.col(key).alias("_old_key")), fresh.select(
        F.struct(key, *tracked, "row_hash").alias("new"), F.col(key).alias("_new_key")
    )
    pairs = old.join(new, F.col("_old_key") == F.col("_new_key"), "full")
    known, arrived = F.col("_old_key").isNotNull(), F.col("_new_key").isNotNull()
    changed = F.coalesce(known & arrived & (F.col("old.row_hash") != F.col("new.row_hash")), F.lit(False))
    keep = F.struct(
        *[F.col(f"old.{c}").alias(c) for c in columns[:-2]],
        F.when(changed, as_of).otherwise(F.col("old.expiry_date")).alias("expiry_date"),
        (~changed).alias("is_current"),
    )
    add = F.struct(
        surrogate_key(F.col("_new_key").alias(key), as_of.alias("effective_date")).alias(key_column), F.col("_new_key").alias(key),
        *[F.col(f"new.{c}").alias(c) for c in [*tracked, "row_hash"]],
        as_of.alias("effective_date"), F.lit(OPEN_END).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"),
    )
    rows = F.array(F.when(known, keep), F.when(changed | ~known, add))
    opened = pairs.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))
    return closed.unionByName(opened.select(*columns))


def admission_facts(
    admissions: DataFrame, patients: DataFrame, departments: DataFrame, diagnoses: DataFrame | None = None,
    diagnosis_dimension: DataFrame | None = None, dispositions: DataFrame | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    """Admissions with dimension keys; rows already in ``existing`` are left out, one row per admission id."""
    current = patients.filter("is_current").select("patient_id", "patient_key")
    facts = admissions.join(current, "patient_id")
    facts = lookup_key(facts, departments, "department", "department_name", "department_key")
    if diagnoses is not None and diagnosis_dimension is not None:
        primary = latest_per_key(
            diagnoses.filter(F.col("diagnosis_type") == "Primary"), ["admission_id"], [F.asc_nulls_last("sequence_number"), F.asc("icd10_code")]
        ).select("admission_id", F.col("icd10_code").alias("_code"))
        facts = facts.join(primary, "admission_id", "left")
        facts = lookup_key(facts, diagnosis_dimension, "_code", "icd10_code", "diagnosis_key").drop("_code")
        facts = facts.withColumnRenamed("diagnosis_key", "primary_diagnosis_key")
    if dispositions is not None:
        facts = lookup_key(facts, dispositions, "discharge_disposition", "disposition_name", "disposition_key", ignore_case=True)
    facts = facts.withColumns({"admission_key": surrogate_key("admission_id"), "total_cost_usd": F.col("total_charges")})
    if existing is None:
        return facts.dropDuplicates(["admission_id"])
    return insert_if_absent(existing, facts, ["admission_id"])


def bridge(child: DataFrame, facts: DataFrame, dimension: DataFrame, code: str, dimension_key: str, fields: Sequence[str] = ()) -> DataFrame:
    """Admission and dimension key pairs, each once."""
    keys = facts.select("admission_id", "admission_key")
    codes = dimension.select(code, dimension_key)
    pairs = child.join(keys, "admission_id").join(codes, code)
    return pairs.select("admission_key", dimension_key, *fields).dropDuplicates(["admission_key", dimension_key])


def vital_facts(vitals: DataFrame, facts: DataFrame, measures: Sequence[str], recorded: str = "recorded_at", key: str = "vital_id") -> DataFrame:
    """Vital readings cast to numbers with admission keys, day key and hours since admission, one per id."""
    keys = facts.select("admission_id", "admission_key", "patient_key", "admission_date")
    joined = vitals.join(keys, "admission_id").dropDuplicates([key])
    hours = F.timestamp_diff("SECOND", F.col("admission_date").cast("timestamp_ntz"), F.col(recorded).cast("timestamp_ntz")) / 3600
    return joined.select(
        key, "patient_key", "admission_key", date_key(recorded).alias("date_key"), recorded,
        *[blank_to_null_cast(m, "double").alias(m) for m in measures], hours.alias("hours_since_admit"),
    )


def with_diagnosis_and_disposition(facts: DataFrame, diagnoses: DataFrame | None, dispositions: DataFrame | None) -> DataFrame:
    """Adds the primary diagnosis (by ``diagnosis_key``) and the disposition (by ``disposition_key``) of facts that have
    their keys; facts without one keep NULLs."""
    if diagnoses is not None:
        facts = facts.join(diagnoses.withColumnRenamed("diagnosis_key", "primary_diagnosis_key"), "primary_diagnosis_key", "left")
    if dispositions is not None:
        facts = facts.join(dispositions, "disposition_key", "left")
    return facts


def full_view(
    facts: DataFrame, patients: DataFrame, dates: DataFrame, departments: DataFrame, diagnoses: DataFrame | None = None, dispositions: DataFrame | None = None
) -> DataFrame:
    """Every admission with its current patient row, both calendar roles, the department, the primary diagnosis and the
    disposition."""
    admit = dates.select(
        F.col("date_key").alias("admit_date_key"), F.col("full_date").alias("admit_date"), F.col("year").alias("admit_year"),
        F.col("quarter").alias("admit_quarter"), F.col("month").alias("admit_month"), F.col("day_name").alias("admit_day_name"),
        F.col("is_weekend").alias("admitted_on_weekend"),
    )
    left = dates.select(F.col("date_key").alias("discharge_date_key"), F.col("full_date").alias("discharge_date"))
    drop = [c for c in ("admission_date", "discharge_date", "department", "patient_id") if c in facts.columns]
    view = (
        facts.drop(*drop).join(patients.filter("is_current"), "patient_key").join(admit, "admit_date_key")
        .join(left, "discharge_date_key", "left").join(departments, "department_key", "left")
    )
    return with_diagnosis_and_disposition(view, diagnoses, dispositions)


def current_high_risk(scores: DataFrame, facts: DataFrame, patients: DataFrame, diagnoses: DataFrame | None = None, dispositions: DataFrame | None = None) -> DataFrame:
    """High and critical rows whose prediction time is the newest of their admission, with diagnosis and disposition; ties
    are kept."""
    newest = latest_with_ties(scores, "admission_id", "predicted_at")
    high = newest.filter(F.col("risk_tier").isin("high", "critical")).drop("patient_id")
    facts = with_diagnosis_and_disposition(facts, diagnoses, dispositions)
    return high.join(facts, "admission_id").join(patients.filter("is_current"), "patient_key").orderBy(F.desc("risk_score"))


def incremental_merge(existing: DataFrame, incoming: DataFrame, key: str, date: str, lateness_days: int = 0) -> DataFrame:
    """Rows newer than the newest known day less the allowance replace or join the known ones by key.

    With no allowance a late row is passed over, as a plain high-water mark does.
    """
    newest = existing.agg(F.date_sub(F.max(date), lateness_days).alias("mark")).scalar()
    fresh = incoming.filter(F.coalesce(F.col(date) > newest, newest.isNull()))
    fresh = latest_per_key(fresh, [key], [F.desc(date)])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def refresh(aggregates: Mapping[str, DataFrame], tables: Tables) -> Tables:
    """Recompute each aggregate table and make all of them known at once, with what else has changed in ``tables``."""
    for name, frame in aggregates.items():
        tables.put(name, frame)
    tables.publish()
    return tables

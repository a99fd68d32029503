"""Data-quality rules and monitors.

All rules of a table are folded into one aggregation, so a table is scanned once however many rules it has.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions.cleaning import col
from tidemark.functions.scoring import status_rank
from tidemark.operators.joins import orphans
from tidemark.operators.ranks import chunked_lag, latest_per_key, top_per_group

# Monitor thresholds and source requirements.
ROW_COUNT_Z = 3.0
NULL_RATE_WARN, NULL_RATE_CRITICAL = 0.05, 0.20
DRIFT_P_VALUE = 0.01
FRESHNESS_HOURS = 6
UNKNOWN_AGE_HOURS = 999
SOURCE_MIN_ROWS = {"patients": 100, "admissions": 500, "diagnoses": 500, "procedures": 100, "vitals": 500, "medications": 100}
SOURCE_COLUMNS = {
    "patients": ["patient_id", "mrn", "age", "gender", "ethnicity", "insurance_type"],
    "admissions": [
        "admission_id", "patient_id", "admission_date", "discharge_date", "los_days", "department", "readmitted_30_day",
        "total_charges",
    ],
    "diagnoses": ["diagnosis_id", "admission_id", "icd10_code", "diagnosis_type"],
    "procedures": ["procedure_id", "admission_id", "cpt_code"],
    "vitals": ["vital_id", "admission_id", "recorded_at", "heart_rate", "systolic_bp", "diastolic_bp", "spo2_pct"],
    "medications": ["medication_id", "admission_id", "medication_name"],
}


@dataclass(frozen=True)
class Rule:
    """A named aggregate with limits; outside ``warn`` is WARN, outside ``fail`` is FAIL."""

    name: str
    value: Column
    fail_above: float | None = 0
    warn_above: float | None = None
    fail_below: float | None = None
    warn_below: float | None = None

    def status(self, value: Column) -> Column:
        outside = lambda high, low: reduce(
            lambda a, b: a | b,
            [F.lit(False)] + ([value > high] if high is not None else []) + ([value < low] if low is not None else []),
        )
        return F.when(outside(self.fail_above, self.fail_below), "FAIL").when(
            outside(self.warn_above, self.warn_below), "WARN"
        ).otherwise("PASS")


def null_rate(c: str, limit: float) -> Rule:
    return Rule(f"null_rate_{c}", F.avg(F.col(c).isNull().cast("int")), fail_above=limit)


def not_null(c: str) -> Rule:
    return Rule(f"not_null_{c}", F.count_if(F.col(c).isNull()))


def in_range(c: str, low: float | None = None, high: float | None = None) -> Rule:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(c) < low)
    if high is not None:
        bad = bad | (F.col(c) > high)
    return Rule(f"range_{c}", F.count_if(bad))


def in_domain(c: str, allowed: Sequence[Any], null_is_bad: bool = True) -> Rule:
    return Rule(f"domain_{c}", F.count_if(_outside_domain(c, allowed, null_is_bad)))


def _outside_domain(c: str, allowed: Sequence[Any], null_is_bad: bool = True) -> Column:
    bad = ~F.col(c).isin(list(allowed))
    return F.coalesce(bad, F.lit(True)) if null_is_bad else bad


def unique(c: str) -> Rule:
    """Rows beyond the first of each key; NULL counts as one key."""
    distinct = F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    return Rule(f"unique_{c}", F.coalesce(F.count(F.lit(1)) - distinct, F.lit(0)))


def key_present(c: str) -> Rule:
    return Rule(f"null_{c}", F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")))


def date_order(start: str, end: str) -> Rule:
    return Rule(f"order_{start}_{end}", F.count_if(F.col(end) < F.col(start)))


def rate_within(name: str, flag: Column | str, warn: tuple[float, float], fail_above: float) -> Rule:
    """Mean of a 0/1 column against a normal band (WARN) and an impossible level (FAIL)."""
    return Rule(name, F.avg(col(flag).cast("int")), fail_above=fail_above, warn_above=warn[1], warn_below=warn[0])


def run_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with value and status, from one aggregation of the table."""
    one = df.agg(*[F.coalesce(r.value.cast("double"), F.lit(0.0)).alias(f"_{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(r.name).alias("check_name"), F.col(f"_{i}").alias("value"),
            r.status(F.col(f"_{i}")).alias("check_status"),
        )
        for i, r in enumerate(rules)
    ]
    return one.select(F.inline(F.array(*rows)))


def orphan_check(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, table: str) -> DataFrame:
    """The orphan count as a rule row."""
    return run_rules(orphans(children, parents, child_key, parent_key), table, [Rule(f"orphan_{child_key}", F.count(F.lit(1)))])


def domain_samples(df: DataFrame, domains: Mapping[str, Sequence[Any]], k: int = 3) -> DataFrame:
    """Up to ``k`` smallest disallowed values per column (NULL is one), limited before the shuffle."""
    tall = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"), F.col(c).cast("string").alias("bad_value"),
                        _outside_domain(c, allowed).alias("_bad"),
                    )
                    for c, allowed in domains.items()
                ]
            )
        )
    ).filter("_bad").select("column_name", "bad_value").distinct()
    return top_per_group(tall, ["column_name"], [F.asc_nulls_first("bad_value")], k)


def source_requirements(
    tables: Mapping[str, DataFrame], min_rows: Mapping[str, int] = SOURCE_MIN_ROWS,
    columns: Mapping[str, Sequence[str]] = SOURCE_COLUMNS,
) -> DataFrame:
    """Row count and missing columns of every source, PASS only if both are in order."""
    parts = []
    for name, df in tables.items():
        missing = [c for c in columns.get(name, []) if c not in df.columns]
        n = F.count(F.lit(1))
        ok = (n >= min_rows.get(name, 0)) & F.lit(not missing)
        parts.append(
            df.agg(n.alias("row_count"), F.when(ok, "PASS").otherwise("FAIL").alias("check_status")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(",".join(missing)).alias("missing_columns"), "check_status"
            )
        )
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class ColumnTests:
    """Declared expectations of one column; NULL passes everything but ``not_null``."""

    column: str
    not_null: bool = False
    unique: bool = False
    accepted: Sequence[Any] = field(default_factory=tuple)
    low: float | None = None
    high: float | None = None

    def rules(self) -> list[Rule]:
        found = []
        if self.not_null:
            found.append(not_null(self.column))
        if self.unique:
            found.append(unique(self.column))
        if self.accepted:
            found.append(in_domain(self.column, self.accepted, null_is_bad=False))
        if self.low is not None or self.high is not None:
            found.append(in_range(self.column, self.low, self.high))
        return found


def run_column_tests(df: DataFrame, table: str, tests: Sequence[ColumnTests]) -> DataFrame:
    return run_rules(df, table, [rule for t in tests for rule in t.rules()])


def summarise(results: DataFrame, status: str = "check_status") -> DataFrame:
    """One row: checks in total and by status."""
    is_ = lambda *names: F.count_if(F.lower(status).isin(list(names)))
    return results.agg(
        F.count(F.lit(1)).alias("total_checks"),
        is_("pass", "ok").alias("passed"),
        is_("warn", "warning").alias("warned"),
        is_("fail", "critical").alias("failed"),
    )


def gate(results: DataFrame) -> None:
    """Raise if any rule failed; reads only the names of failed rules."""
    failed = results.filter(F.col("check_status") == "FAIL").select("table_name", "check_name", "value").collect()
    if failed:
        raise ValueError("Data quality checks failed: " + "; ".join(f"{t}.{c}: {v:g}" for t, c, v in failed))


def _period(date: str, check_date: str, days: int) -> tuple[Column, Column]:
    """Conditions for the checked day and for the days before it."""
    day, on = F.to_date(date), F.lit(check_date).cast("date")
    return day == on, (day >= F.date_sub(on, days)) & (day < on)


def row_count_anomaly(df: DataFrame, table: str, date: str, check_date: str, days: int = 31, least_days: int = 5, z_limit: float = ROW_COUNT_Z) -> DataFrame:
    """Rows of the day against the daily counts of the days before, as a z-score; too little history is a skip."""
    on_day, before = _period(date, check_date, days)
    daily = df.filter(on_day | before).groupBy(F.to_date(date).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    today = F.col("_day") == F.lit(check_date).cast("date")
    earlier = F.when(~today, F.col("_n"))
    one = daily.agg(
        F.coalesce(F.sum(F.when(today, F.col("_n"))), F.lit(0)).alias("today_count"),
        F.count(earlier).alias("history_days"), F.avg(earlier).alias("_mean"), F.stddev_pop(earlier).alias("_std"),
    )
    z = F.when(F.col("_std") > 0, (F.col("today_count") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    status = (
        F.when(F.col("history_days") < least_days, "skip").when(F.abs(z) > z_limit * 1.5, "critical")
        .when(F.abs(z) > z_limit, "warning").otherwise("ok")
    )
    return one.select(
        F.lit("row_count").alias("check_name"), F.lit(table).alias("table_name"), "today_count", "history_days",
        F.round("_mean", 1).alias("mean"), F.round("_std", 1).alias("std"), F.round(z, 2).alias("z_score"), status.alias("status"),
    )


def null_rate_change(
    df: DataFrame, table: str, date: str, check_date: str, required: Sequence[str], nullable: Sequence[str], days: int = 30
) -> DataFrame:
    """NULL rate of the day against the days before, per column, both periods in one scan."""
    on_day, before = _period(date, check_date, days)
    columns = [*required, *nullable]
    rate = lambda when, c: F.coalesce(F.avg(F.when(when, F.col(c).isNull().cast("int"))), F.lit(0.0))
    one = df.filter(on_day | before).agg(
        *[rate(on_day, c).alias(f"_now_{c}") for c in columns], *[rate(before, c).alias(f"_was_{c}") for c in columns]
    )
    rows = []
    for c in columns:
        now, was = F.col(f"_now_{c}"), F.col(f"_was_{c}")
        status = (
            F.when(F.lit(c in required) & (now > 0), "critical").when(now - was > NULL_RATE_CRITICAL, "critical")
            .when(now - was > NULL_RATE_WARN, "warning").otherwise("ok")
        )
        rows.append(
            F.struct(
                F.lit("null_rate").alias("check_name"), F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                F.round(now, 4).alias("current_null_rate"), F.round(was, 4).alias("baseline_null_rate"),
                F.round(now - was, 4).alias("delta"), F.lit(c in required).alias("required"), status.alias("status"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


@pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution for whole degrees of freedom (one row per tested column)."""

    def tail(x: float, k: int) -> float:
        if x <= 0:
            return 1.0
        half, odd = x / 2.0, k % 2 / 2.0
        logs = [(i + odd) * math.log(half) - half - math.lgamma(i + odd + 1) for i in range(k // 2)]  # each term may underflow alone
        top = max(logs, default=0.0)
        rest = math.exp(top) * math.fsum(math.exp(v - top) for v in logs)
        return min(1.0, rest + (math.erfc(math.sqrt(half)) if odd else 0.0))

    return pd.Series([tail(float(x), int(k)) if k > 0 else 1.0 for x, k in zip(statistic, freedom)])


def category_drift(df: DataFrame, table: str, column: str, date: str, check_date: str, days: int = 30) -> DataFrame:
    """Chi-square test of the day's category counts against the scaled counts before, with +0.5 on both sides.

    No row when either side is empty or the day has a single category.
    """
    on_day, before = _period(date, check_date, days)
    counts = df.filter(on_day | before).groupBy(column).agg(
        F.count_if(before).alias("baseline_count"), F.count_if(on_day).alias("current_count")
    )
    ratio = F.sum("current_count") / F.nullif(F.sum("baseline_count"), F.lit(0))
    expected = F.col("baseline_count") * F.col("_scale") + 0.5
    part = F.pow(F.col("current_count") + 0.5 - expected, 2) / expected
    tested = counts.withColumn("_scale", counts.agg(ratio.alias("scale")).scalar()).agg(
        F.sum(part).alias("_chi"), F.count(F.lit(1)).alias("_cells"), F.sum("baseline_count").alias("_b"),
        F.count_if(F.col("current_count") > 0).alias("_today"),
    ).filter((F.col("_b") > 0) & (F.col("_today") >= 2))
    p = chi_square_tail("_chi", F.col("_cells") - 1)
    return tested.withColumn("_p", p).select(
        F.lit("distribution_drift").alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        F.round("_chi", 4).alias("chi2_statistic"), F.round("_p", 6).alias("p_value"),
        F.when(F.col("_p") < DRIFT_P_VALUE, "critical").otherwise("ok").alias("status"),
    )


@dataclass(frozen=True)
class Monitored:
    """What to watch in one table."""

    frame: DataFrame
    date: str
    required: Sequence[str] = ()
    nullable: Sequence[str] = ()
    categories: Sequence[str] = ()


def run_monitor(tables: Mapping[str, Monitored], check_date: str) -> DataFrame:
    """All monitor checks of all tables; a table that lacks a watched column gives one critical error row."""
    parts = []
    for name, m in tables.items():
        missing = [c for c in [m.date, *m.required, *m.nullable, *m.categories] if c not in m.frame.columns]
        if missing:
            parts.append(
                m.frame.sparkSession.createDataFrame(
                    [("table_error", name, ",".join(missing), "critical")], "check_name string, table_name string, column_name string, status string"
                )
            )
            continue
        parts.append(row_count_anomaly(m.frame, name, m.date, check_date))
        if m.required or m.nullable:
            parts.append(null_rate_change(m.frame, name, m.date, check_date, m.required, m.nullable))
        parts += [category_drift(m.frame, name, c, m.date, check_date) for c in m.categories]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_count_delta(df: DataFrame, snapshot: str, limit_pct: float = 2.0, chunk: Column | None = None) -> DataFrame:
    """Percent change of row count between consecutive snapshots (one row per snapshot).

    Snapshots are ordered within chunks, which must follow each other as the snapshots do: months, unless given.
    """
    counts = df.groupBy(snapshot).agg(F.count(F.lit(1)).alias("row_count"))
    counts = chunked_lag(counts, [], [snapshot], ["row_count"], chunk if chunk is not None else F.date_format(snapshot, "yyyy-MM"))
    previous = F.col("previous_row_count")
    delta = F.round(F.abs(F.col("row_count") - previous) * 100 / previous, 2)
    return counts.select(
        snapshot, "row_count", previous.alias("previous_count"), delta.alias("delta_pct"),
        F.when(delta < limit_pct, "pass").when(delta.isNotNull(), "warn").otherwise("pass").alias("status"),
    )


def outlier_count(df: DataFrame, value: str, z_limit: float = 3.0) -> DataFrame:
    """Rows whose value lies more than ``z_limit`` deviations from the mean."""
    stats = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    mean, std = stats.select("m").scalar(), stats.select("s").scalar()
    scored = df.select(F.col(value), mean.alias("_m"), std.alias("_s"))
    beyond = F.abs(F.col(value) - F.col("_m")) > z_limit * F.col("_s")
    return scored.agg(F.count_if(beyond).alias("outlier_rows"), F.count(value).alias("rows_checked"))


def latest_checks(results: DataFrame, table: str | None = None, status: str | None = None) -> DataFrame:
    """Newest result of every check and table, worst first; filters apply before the newest is chosen."""
    if table:
        results = results.filter(F.col("table_name") == table)
    if status:
        results = results.filter(F.col("status") == status)
    newest = latest_per_key(results, ["check_name", "table_name"], [F.desc("checked_at"), F.desc("check_id")])
    return newest.orderBy(status_rank("status"), "check_name", "table_name")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of every job, newest first."""
    newest = latest_per_key(runs, ["pipeline_name"], [F.desc("started_at"), F.desc("run_id")])
    return newest.orderBy(F.desc("started_at"), "pipeline_name")


def recent_runs(runs: DataFrame, n: int = 30, name: str | None = None) -> DataFrame:
    if name:
        runs = runs.filter(F.col("pipeline_name") == name)
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def freshness(runs: DataFrame, as_of: Column, sla_hours: float = FRESHNESS_HOURS) -> DataFrame:
    """Hours since the last successful run and whether that is within the limit; never run counts as 999 hours."""
    last = F.max(F.when(F.col("status") == "success", F.col("ended_at")))
    one = runs.agg(last.alias("last_successful_run")).withColumn("_as_of", as_of)
    seconds = F.timestamp_diff("SECOND", F.col("last_successful_run"), F.col("_as_of"))
    hours = F.coalesce(seconds / 3600, F.lit(float(UNKNOWN_AGE_HOURS)))
    return one.select(
        "last_successful_run", F.round(hours, 1).alias("hours_since_last_run"), (hours < sla_hours).alias("freshness_sla_met"),
        F.lit(sla_hours).alias("freshness_sla_threshold_hours"),
    )

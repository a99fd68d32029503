"""Benchmark, dashboard, stay, score-distribution and headline marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.cleaning import period_start
from tidemark.operators.aggregates import exact, flag_sum, rounded_mean, share
from tidemark.operators.joins import with_default
from tidemark.operators.ranks import latest_per_key

DEFAULT_BENCHMARK = "0.15"


def monthly_by_department(admissions: DataFrame, department: str = "department", date: str = "admission_date") -> DataFrame:
    """Volume, outcome rate, stay, cost, intensive days and emergencies per department and month."""
    return admissions.groupBy(
        F.coalesce(F.col(department), F.lit("Unknown")).alias("department_name"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
    ).agg(
        F.count(F.lit(1)).alias("total_admissions"),
        flag_sum("readmit_30day_flag").alias("total_readmissions"),
        share("readmit_30day_flag").alias("readmission_rate"),
        rounded_mean("length_of_stay_days", 2).alias("avg_los_days"),
        rounded_mean("total_charges", 2).alias("avg_cost_usd"),
        F.sum("total_charges").alias("total_cost_usd"),
        F.sum("icu_days").alias("total_icu_days"),
        flag_sum("emergency_flag").alias("emergency_count"),
        share("emergency_flag").alias("emergency_rate"),
    ).withColumn("period_start", period_start("year", "month"))


def department_performance(admissions: DataFrame, benchmarks: DataFrame, default: str = DEFAULT_BENCHMARK) -> DataFrame:
    """Monthly rate against benchmark with month change, three-row mean, stars and label.

    The windows run over one row per department and month, so they stay small whatever the admissions' skew.
    """
    rate = lambda c: F.col(c).cast("decimal(10,4)")
    monthly = with_default(
        monthly_by_department(admissions), benchmarks, "department_name", "benchmark_readmission_rate",
        F.lit(default).cast("decimal(10,4)"),
    )
    delta = F.round(rate("readmission_rate") - rate("benchmark_readmission_rate"), 4)
    in_time = Window.partitionBy("department_name").orderBy("period_start")
    last_three = in_time.rowsBetween(-2, 0)
    previous = F.lag("readmission_rate").over(in_time)
    return (
        monthly.withColumns(
            {
                "vs_benchmark_delta": delta,
                "prior_month_readmission_rate": previous,
                "mom_readmission_delta": F.round(F.coalesce(F.col("readmission_rate") - previous, F.lit(0)), 4),
                "rolling_3m_avg": F.round(F.avg(rate("readmission_rate")).over(last_three), 4),
            }
        )
        .withColumns(
            {
                "cms_star_rating": scoring.star_rating("vs_benchmark_delta"),
                "performance_label": scoring.performance_label("vs_benchmark_delta"),
            }
        )
        .orderBy(F.desc("period_start"), F.desc("vs_benchmark_delta"), "department_name")
    )


def dashboard(admissions: DataFrame, patients: DataFrame, comorbidity: DataFrame, history: DataFrame) -> DataFrame:
    """Month, department and category summary with distinct patients, median stay and history context."""
    people = patients.select("patient_id", "age", "age_group", "comorbidity_count").join(
        comorbidity.select("patient_id", "charlson_comorbidity_index"), "patient_id", "left"
    )
    past = history.select("admission_id", "prior_readmissions_1y", "high_utilizer_flag")
    base = admissions.join(people, "patient_id", "left").join(past, "admission_id", "left")
    date = F.col("admission_date")
    return base.groupBy(
        F.trunc(date, "month").alias("period_start"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.date_format(date, "MMMM").alias("month_name"),
        F.quarter(date).alias("quarter"),
        F.coalesce("department", F.lit("Unknown")).alias("department_name"),
        F.coalesce("primary_diagnosis_category", F.lit("Unknown")).alias("diagnosis_category"),
    ).agg(
        F.count(F.lit(1)).alias("total_admissions"),
        F.countDistinct("patient_id").alias("unique_patients"),
        flag_sum("readmit_30day_flag").alias("total_readmissions"),
        share("readmit_30day_flag", 2, 100).alias("readmission_rate_pct"),
        rounded_mean("length_of_stay_days", 2).alias("avg_los_days"),
        F.percentile("length_of_stay_days", 0.5).alias("median_los_days"),
        rounded_mean("total_charges", 2).alias("avg_cost_usd"),
        F.round(F.sum("total_charges"), 2).alias("total_cost_usd"),
        F.sum("icu_days").alias("total_icu_days"),
        rounded_mean("icu_days", 2).alias("avg_icu_days"),
        flag_sum("icu_flag").alias("icu_admissions"),
        flag_sum("emergency_flag").alias("emergency_admissions"),
        share("emergency_flag", 2, 100).alias("emergency_rate_pct"),
        rounded_mean("age", 1).alias("avg_age"),
        F.count_if(F.col("age_group") == "76+").alias("patients_76_plus"),
        rounded_mean("comorbidity_count", 2).alias("avg_comorbidity_count"),
        rounded_mean("charlson_comorbidity_index", 2).alias("avg_cci_score"),
        flag_sum("high_utilizer_flag").alias("high_utilizer_admissions"),
        F.sum("prior_readmissions_1y").alias("total_prior_readmissions_1y"),
    )


def department_month_view(facts: DataFrame, departments: DataFrame, dates: DataFrame) -> DataFrame:
    """Department and month summary over the star schema, with the benchmark of the department dimension."""
    day = dates.select("date_key", "year", "month", "month_name")
    keys = ["department_key", "department_name", "service_line", "benchmark_readmission_rate", "year", "month", "month_name"]
    joined = facts.join(departments, "department_key").join(day, facts.admit_date_key == day.date_key)
    monthly = joined.groupBy(*keys).agg(
        F.count("admission_key").alias("total_admissions"),
        flag_sum("readmit_30day_flag").alias("total_readmissions"),
        share("readmit_30day_flag").alias("readmission_rate"),
        rounded_mean("length_of_stay_days", 2).alias("avg_los_days"),
        rounded_mean("total_cost_usd", 2).alias("avg_cost_usd"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.sum("icu_days").alias("total_icu_days"),
        flag_sum("emergency_flag").alias("emergency_admissions"),
    )
    delta = F.col("readmission_rate") - F.col("benchmark_readmission_rate").cast("decimal(10,4)")
    return monthly.withColumns({"period_start": period_start("year", "month"), "vs_benchmark": F.round(delta, 4)})


def stay_by_category_and_payer(facts: DataFrame, keys: list[str], date: str = "admission_date") -> DataFrame:
    """Stay, cost and outcome per category, payer and quarter: mean, median, p90 and sample deviation."""
    known = facts
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    return known.groupBy(*keys, F.year(date).alias("year"), F.quarter(date).alias("quarter")).agg(
        F.count(F.lit(1)).alias("total_admissions"),
        rounded_mean("length_of_stay_days", 2).alias("avg_los_days"),
        F.percentile("length_of_stay_days", 0.5).alias("median_los_days"),
        F.percentile("length_of_stay_days", 0.9).alias("p90_los_days"),
        F.round(F.stddev_samp("length_of_stay_days").cast("decimal(20,8)"), 2).alias("stddev_los_days"),
        rounded_mean("total_charges", 2).alias("avg_cost_usd"),
        rounded_mean("icu_days", 2).alias("avg_icu_days"),
        flag_sum("readmit_30day_flag").alias("readmissions"),
        share("readmit_30day_flag").alias("readmission_rate"),
    )


def score_distribution(scores: DataFrame, score: str = "risk_score", ts: str = "predicted_at") -> DataFrame:
    """Daily score spread per model and tier; scores hold four decimals, so exact quantiles stay small."""
    quartiles = F.percentile(score, [0.25, 0.5, 0.75, 0.9])
    grouped = scores.groupBy(
        F.to_date(ts).alias("score_date"), "model_name", "model_version", "risk_tier"
    ).agg(
        F.count(F.lit(1)).alias("patient_count"),
        F.round(F.avg(exact(score)), 4).alias("avg_risk_score"),
        F.round(F.min(score), 4).alias("min_risk_score"),
        F.round(F.max(score), 4).alias("max_risk_score"),
        quartiles.alias("_q"),
        share("clinician_reviewed").alias("clinician_review_rate"),
        F.count("actual_outcome").alias("outcomes_available"),
        F.count_if(F.col("actual_outcome")).alias("true_positives"),
    )
    names = ["p25_risk_score", "median_risk_score", "p75_risk_score", "p90_risk_score"]
    return grouped.withColumns({n: F.col("_q")[i] for i, n in enumerate(names)}).drop("_q")


def kpi_summary(admissions: DataFrame, scores: DataFrame, as_of: Column, score_as_of: Column, days: int = 30) -> DataFrame:
    """One row of headline figures; every part is a one-row aggregate used as a scalar."""
    recent = admissions.filter(F.col("admission_date") >= F.date_sub(as_of, days)).agg(
        F.countDistinct("patient_id").alias("total_patients"),
        F.count(F.lit(1)).alias("total_admissions_30d"),
        F.coalesce(flag_sum("readmit_30day_flag"), F.lit(0)).alias("total_readmissions_30d"),
        F.coalesce(share("readmit_30day_flag", 2, 100), F.lit(0)).alias("avg_readmission_rate_pct"),
        F.coalesce(rounded_mean("length_of_stay_days", 2), F.lit(0)).alias("avg_los_days"),
        F.coalesce(rounded_mean("total_charges", 2), F.lit(0)).alias("avg_cost_usd"),
        F.coalesce(F.sum("total_charges"), F.lit(0)).alias("total_cost_30d"),
    )
    day_before = score_as_of - F.expr("INTERVAL 24 HOURS")
    high = scores.agg(F.count_if(F.col("risk_tier").isin("high", "critical")).alias("n")).scalar()
    mean = scores.filter(F.col("predicted_at") >= day_before).agg(F.round(F.avg(exact("risk_score")), 4).alias("m")).scalar()
    departments = admissions.agg(F.countDistinct("department").alias("n")).scalar()
    return recent.withColumns(
        {"high_risk_patients_today": high, "avg_risk_score": F.coalesce(mean, F.lit(0)), "department_count": departments}
    )


def patient_risk_cohorts(admissions: DataFrame, patients: DataFrame, comorbidity: DataFrame, history: DataFrame) -> DataFrame:
    """Current cohort of every patient, from the latest admission and the history before it."""
    latest = latest_per_key(
        admissions.select(
            "patient_id", "admission_id", "admission_date", "department", "length_of_stay_days", "icu_flag",
            "readmit_30day_flag", "total_charges",
        ),
        ["patient_id"],
        [F.col("admission_date").desc_nulls_first(), F.col("admission_id").desc()],
    )
    people = patients.select(
        "patient_id", "age", "age_group", "gender", "race_ethnicity", "insurance_category", "comorbidity_count"
    )
    index = comorbidity.select("patient_id", "charlson_comorbidity_index", "cci_risk_tier", "estimated_10yr_survival")
    past = history.drop("patient_id", "admission_date", "last_discharge_date")
    joined = latest.join(people, "patient_id", "left").join(index, "patient_id", "left").join(past, "admission_id", "left")
    cohort = scoring.risk_cohort(
        "charlson_comorbidity_index", "prior_readmissions_1y", "icu_flag", "prior_admissions_90d",
        "prior_admissions_12m", "high_utilizer_flag",
    )
    renamed = joined.withColumnsRenamed(
        {
            "admission_id": "latest_admission_id",
            "admission_date": "latest_admission_date",
            "department": "latest_department",
            "length_of_stay_days": "latest_los_days",
            "readmit_30day_flag": "latest_readmit_flag",
            "total_charges": "latest_charges",
        }
    ).withColumns({"risk_cohort": cohort, "sdoh_risk_flag": F.col("insurance_category") == "Medicaid"})
    return renamed.withColumn("risk_cohort_rank", scoring.cohort_rank("risk_cohort"))


def high_risk_list(
    scores: DataFrame, admissions: DataFrame, patients: DataFrame, as_of: Column, days: int = 7,
    entity: str = "admission_id",
) -> DataFrame:
    """Latest high or critical score per admission, recent admissions only, current patients only."""
    latest = latest_per_key(
        scores.filter(F.col("risk_tier").isin("high", "critical")),
        [entity],
        [F.col("predicted_at").desc(), F.col("prediction_id").desc()],
    ).drop("patient_id")
    recent = admissions.filter(F.col("admission_date") >= F.date_sub(as_of, days))
    return latest.join(recent, entity).join(patients, "patient_id").orderBy(F.desc("risk_score"), entity)

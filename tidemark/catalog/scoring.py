"""Derived score and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.summaries import DEPARTMENT_PERFORMANCE
from tidemark.functions import scoring as s
from tidemark.operators.features import admission_features, comorbidity_scores
from tidemark.operators.history import lookback_history
from tidemark.operators.scores import scored_or_heuristic, unscored
from tidemark.plans import marts
from tidemark.plans.staging import stage_admissions

FEATURES = """features AS (
SELECT a.admission_id, a.patient_id, a.admission_date, a.discharge_date, CAST(a.readmit_30day_flag AS BIGINT) AS readmit_30day_flag, CAST(coalesce(p.age, 0) AS BIGINT) AS age,
 CAST(CASE age_group WHEN '18-30' THEN 0 WHEN '31-45' THEN 1 WHEN '46-60' THEN 2 WHEN '61-75' THEN 3 ELSE 4 END AS BIGINT) AS age_group_encoded,
 CAST(CASE gender WHEN 'Male' THEN 0 WHEN 'Female' THEN 1 ELSE 2 END AS BIGINT) AS gender_encoded,
 CAST(CASE insurance_category WHEN 'Medicare' THEN 0 WHEN 'Medicaid' THEN 1 WHEN 'Commercial' THEN 2 ELSE 3 END AS BIGINT) AS insurance_encoded,
 CAST(coalesce(p.comorbidity_count, 0) AS BIGINT) AS comorbidity_count, CAST(coalesce(charlson_comorbidity_index, 0) AS BIGINT) AS charlson_comorbidity_index,
 CAST(has_diabetes AS BIGINT) AS has_diabetes, CAST(has_hypertension AS BIGINT) AS has_hypertension, CAST(has_chf AS BIGINT) AS has_chf, CAST(has_copd AS BIGINT) AS has_copd,
 CAST(has_ckd AS BIGINT) AS has_ckd, CAST(has_afib AS BIGINT) AS has_afib, CAST(has_obesity AS BIGINT) AS has_obesity, CAST(has_depression AS BIGINT) AS has_depression,
 CAST(coalesce(length_of_stay_days, 0) AS BIGINT) AS length_of_stay_days, CAST(coalesce(icu_days, 0) AS BIGINT) AS icu_days, CAST(icu_flag AS BIGINT) AS icu_flag, CAST(emergency_flag AS BIGINT) AS emergency_flag,
 CAST(coalesce(total_charges, 0) AS DOUBLE) AS total_charges, CAST(CASE admission_type WHEN 'Emergency' THEN 2 WHEN 'Urgent' THEN 1 ELSE 0 END AS BIGINT) AS admission_type_encoded,
 isodow(a.admission_date) AS admit_day_of_week, CAST(isodow(a.admission_date) IN (6, 7) AS BIGINT) AS admitted_on_weekend, month(a.admission_date) AS admit_month,
 prior_admissions_12m, prior_admissions_90d, prior_readmissions_1y, prior_icu_stays, mean2 AS prior_los_avg_days, CAST(high_utilizer_flag AS BIGINT) AS high_utilizer_flag,
 CAST(coalesce(days_since_last_discharge, -1) AS BIGINT) AS days_since_last_discharge
FROM stg_admissions a LEFT JOIN stg_patients p ON p.patient_id = a.patient_id LEFT JOIN cci c ON c.patient_id = a.patient_id LEFT JOIN history h ON h.admission_id = a.admission_id
LEFT JOIN (SELECT c.admission_id, coalesce(""" + v.mean_sql("p.length_of_stay_days", 2) + """, 0) AS mean2 FROM stg_admissions c LEFT JOIN stg_admissions p ON p.patient_id = c.patient_id
 AND p.admission_date < c.admission_date AND p.admission_date >= c.admission_date - INTERVAL 12 MONTH GROUP BY 1) m ON m.admission_id = a.admission_id)"""
FEATURE_TABLES = (*v.ADMISSION_TABLES, *v.PATIENT_TABLES, v.COMORBIDITY, v.HISTORY, FEATURES)

HEURISTIC = "least(0.95, charlson_comorbidity_index * 0.05::DOUBLE + prior_readmissions_1y * 0.12::DOUBLE + high_utilizer_flag * 0.10::DOUBLE + prior_admissions_12m * 0.04::DOUBLE + coalesce(icu_flag, 0) * 0.08::DOUBLE + 0.10::DOUBLE)"


def build_features(spark, sf):
    return admission_features(
        v.admissions(spark, sf), v.patients(spark, sf), v.history(spark, sf), v.comorbidity(spark, sf)
    )


def features(spark, sf):
    return v.stored(spark, sf, "features", lambda: build_features(spark, sf))


#: Columns of the staged admissions that ``some_features`` reads.
SCORED = (
    "admission_id", "patient_id", "admission_date", "discharge_date", "readmit_30day_flag", "length_of_stay_days", "icu_days", "icu_flag", "emergency_flag",
    "admission_type", "total_charges",
)


def some_features(spark, sf, *columns):
    """Some columns of the feature table: of the admissions only what scores and histories read is staged, neither history nor features
    are stored, and no join carries another column."""
    admissions = v.stored(spark, sf, "scored-admissions", lambda: stage_admissions(v.raw_admissions(spark, sf)).select(*SCORED))
    return admission_features(admissions, v.patients(spark, sf), lookback_history(admissions), comorbidity_scores(v.patients(spark, sf))).select(*columns)


@query("sc01_comorbidity_index", v.with_tables(*v.PATIENT_TABLES, v.COMORBIDITY, """SELECT patient_id, CAST(charlson_raw AS BIGINT) AS charlson_raw, CAST(age_adjustment AS BIGINT) AS age_adjustment, CAST(charlson_comorbidity_index AS BIGINT) AS charlson_comorbidity_index,
 CAST(cci_chf AS BIGINT) AS cci_chf, CAST(cci_copd AS BIGINT) AS cci_copd, CAST(cci_ckd AS BIGINT) AS cci_ckd, CAST(cci_diabetes AS BIGINT) AS cci_diabetes, CAST(cci_afib AS BIGINT) AS cci_afib FROM cci"""))
def comorbidity_index(spark, sf):
    return comorbidity_scores(v.patients(spark, sf)).drop("age", "comorbidity_count", "cci_risk_tier", "estimated_10yr_survival")


@query("sc02_tier_and_survival", v.with_tables(*v.PATIENT_TABLES, v.COMORBIDITY, """SELECT patient_id, CASE WHEN charlson_comorbidity_index = 0 THEN 'None' WHEN charlson_comorbidity_index BETWEEN 1 AND 2 THEN 'Low' WHEN charlson_comorbidity_index BETWEEN 3 AND 4 THEN 'Moderate' ELSE 'High' END AS cci_risk_tier,
 CAST(round(CAST(pow(0.983::DOUBLE, exp(charlson_comorbidity_index * 0.9::DOUBLE)) AS DECIMAL(20,10)), 4) AS DOUBLE) AS estimated_10yr_survival FROM cci"""))
def tier_and_survival(spark, sf):
    return v.comorbidity(spark, sf).select("patient_id", "cci_risk_tier", "estimated_10yr_survival")


ASSIGNED = """latest AS (SELECT DISTINCT ON (patient_id) * FROM stg_admissions ORDER BY patient_id, admission_date DESC NULLS FIRST, admission_id DESC),
assigned AS (SELECT l.patient_id, l.admission_id AS latest_admission_id, l.department AS latest_department, c.charlson_comorbidity_index, h.prior_admissions_12m, insurance_category = 'Medicaid' AS sdoh_risk_flag,
 CASE WHEN charlson_comorbidity_index >= 6 OR prior_readmissions_1y >= 3 OR (icu_flag AND prior_admissions_90d >= 2) THEN 'T1_CatastrophicRisk'
 WHEN charlson_comorbidity_index BETWEEN 3 AND 5 OR prior_readmissions_1y = 2 OR high_utilizer_flag THEN 'T2_HighRisk'
 WHEN charlson_comorbidity_index BETWEEN 1 AND 2 OR prior_admissions_12m >= 2 THEN 'T3_ModerateRisk' ELSE 'T4_LowRisk' END AS risk_cohort
 FROM latest l LEFT JOIN stg_patients p USING (patient_id) LEFT JOIN cci c USING (patient_id) LEFT JOIN history h ON h.admission_id = l.admission_id)"""
COHORTS = v.with_tables(*v.ADMISSION_TABLES, *v.PATIENT_TABLES, v.COMORBIDITY, v.HISTORY, ASSIGNED,
"""SELECT patient_id, latest_admission_id, latest_department, CAST(charlson_comorbidity_index AS BIGINT) AS charlson_comorbidity_index, prior_admissions_12m, sdoh_risk_flag, risk_cohort,
 CAST(CASE risk_cohort WHEN 'T1_CatastrophicRisk' THEN 1 WHEN 'T2_HighRisk' THEN 2 WHEN 'T3_ModerateRisk' THEN 3 ELSE 4 END AS BIGINT) AS risk_cohort_rank FROM assigned""")


@query("sc03_patient_risk_cohorts", COHORTS)
def cohorts(spark, sf):
    found = marts.patient_risk_cohorts(v.admissions(spark, sf), v.patients(spark, sf), v.comorbidity(spark, sf), v.history(spark, sf))
    return found.select(
        "patient_id", "latest_admission_id", "latest_department", "charlson_comorbidity_index", "prior_admissions_12m",
        "sdoh_risk_flag", "risk_cohort", "risk_cohort_rank",
    )


@query("sc04_stars_and_label", "SELECT department_name, period_start, vs_benchmark_delta, cms_star_rating, performance_label FROM (" + DEPARTMENT_PERFORMANCE + ")")
def stars(spark, sf):
    from tidemark.catalog.summaries import department_performance

    return department_performance(spark, sf).select("department_name", "period_start", "vs_benchmark_delta", "cms_star_rating", "performance_label")


@query("sc05_heuristic_score", v.with_tables(*FEATURE_TABLES, f"SELECT admission_id, round({HEURISTIC}, 4) AS risk_score FROM features"))
def heuristic(spark, sf):
    return features(spark, sf).select("admission_id", F.round(s.heuristic_score(), 4).alias("risk_score"))


@query("sc06_additive_score", v.with_tables(*FEATURE_TABLES, """SELECT admission_id, CAST(round(CAST(greatest(0.03::DOUBLE, least(0.97::DOUBLE, 0.10::DOUBLE + charlson_comorbidity_index * 0.038::DOUBLE + prior_readmissions_1y * 0.11::DOUBLE + coalesce(icu_flag, 0) * 0.12::DOUBLE
 + coalesce(emergency_flag, 0) * 0.07::DOUBLE + high_utilizer_flag * 0.08::DOUBLE + least(length_of_stay_days, 14) * 0.012::DOUBLE)) AS DECIMAL(20,10)), 4) AS DOUBLE) AS risk_score FROM features"""))
def additive(spark, sf):
    used = ["charlson_comorbidity_index", "prior_readmissions_1y", "icu_flag", "emergency_flag", "high_utilizer_flag", "length_of_stay_days"]
    return some_features(spark, sf, "admission_id", *used).select("admission_id", s.additive_score(*used).alias("risk_score"))


@query("sc07_risk_tiers", """SELECT event_id, CASE WHEN s >= 0.80 THEN 'critical' WHEN s >= 0.65 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN s >= 0.65 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS three_tier
 FROM (SELECT event_id, value / 40 AS s FROM events)""")
def tiers(spark, sf):
    score = F.col("value") / 40
    return v.table(spark, sf, "events").select(
        "event_id", s.risk_tier(score).alias("tier"), s.risk_tier(score, s.THREE_RISK_BANDS, "LOW").alias("three_tier")
    )


@query("sc08_weighted_factors", v.with_tables(*FEATURE_TABLES, """SELECT admission_id, array_to_string(list_filter([
 CASE WHEN prior_readmissions_1y <> 0 THEN 'prior_readmissions_1y=' || CAST(CAST(round(prior_readmissions_1y * 0.12, 4) AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN charlson_comorbidity_index <> 0 THEN 'charlson_comorbidity_index=' || CAST(CAST(charlson_comorbidity_index * 0.05 AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN high_utilizer_flag <> 0 THEN 'high_utilizer_flag=' || CAST(CAST(high_utilizer_flag * 0.10 AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN prior_admissions_12m <> 0 THEN 'prior_admissions_12m=' || CAST(CAST(prior_admissions_12m * 0.04 AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN icu_flag <> 0 THEN 'icu_flag=' || CAST(CAST(icu_flag * 0.08 AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN comorbidity_count <> 0 THEN 'comorbidity_count=' || CAST(CAST(comorbidity_count * 0.03 AS DECIMAL(10,4)) AS VARCHAR) END,
 CASE WHEN length_of_stay_days <> 0 THEN 'length_of_stay_days=' || CAST(CAST(length_of_stay_days * 0.02 AS DECIMAL(10,4)) AS VARCHAR) END], lambda x: x IS NOT NULL)[1:6], ',') AS factors FROM features"""))
def weighted_factors(spark, sf):
    shown = F.transform(s.weighted_factors(), lambda x: F.concat(x["feature"], F.lit("="), x["contribution"].cast("decimal(10,4)").cast("string")))
    return features(spark, sf).select("admission_id", F.array_join(shown, ",").alias("factors"))


FACTORS = """array_to_string(list_filter([CASE WHEN prior_admissions_12m >= 3 THEN 'prior_admissions_12m' END, CASE WHEN prior_readmissions_1y >= 1 THEN 'prior_readmissions_1y' END, CASE WHEN charlson_comorbidity_index >= 3 THEN 'charlson_comorbidity_index' END,
 CASE WHEN length_of_stay_days >= 7 THEN 'length_of_stay_days' END, CASE WHEN icu_days >= 2 THEN 'icu_days' END, CASE WHEN comorbidity_count >= 4 THEN 'comorbidity_count' END, CASE WHEN high_utilizer_flag >= 1 THEN 'high_utilizer_flag' END,
 CASE WHEN days_since_last_discharge >= 30 THEN 'days_since_last_discharge' END], lambda x: x IS NOT NULL), ',')"""


@query("sc09_threshold_factors", v.with_tables(*FEATURE_TABLES, f"SELECT admission_id, {FACTORS} AS factors FROM features"))
def threshold_factors(spark, sf):
    return features(spark, sf).select("admission_id", F.array_join(F.transform(s.threshold_factors(), lambda x: x["feature"]), ",").alias("factors"))


@query("sc10_top_contributions", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, array_to_string(list_transform(list_sort([struct_pack(k := -abs(q), n := 'quantity'), struct_pack(k := -abs(d), n := 'discount'), struct_pack(k := -abs(t), n := 'tax')])[1:2], lambda x: x.n), ',') AS names
 FROM (SELECT *, l_quantity - 25 AS q, (l_discount - 0.05::DOUBLE) * 100 AS d, (l_tax - 0.04::DOUBLE) * 100 AS t FROM lineitem)""")
def top_contributions(spark, sf):
    top = s.top_contributions(
        {"quantity": F.col("l_quantity") - 25, "discount": (F.col("l_discount") - 0.05) * 100, "tax": (F.col("l_tax") - 0.04) * 100}, 2
    )
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.map_keys(top), ",").alias("names"))


STORED = "stored AS (SELECT DISTINCT ON (admission_id) admission_id, CAST(risk_score AS DOUBLE) AS stored FROM scores ORDER BY admission_id, predicted_at DESC, prediction_id DESC)"


@query("sc11_stored_or_heuristic", v.with_tables(*FEATURE_TABLES, v.SCORES, STORED, f"""SELECT admission_id, coalesce(stored, round({HEURISTIC}, 4)) AS risk_score, CASE WHEN stored IS NULL THEN 'heuristic_fallback' ELSE 'stored' END AS score_source FROM features LEFT JOIN stored USING (admission_id)"""))
def stored_or_heuristic(spark, sf):
    return scored_or_heuristic(features(spark, sf), v.scores(spark, sf)).select("admission_id", "risk_score", "score_source")


@query("sc11_requested_but_unknown", v.with_tables(*v.ADMISSION_TABLES, v.SCORES, """SELECT count(DISTINCT s.admission_id) AS requested, count(DISTINCT CASE WHEN a.admission_id IS NULL THEN s.admission_id END) AS failed FROM scores s LEFT JOIN stg_admissions a USING (admission_id)"""))
def unknown(spark, sf):
    return unscored(v.scores(spark, sf).select("admission_id"), v.admissions(spark, sf), "admission_id")


@query("sc12_vital_range_flags", """SELECT event_id, (value * 4 < 40 OR value * 4 > 300) AS systolic_bp_out, (value < 0 OR value > 30) AS spo2_pct_out FROM events""")
def vital_flags(spark, sf):
    events = v.table(spark, sf, "events").withColumns({"systolic_bp": F.col("value") * 4, "spo2_pct": F.col("value")})
    flags = s.range_flags({"systolic_bp": s.VITAL_RANGES["systolic_bp"], "spo2_pct": (0, 30)})
    return events.select("event_id", *[flag.alias(n) for n, flag in flags.items()])


@query("ml01_feature_table", v.with_tables(*FEATURE_TABLES, "SELECT * REPLACE (strftime(admission_date, '%Y-%m-%d') AS admission_date, strftime(discharge_date, '%Y-%m-%d') AS discharge_date) FROM features"))
def feature_table(spark, sf):
    return build_features(spark, sf)

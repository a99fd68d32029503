"""Marts and group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.operators import aggregates as a
from tidemark.plans import marts
from tidemark.sources.literals import benchmark_rates

NATION_RATES = [(f"NATION_{i}", f"0.{20 + i}") for i in range(20)]
NATION_RATES_SQL = "benchmarks(department_name, rate) AS (VALUES " + ", ".join(
    f"('{n}', CAST({r} AS DECIMAL(10,4)))" for n, r in NATION_RATES
) + ")"

MONTHLY = f"""monthly AS (SELECT coalesce(department, 'Unknown') AS department_name, CAST(year(admission_date) AS BIGINT) AS year, CAST(month(admission_date) AS BIGINT) AS month,
 date_trunc('month', admission_date) AS period_start, count(*) AS total_admissions, CAST(sum(CAST(readmit_30day_flag AS INTEGER)) AS BIGINT) AS total_readmissions,
 {v.share_sql('readmit_30day_flag')} AS readmission_rate, {v.mean_sql('length_of_stay_days', 2)} AS avg_los_days,
 {v.mean_sql('total_charges', 2)} AS avg_cost_usd, CAST(sum(total_charges) AS DOUBLE) AS total_cost_usd, CAST(sum(icu_days) AS BIGINT) AS total_icu_days,
 CAST(sum(CAST(emergency_flag AS INTEGER)) AS BIGINT) AS emergency_count, {v.share_sql('emergency_flag')} AS emergency_rate
 FROM stg_admissions GROUP BY ALL)"""

DEPARTMENT_PERFORMANCE = v.with_tables(
    *v.ADMISSION_TABLES, NATION_RATES_SQL, MONTHLY,
    """marked AS (SELECT m.*, coalesce(b.rate, 0.15) AS benchmark_readmission_rate,
 CAST(m.readmission_rate AS DECIMAL(10,4)) - coalesce(b.rate, 0.15) AS vs_benchmark_delta
 FROM monthly m LEFT JOIN benchmarks b USING (department_name)),
trend AS (SELECT *, lag(readmission_rate) OVER (PARTITION BY department_name ORDER BY period_start) AS prior_month_readmission_rate,
 """ + v.mean_sql("readmission_rate", 4, 1, "OVER (PARTITION BY department_name ORDER BY period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)") + """ AS rolling_3m_avg
 FROM marked)""",
    """SELECT department_name, year, month, strftime(period_start, '%Y-%m-%d') AS period_start, total_admissions, total_readmissions, readmission_rate,
 CAST(benchmark_readmission_rate AS DOUBLE) AS benchmark_readmission_rate, CAST(vs_benchmark_delta AS DOUBLE) AS vs_benchmark_delta, prior_month_readmission_rate,
 round(coalesce(readmission_rate - prior_month_readmission_rate, 0), 4) AS mom_readmission_delta, rolling_3m_avg,
 avg_los_days, avg_cost_usd, total_cost_usd, total_icu_days, emergency_count, emergency_rate,
 CAST(CASE WHEN vs_benchmark_delta <= -0.04 THEN 5 WHEN vs_benchmark_delta <= -0.01 THEN 4 WHEN vs_benchmark_delta <= 0.01 THEN 3 WHEN vs_benchmark_delta <= 0.04 THEN 2 ELSE 1 END AS BIGINT) AS cms_star_rating,
 CASE WHEN vs_benchmark_delta < -0.02 THEN 'Outperforming' WHEN vs_benchmark_delta > 0.02 THEN 'Underperforming' ELSE 'On Target' END AS performance_label FROM trend""",
)


@query("department_performance", DEPARTMENT_PERFORMANCE)
def department_performance(spark, sf):
    return marts.department_performance(v.admissions(spark, sf), benchmark_rates(spark, NATION_RATES))


DASHBOARD = v.with_tables(
    *v.ADMISSION_TABLES, *v.PATIENT_TABLES, v.COMORBIDITY, v.HISTORY,
    f"""SELECT strftime(date_trunc('month', a.admission_date), '%Y-%m-%d') AS period_start, CAST(year(a.admission_date) AS BIGINT) AS year, CAST(month(a.admission_date) AS BIGINT) AS month,
 strftime(a.admission_date, '%B') AS month_name, CAST(quarter(a.admission_date) AS BIGINT) AS quarter,
 coalesce(department, 'Unknown') AS department_name, coalesce(primary_diagnosis_category, 'Unknown') AS diagnosis_category,
 count(*) AS total_admissions, count(DISTINCT a.patient_id) AS unique_patients, CAST(sum(CAST(readmit_30day_flag AS INTEGER)) AS BIGINT) AS total_readmissions,
 {v.share_sql('readmit_30day_flag', 2, 100)} AS readmission_rate_pct, {v.mean_sql('length_of_stay_days', 2)} AS avg_los_days,
 quantile_cont(length_of_stay_days, 0.5) AS median_los_days, {v.mean_sql('total_charges', 2)} AS avg_cost_usd, CAST(sum(total_charges) AS DOUBLE) AS total_cost_usd,
 CAST(sum(icu_days) AS BIGINT) AS total_icu_days, {v.mean_sql('icu_days', 2)} AS avg_icu_days, CAST(sum(CAST(icu_flag AS INTEGER)) AS BIGINT) AS icu_admissions,
 CAST(sum(CAST(emergency_flag AS INTEGER)) AS BIGINT) AS emergency_admissions, {v.share_sql('emergency_flag', 2, 100)} AS emergency_rate_pct,
 {v.mean_sql('p.age', 1)} AS avg_age, count(*) FILTER (WHERE age_group = '76+') AS patients_76_plus, {v.mean_sql('p.comorbidity_count', 2)} AS avg_comorbidity_count,
 {v.mean_sql('charlson_comorbidity_index', 2)} AS avg_cci_score, CAST(sum(CAST(high_utilizer_flag AS INTEGER)) AS BIGINT) AS high_utilizer_admissions,
 CAST(sum(prior_readmissions_1y) AS BIGINT) AS total_prior_readmissions_1y
 FROM stg_admissions a LEFT JOIN stg_patients p ON p.patient_id = a.patient_id LEFT JOIN cci c ON c.patient_id = a.patient_id
 LEFT JOIN history h ON h.admission_id = a.admission_id GROUP BY ALL""",
)


@query("ag01_department_month_volume", v.with_tables(
    *v.ADMISSION_TABLES, MONTHLY,
    "SELECT * REPLACE (strftime(period_start, '%Y-%m-%d') AS period_start) FROM monthly",
))
def department_month(spark, sf):
    return marts.monthly_by_department(v.admissions(spark, sf))


@query("ag02_dashboard", DASHBOARD)
def dashboard(spark, sf):
    return marts.dashboard(
        v.admissions(spark, sf), v.patients(spark, sf), v.comorbidity(spark, sf), v.history(spark, sf)
    )


@query("ag03_stay_by_category_and_payer", v.with_tables(
    *v.ADMISSION_TABLES, *v.PATIENT_TABLES,
    f"""SELECT primary_diagnosis_category, insurance_category, CAST(year(admission_date) AS BIGINT) AS year, CAST(quarter(admission_date) AS BIGINT) AS quarter, count(*) AS total_admissions,
 {v.mean_sql('length_of_stay_days', 2)} AS avg_los_days, quantile_cont(length_of_stay_days, 0.5) AS median_los_days, quantile_cont(length_of_stay_days, 0.9) AS p90_los_days,
 round(CAST(stddev_samp(length_of_stay_days) AS DECIMAL(20,8)), 2)::DOUBLE AS stddev_los_days, {v.mean_sql('total_charges', 2)} AS avg_cost_usd, {v.mean_sql('icu_days', 2)} AS avg_icu_days,
 CAST(sum(CAST(readmit_30day_flag AS INTEGER)) AS BIGINT) AS readmissions, {v.share_sql('readmit_30day_flag')} AS readmission_rate
 FROM stg_admissions a JOIN stg_patients p USING (patient_id) WHERE primary_diagnosis_category IS NOT NULL AND insurance_category IS NOT NULL GROUP BY ALL""",
))
def stay_by_category(spark, sf):
    facts = v.admissions(spark, sf).join(v.patients(spark, sf).select("patient_id", "insurance_category"), "patient_id")
    return marts.stay_by_category_and_payer(facts, ["primary_diagnosis_category", "insurance_category"])


@query("ag04_score_distribution", v.with_tables(
    v.SCORES,
    f"""SELECT strftime(CAST(predicted_at AS DATE), '%Y-%m-%d') AS score_date, model_name, model_version, risk_tier, count(*) AS patient_count,
 {v.mean_sql('risk_score', 4)} AS avg_risk_score, CAST(min(risk_score) AS DOUBLE) AS min_risk_score, CAST(max(risk_score) AS DOUBLE) AS max_risk_score,
 quantile_cont(CAST(risk_score AS DOUBLE), 0.25) AS p25_risk_score, quantile_cont(CAST(risk_score AS DOUBLE), 0.5) AS median_risk_score,
 quantile_cont(CAST(risk_score AS DOUBLE), 0.75) AS p75_risk_score, quantile_cont(CAST(risk_score AS DOUBLE), 0.9) AS p90_risk_score,
 {v.share_sql('clinician_reviewed')} AS clinician_review_rate, count(actual_outcome) AS outcomes_available, count(*) FILTER (WHERE actual_outcome) AS true_positives
 FROM scores GROUP BY ALL""",
))
def score_distribution(spark, sf):
    return marts.score_distribution(v.scores(spark, sf))


@query("ag05_kpi_summary", v.with_tables(
    *v.ADMISSION_TABLES, v.SCORES,
    f"""SELECT count(DISTINCT patient_id) AS total_patients, count(*) AS total_admissions_30d, CAST(coalesce(sum(CAST(readmit_30day_flag AS INTEGER)), 0) AS BIGINT) AS total_readmissions_30d,
 coalesce({v.share_sql('readmit_30day_flag', 2, 100)}, 0) AS avg_readmission_rate_pct, coalesce({v.mean_sql('length_of_stay_days', 2)}, 0) AS avg_los_days,
 coalesce({v.mean_sql('total_charges', 2)}, 0) AS avg_cost_usd, coalesce(CAST(sum(total_charges) AS DOUBLE), 0) AS total_cost_30d,
 (SELECT count(*) FROM scores WHERE risk_tier IN ('high', 'critical')) AS high_risk_patients_today,
 (SELECT coalesce({v.mean_sql('risk_score', 4)}, 0) FROM scores WHERE predicted_at >= (SELECT max(predicted_at) FROM scores) - INTERVAL 24 HOUR) AS avg_risk_score,
 (SELECT count(DISTINCT department) FROM stg_admissions) AS department_count
 FROM stg_admissions WHERE admission_date >= (SELECT max(admission_date) FROM stg_admissions) - INTERVAL 30 DAY""",
))
def kpi_summary(spark, sf):
    admissions, scores = v.admissions(spark, sf), v.scores(spark, sf)
    newest = v.table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate")).alias("d")).scalar()
    return marts.kpi_summary(admissions, scores, newest, scores.agg(F.max("predicted_at").alias("t")).scalar())


@query("ag06_counts_by_severity", """SELECT count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'click') AS click,
 count(*) FILTER (WHERE event_type = 'view') AS view, count(*) AS total FROM events""")
def severity_counts(spark, sf):
    return a.conditional_counts(v.table(spark, sf, "events"), "event_type", ["error", "click", "view"])


@query("ag07_measures_per_admission", f"""SELECT l_orderkey AS admission_id, {{0}}, {v.mean_sql('l_discount', 8)} AS l_discount_mean, max(l_discount) AS l_discount_max
 FROM lineitem GROUP BY l_orderkey""".replace("{0}", ", ".join(
    f"{v.mean_sql(m, 8)} AS {m}_mean, round(CAST(stddev_samp({m}) AS DECIMAL(24,8)), 4)::DOUBLE AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max"
    for m in ("l_quantity", "l_extendedprice")
)))
def measures(spark, sf):
    df = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "admission_id")
    stats = a.measure_stats(df, ["admission_id"], ["l_quantity", "l_extendedprice"], "l_discount")
    for m in ("l_quantity", "l_extendedprice"):
        stats = stats.withColumn(f"{m}_std", F.round(F.col(f"{m}_std").cast("decimal(24,8)"), 4))
    return stats


@query("ag08_count_per_key", "SELECT l_orderkey AS admission_id, count(*) AS num_diagnoses FROM lineitem GROUP BY 1")
def count_per_key(spark, sf):
    df = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "admission_id")
    return a.count_by(df, "admission_id", "num_diagnoses")


@query("ag09_rate_and_volume", v.with_tables(
    *v.ADMISSION_TABLES,
    f"SELECT primary_diagnosis_category, {v.share_sql('readmit_30day_flag', 1, 100)} AS rate_pct, count(*) AS volume FROM stg_admissions GROUP BY 1",
))
def rate_and_volume(spark, sf):
    return a.rate_and_volume(v.admissions(spark, sf), "primary_diagnosis_category", "readmit_30day_flag")


@query("ag10_mean_stay_by_payer", v.with_tables(
    *v.ADMISSION_TABLES, *v.PATIENT_TABLES,
    f"SELECT insurance_category, {v.mean_sql('length_of_stay_days', 8)} AS mean_value FROM stg_admissions JOIN stg_patients USING (patient_id) GROUP BY 1",
))
def mean_stay(spark, sf):
    joined = v.admissions(spark, sf).join(v.patients(spark, sf), "patient_id")
    return a.mean_by(joined, "insurance_category", "length_of_stay_days")


@query("ag11_all_departments_rollup", v.with_tables(
    *v.ADMISSION_TABLES, MONTHLY,
    f"""SELECT strftime(period_start, '%Y-%m-%d') AS period_start, {v.mean_sql('readmission_rate', 6)} AS mean_rate,
 {v.half_up("sum(CAST(CAST(readmission_rate AS DECIMAL(18,4)) * total_admissions * 10000 AS HUGEINT))", "sum(total_admissions) * 10000", 6)} AS weighted_rate,
 CAST(sum(total_admissions) AS BIGINT) AS total_volume FROM monthly GROUP BY 1""",
))
def rollup(spark, sf):
    monthly = marts.monthly_by_department(v.admissions(spark, sf))
    series = a.rollup_series(monthly, "period_start", "readmission_rate", "total_admissions")
    return series.withColumns({c: F.round(c, 6) for c in ("mean_rate", "weighted_rate")})


@query("ag12_tier_counts_in_order", v.with_tables(
    v.SCORES,
    """SELECT risk_tier, CAST(position AS BIGINT) AS position, (SELECT count(*) FROM scores s WHERE s.risk_tier = t.risk_tier) AS n
 FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('unscored', 4)) AS t(risk_tier, position)""",
))
def tier_counts(spark, sf):
    return a.counts_in_order(v.scores(spark, sf), "risk_tier", ["critical", "high", "medium", "low", "unscored"])


@query("ag13_group_profile_with_share", v.with_tables(
    *v.PATIENT_TABLES, v.COMORBIDITY,
    f"""SELECT insurance_category, age_group, count(*) AS size, {v.mean_sql('p.age', 1)} AS avg_age, {v.mean_sql('p.comorbidity_count', 2)} AS avg_comorbidity_count,
 {v.mean_sql('charlson_comorbidity_index', 2)} AS avg_cci, {v.half_up("count(*)", "(SELECT count(*) FROM stg_patients)", 4)} AS size_pct
 FROM stg_patients p JOIN cci USING (patient_id) GROUP BY 1, 2""",
))
def group_profile(spark, sf):
    index = v.comorbidity(spark, sf).select("patient_id", "charlson_comorbidity_index")
    return a.group_profile(
        v.patients(spark, sf).join(index, "patient_id"), ["insurance_category", "age_group"],
        {"avg_age": ("age", 1), "avg_comorbidity_count": ("comorbidity_count", 2), "avg_cci": ("charlson_comorbidity_index", 2)},
    )


@query("ag14_mode_per_group", v.with_tables(
    *v.ADMISSION_TABLES,
    """SELECT department,
 (SELECT discharge_disposition FROM stg_admissions b WHERE b.department IS NOT DISTINCT FROM a.department GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_discharge_disposition,
 (SELECT admission_type FROM stg_admissions b WHERE b.department IS NOT DISTINCT FROM a.department GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_admission_type
 FROM (SELECT DISTINCT department FROM stg_admissions) a""",
))
def modes(spark, sf):
    return a.mode_by(v.admissions(spark, sf), "department", ["discharge_disposition", "admission_type"])


@query("ag15_pivot_periods_by_group", v.with_tables(
    *v.ADMISSION_TABLES, MONTHLY,
    """SELECT strftime(period_start, '%Y-%m-%d') AS period_start, """ + ", ".join(
        f"max(readmission_rate) FILTER (WHERE department_name = 'NATION_{i}') AS \"NATION_{i}\"" for i in range(4)
    ) + " FROM monthly GROUP BY 1",
))
def pivot(spark, sf):
    monthly = marts.monthly_by_department(v.admissions(spark, sf))
    return a.pivot_series(monthly, "period_start", "department_name", "readmission_rate", [f"NATION_{i}" for i in range(4)])


@query("ag16_month_trend", v.with_tables(
    *v.ADMISSION_TABLES,
    f"SELECT strftime(date_trunc('month', admission_date), '%Y-%m-%d') AS month, {v.share_sql('readmit_30day_flag')} AS readmission_rate, count(*) AS total_admissions FROM stg_admissions GROUP BY 1",
))
def month_trend(spark, sf):
    return a.month_trend(v.admissions(spark, sf), "admission_date", "readmit_30day_flag")


@query("ag16_leaderboard", v.with_tables(
    *v.ADMISSION_TABLES,
    f"""SELECT department, {v.share_sql('readmit_30day_flag')} AS readmission_rate, count(*) AS total_admissions FROM stg_admissions
 WHERE admission_date >= (SELECT max(admission_date) FROM stg_admissions) - INTERVAL 30 DAY GROUP BY 1""",
))
def leaderboard(spark, sf):
    newest = v.table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate")).alias("d")).scalar()
    recent = v.admissions(spark, sf).filter(F.col("admission_date") >= F.date_sub(newest, 30))
    return a.leaderboard(recent, "department", "readmit_30day_flag")


@query("ag16_score_buckets", v.with_tables(
    *v.PATIENT_TABLES, v.COMORBIDITY,
    """SELECT CASE WHEN charlson_comorbidity_index >= 8 THEN 'Critical' WHEN charlson_comorbidity_index >= 5 THEN 'High'
 WHEN charlson_comorbidity_index >= 2 THEN 'Medium' ELSE 'Low' END AS bucket, count(*) AS n FROM cci GROUP BY 1""",
))
def score_buckets(spark, sf):
    return a.score_buckets(
        v.comorbidity(spark, sf), "charlson_comorbidity_index", [(8, "Critical"), (5, "High"), (2, "Medium")], "Low"
    )


@query("ag17_report_summary", v.with_tables(
    v.SCORES,
    f"""SELECT count(*) AS patients, count(*) FILTER (WHERE risk_tier = 'critical') AS critical, count(*) FILTER (WHERE risk_tier = 'high') AS high,
 {v.mean_sql('risk_score', 1, 100)} AS mean_score_pct, count(DISTINCT model_name) AS departments FROM scores WHERE risk_score * 100 >= 70""",
))
def report_summary(spark, sf):
    return a.report_summary(v.scores(spark, sf).filter(F.col("risk_score") * 100 >= 70), "risk_score", "risk_tier", "model_name")


@query("ag18_label_correlations", v.with_tables(
    *v.ADMISSION_TABLES, *v.PATIENT_TABLES,
    """j AS (SELECT CAST(length_of_stay_days AS DOUBLE) AS los, CAST(age AS DOUBLE) AS age, CAST(total_charges AS DOUBLE) AS charges, CAST(readmit_30day_flag AS INTEGER)::DOUBLE AS y
 FROM stg_admissions JOIN stg_patients USING (patient_id)),
k AS (SELECT * FROM j WHERE los IS NOT NULL AND age IS NOT NULL AND charges IS NOT NULL AND y IS NOT NULL)""",
    """SELECT 'length_of_stay_days' AS feature, round(corr(los, y), 6) AS correlation FROM k UNION ALL SELECT 'age', round(corr(age, y), 6) FROM k UNION ALL SELECT 'total_charges', round(corr(charges, y), 6) FROM k""",
))
def label_correlations(spark, sf):
    joined = v.admissions(spark, sf).join(v.patients(spark, sf), "patient_id").withColumn(
        "outcome", F.col("readmit_30day_flag").cast("int")
    )
    found = a.label_correlations(joined, ["length_of_stay_days", "age", "total_charges"], "outcome")
    return found.withColumn("correlation", F.round("correlation", 6))

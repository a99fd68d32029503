"""Projection and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.functions import cleaning as c
from tidemark.operators import features as f
from tidemark.plans.staging import stage_admissions, stage_patients

RAW_A, RAW_P = v.with_tables(v.RAW_ADMISSIONS, ""), v.with_tables(v.RAW_PATIENTS, "")
STG_A = v.with_tables(*v.ADMISSION_TABLES, "")


@query("pr01_blank_to_null_cast", RAW_A + """SELECT admission_id, nullif(trim(drg_code), '') AS drg_code, CAST(CAST(nullif(trim(icu_days), '') AS INTEGER) AS BIGINT) AS icu_days,
 TRY_CAST(drg_code AS BIGINT) AS unreadable_code, nullif(trim(drg_code), '') IS NOT NULL AS lost FROM raw_admissions""")
def blank_to_null_cast(spark, sf):
    return v.raw_admissions(spark, sf).select(
        "admission_id", c.blank_to_null("drg_code").alias("drg_code"),
        c.blank_to_null_cast("icu_days", "int").alias("icu_days"),
        c.blank_to_null_cast("drg_code", "bigint").alias("unreadable_code"),
        c.unreadable("drg_code", "bigint").alias("lost"),
    )


@query("pr02_length_of_stay", RAW_A + """SELECT admission_id, CAST(coalesce(CAST(nullif(trim(los_days), '') AS INTEGER),
 CAST(CAST(nullif(trim(discharge_date), '') AS DATE) - CAST(admission_date AS DATE) AS INTEGER)) AS BIGINT) AS stay FROM raw_admissions""")
def length_of_stay(spark, sf):
    date = lambda name: c.blank_to_null_cast(name, "date")
    stay = c.length_of_stay(c.blank_to_null_cast("los_days", "int"), date("admission_date"), date("discharge_date"))
    return v.raw_admissions(spark, sf).select("admission_id", stay.alias("stay"))


@query("pr03_admission_type", RAW_A + f"SELECT admission_id, coalesce({v.looked_up('upper(trim(admission_type))', v.ADMISSION_KINDS)}, 'Urgent') AS admission_type FROM raw_admissions")
def admission_type(spark, sf):
    return v.raw_admissions(spark, sf).select("admission_id", c.admission_type("admission_type").alias("admission_type"))


@query("pr04_emergency_and_icu_flags", RAW_A + f"""SELECT admission_id, CASE WHEN admission_type IS NOT NULL THEN {v.looked_up('upper(trim(admission_type))', v.EMERGENCY_ROOM)} IS NOT NULL END AS emergency_flag,
 {v.number_sql('icu_days')} > 0 AS icu_flag FROM raw_admissions""")
def flags(spark, sf):
    return v.raw_admissions(spark, sf).select(
        "admission_id", c.emergency_flag("admission_type").alias("emergency_flag"),
        c.icu_flag(c.blank_to_null_cast("icu_days", "int")).alias("icu_flag"),
    )


@query("pr05_truthy_label", RAW_A + f"SELECT admission_id, {v.looked_up('trim(readmitted_30_day)', v.TRUE_WORDS)} IS NOT NULL AS label FROM raw_admissions")
def truthy(spark, sf):
    return v.raw_admissions(spark, sf).select("admission_id", c.truthy("readmitted_30_day").alias("label"))


@query("pr06_date_key", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date_key FROM orders")
def date_key(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", c.date_key("o_orderdate").alias("date_key"))


@query("pr07_staged_admissions", STG_A + """SELECT * REPLACE (CAST(icu_days AS BIGINT) AS icu_days, CAST(length_of_stay_days AS BIGINT) AS length_of_stay_days, CAST(total_charges AS DOUBLE) AS total_charges,
 CAST(admit_date_key AS BIGINT) AS admit_date_key, CAST(discharge_date_key AS BIGINT) AS discharge_date_key, strftime(admission_date, '%Y-%m-%d') AS admission_date,
 strftime(discharge_date, '%Y-%m-%d') AS discharge_date, strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') AS loaded_at) FROM stg_admissions""")
def staged_admissions(spark, sf):
    return stage_admissions(v.raw_admissions(spark, sf))


@query("pr08_age_group", v.with_tables(*v.PATIENT_TABLES, f"SELECT patient_id, age_group, {v.age_band_sql('age', 18)} AS age_group_at_load FROM stg_patients"))
def age_group(spark, sf):
    return v.patients(spark, sf).select(
        "patient_id", c.age_group("age").alias("age_group"), c.age_group("age", lowest=18).alias("age_group_at_load")
    )


@query("pr09_gender", RAW_P + f"SELECT patient_id, coalesce({v.looked_up('upper(trim(gender))', v.GENDERS)}, 'Other') AS gender FROM raw_patients")
def gender(spark, sf):
    return v.raw_patients(spark, sf).select("patient_id", c.gender("gender").alias("gender"))


@query("pr10_insurance", RAW_P + f"""SELECT patient_id, {v.insurance_sql('upper(trim(insurance_type))')} AS insurance_category,
 coalesce({v.looked_up('lower(insurance_type)', {'medicare': 'Medicare', 'medicaid': 'Medicaid'})},
  CASE WHEN regexp_matches(lower(insurance_type), 'hmo|ppo|^commercial') THEN 'Commercial' END, 'Other') AS insurance_at_load FROM raw_patients""")
def insurance(spark, sf):
    return v.raw_patients(spark, sf).select(
        "patient_id", c.insurance_category("insurance_type").alias("insurance_category"),
        c.insurance_category_at_load("insurance_type").alias("insurance_at_load"),
    )


@query("pr11_zip_prefix", RAW_P + "SELECT patient_id, left(regexp_replace(trim(zip_code), '[^0-9]', '', 'g'), 3) AS zip_prefix FROM raw_patients")
def zip_prefix(spark, sf):
    return v.raw_patients(spark, sf).select("patient_id", c.zip_prefix("zip_code").alias("zip_prefix"))


@query("pr12_birth_year", RAW_P + "SELECT patient_id, CAST(2024 - CAST(nullif(trim(age), '') AS INTEGER) AS BIGINT) AS birth_year FROM raw_patients")
def birth_year(spark, sf):
    age = c.blank_to_null_cast("age", "int")
    return v.raw_patients(spark, sf).select("patient_id", c.birth_year(age, v.as_of()).alias("birth_year"))


@query("pr13_keyword_flags", v.with_tables(*v.PATIENT_TABLES, """SELECT patient_id, has_diabetes, has_hypertension, has_chf, has_copd, has_ckd, has_afib, has_obesity, has_depression FROM stg_patients"""))
def keyword_flags(spark, sf):
    return v.raw_patients(spark, sf).select(
        "patient_id", *[flag.alias(n) for n, flag in c.keyword_flags("comorbidities").items()]
    )


@query("pr13_document_keywords", """SELECT doc_id, upper(text) LIKE '%THE %' AS common, (upper(text) LIKE '%LICENSE%' OR upper(text) LIKE '%COPYRIGHT%') AS legal FROM documents""")
def document_keywords(spark, sf):
    found = c.keyword_flags("text", {"common": ["THE "], "legal": ["LICENSE", "COPYRIGHT"]})
    return v.table(spark, sf, "documents").select("doc_id", *[flag.alias(n) for n, flag in found.items()])


@query("pr14_code_format", """SELECT p_partkey, regexp_matches(trim(upper(left(p_brand, 1)) || substr(p_brand, 7)), '^[A-Z][0-9]{2}') AS valid FROM part""")
def code_format(spark, sf):
    code = F.concat(F.upper(F.left("p_brand", F.lit(1))), F.substring("p_brand", 7, 10))
    return v.table(spark, sf, "part").select("p_partkey", c.valid_icd10(code).alias("valid"))


DIAGNOSIS_KINDS = {"PRIMARY": "Primary", "PRINCIPAL": "Primary", "ADMITTING": "Primary", "DISCHARGE": "Discharge", "FINAL": "Discharge"}


@query("pr15_diagnosis_type", f"""SELECT p_partkey, coalesce({v.looked_up('upper(trim(kind))', DIAGNOSIS_KINDS)}, 'Secondary') AS diagnosis_type
 FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' principal' WHEN 1 THEN 'Final ' WHEN 2 THEN p_type END AS kind FROM part)""")
def diagnosis_type(spark, sf):
    kind = F.expr("CASE p_size % 4 WHEN 0 THEN ' principal' WHEN 1 THEN 'Final ' WHEN 2 THEN p_type END")
    return v.table(spark, sf, "part").select("p_partkey", c.diagnosis_type(kind).alias("diagnosis_type"))


@query("pr16_ordinal_codes", v.with_tables(*v.PATIENT_TABLES, f"""SELECT patient_id, CAST(coalesce(list_position({v.AGE_BANDS}, age_group), 5) - 1 AS BIGINT) AS age_code,
 CAST(coalesce(list_position(['Male', 'Female'], gender), 3) - 1 AS BIGINT) AS gender_code,
 CAST(coalesce(list_position(['Medicare', 'Medicaid', 'Commercial'], insurance_category), 4) - 1 AS BIGINT) AS insurance_code FROM stg_patients"""))
def ordinal_codes(spark, sf):
    return v.patients(spark, sf).select(
        "patient_id", c.encode("age_group", c.AGE_GROUP_CODES, 4).alias("age_code"),
        c.encode("gender", c.GENDER_CODES, 2).alias("gender_code"),
        c.encode("insurance_category", c.INSURANCE_CODES, 3).alias("insurance_code"),
    )


@query("pr17_calendar_features", "SELECT o_orderkey, isodow(o_orderdate) AS weekday, isodow(o_orderdate) IN (6, 7) AS weekend, month(o_orderdate) AS month FROM orders")
def calendar(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", c.iso_weekday("o_orderdate").alias("weekday"), c.is_weekend("o_orderdate").alias("weekend"),
        F.month("o_orderdate").alias("month"),
    )


@query("pr18_null_sentinels", v.with_tables(*v.ADMISSION_TABLES, v.HISTORY, """SELECT admission_id, CAST(coalesce(days_since_last_discharge, -1) AS BIGINT) AS recency, coalesce(CAST(icu_days AS BIGINT), 0) AS icu_days
 FROM stg_admissions JOIN history USING (admission_id)"""))
def sentinels(spark, sf):
    past = v.history(spark, sf).select("admission_id", "days_since_last_discharge")
    return v.admissions(spark, sf).join(past, "admission_id").select(
        "admission_id", F.coalesce("days_since_last_discharge", F.lit(-1)).alias("recency"),
        F.coalesce("icu_days", F.lit(0)).alias("icu_days"),
    )


@query("pr19_one_hot_drop_first", """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS BIGINT) AS o_orderstatus_P FROM orders""")
def one_hot(spark, sf):
    return f.one_hot(v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("pr20_median_fill", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, coalesce(CASE WHEN l_linenumber <> 2 THEN l_extendedprice END, (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem WHERE l_linenumber <> 2)) AS l_extendedprice,
 coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem WHERE l_linenumber <> 3)) AS l_quantity FROM lineitem""")
def median_fill(spark, sf):
    holes = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"),
    )
    return f.fill_with_median(holes, ["l_extendedprice", "l_quantity"])


@query("pr21_period_start", """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS built, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS truncated, strftime(o_orderdate, '%B') AS month_name FROM orders""")
def period_start(spark, sf):
    date = F.col("o_orderdate")
    return v.table(spark, sf, "orders").select(
        "o_orderkey", c.period_start(F.year(date), F.month(date)).alias("built"), F.trunc(date, "month").alias("truncated"),
        F.date_format(date, "MMMM").alias("month_name"),
    )


@query("pr22_template_fill", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR) || ' is ' || o_orderstatus
 ELSE 'Stage {stage} of {o_custkey}' END AS rationale FROM orders""")
def template_fill(spark, sf):
    template = F.when(F.col("o_orderkey") % 2 == 0, "Order {o_orderkey} of {o_custkey} is {o_orderstatus}").otherwise(
        "Stage {stage} of {o_custkey}"
    )
    fields = {name: F.col(name) for name in ("o_orderkey", "o_custkey", "o_orderstatus")}
    return v.table(spark, sf, "orders").select("o_orderkey", c.fill_template(template, fields).alias("rationale"))


@query("pr23_feature_labels", """SELECT event_id, CASE event_type WHEN 'error' THEN 'ICU admission' WHEN 'click' THEN 'Click Rate' ELSE upper(left(event_type, 1)) || substr(event_type, 2) END AS label FROM events""")
def feature_labels(spark, sf):
    name = F.when(F.col("event_type") == "error", "icu_flag").when(F.col("event_type") == "click", "click_rate").otherwise(F.col("event_type"))
    return v.table(spark, sf, "events").select("event_id", c.feature_label(name).alias("label"))


@query("staged_patients", v.with_tables(*v.PATIENT_TABLES, """SELECT * REPLACE (CAST(age AS BIGINT) AS age, CAST(age_at_snapshot AS BIGINT) AS age_at_snapshot, CAST(birth_year AS BIGINT) AS birth_year,
 CAST(comorbidity_count AS BIGINT) AS comorbidity_count, strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') AS loaded_at) FROM stg_patients"""))
def staged_patients(spark, sf):
    return stage_patients(v.raw_patients(spark, sf), v.as_of())

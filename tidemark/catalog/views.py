"""Admission-style views derived from the given tables, in Spark and as SQL common table expressions.

A customer stands for a patient, an order for an admission (its items give the stay, its status the outcome), a brand
in an order for a diagnosis code, and an event for a vital reading. Raw views are all text, as extracts are.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators.features import comorbidity_scores
from tidemark.operators.history import lookback_history
from tidemark.plans.staging import stage_admissions, stage_patients
from tidemark.session import shared_folder

AS_OF = "2024-01-15"
ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("date")


_written: dict[tuple[str, str], tuple[str, object]] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A warehouse table of this application, written below the shared folder on first use and read from there.

    The load step of a warehouse does the same: marts and scores read typed, stored tables, not text extracts.
    """
    folder = sha256(sf.rstrip("/").encode()).hexdigest()[:12]
    key = (spark.sparkContext.applicationId, f"{folder}/{name}")
    if key not in _written:
        path, frame = shared_folder(spark, f"warehouse-{name}"), build()
        frame.write.parquet(path)
        _written[key] = (path, frame.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def reload_tables(spark: SparkSession, sf: str) -> None:
    """Write all stored tables anew."""
    from tidemark.catalog.scoring import features

    _written.clear()
    for load in (patients, admissions, comorbidity, history, features):
        load(spark, sf)


def raw_patients(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS patient_id",
        "concat('MRN', CAST(c_custkey AS STRING)) AS mrn",
        "CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE concat(' ', CAST(CAST(floor((c_acctbal + 1000) / 115) AS INT) AS STRING)) END AS age",
        "CASE c_custkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN ' Female ' WHEN 2 THEN 'F' WHEN 3 THEN 'Male' END AS gender",
        "concat(' ', c_mktsegment) AS ethnicity",
        "concat('Z-', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')) AS zip_code",
        "concat('st', CAST(c_nationkey AS STRING)) AS state",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'medicare advantage' WHEN 'BUILDING' THEN ' Medicaid' WHEN 'FURNITURE' THEN 'ppo' WHEN 'HOUSEHOLD' THEN 'HMO' END AS insurance_type",
        "CASE WHEN c_nationkey < 5 THEN ' English' ELSE 'Other ' END AS primary_language",
        "CASE WHEN c_custkey % 31 = 0 THEN '' ELSE CAST(c_custkey % 7 AS STRING) END AS num_comorbidities",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat("
        "CASE WHEN c_custkey % 2 = 0 THEN 'Type 2 Diabetes|' ELSE '' END,"
        "CASE WHEN c_custkey % 3 = 0 THEN 'Hypertension|' ELSE '' END,"
        "CASE WHEN c_custkey % 5 = 0 THEN 'Heart Failure|' ELSE '' END,"
        "CASE WHEN c_custkey % 7 = 0 THEN 'COPD|' ELSE '' END,"
        "CASE WHEN c_custkey % 11 = 0 THEN 'chronic kidney disease|' ELSE '' END,"
        "CASE WHEN c_custkey % 17 = 0 THEN 'afib|' ELSE '' END,"
        "CASE WHEN c_custkey % 19 = 0 THEN 'obese|' ELSE '' END,"
        "CASE WHEN c_custkey % 23 = 0 THEN 'Depression' ELSE '' END) END AS comorbidities",
        f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' AS loaded_at",
    )


RAW_PATIENTS = f"""raw_patients AS (
SELECT CAST(c_custkey AS VARCHAR) AS patient_id,
 'MRN' || CAST(c_custkey AS VARCHAR) AS mrn,
 CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE ' ' || CAST(CAST(floor((c_acctbal + 1000) / 115) AS INTEGER) AS VARCHAR) END AS age,
 CASE c_custkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN ' Female ' WHEN 2 THEN 'F' WHEN 3 THEN 'Male' END AS gender,
 ' ' || c_mktsegment AS ethnicity,
 'Z-' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code,
 'st' || CAST(c_nationkey AS VARCHAR) AS state,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'medicare advantage' WHEN 'BUILDING' THEN ' Medicaid' WHEN 'FURNITURE' THEN 'ppo' WHEN 'HOUSEHOLD' THEN 'HMO' END AS insurance_type,
 CASE WHEN c_nationkey < 5 THEN ' English' ELSE 'Other ' END AS primary_language,
 CASE WHEN c_custkey % 31 = 0 THEN '' ELSE CAST(c_custkey % 7 AS VARCHAR) END AS num_comorbidities,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE
  CASE WHEN c_custkey % 2 = 0 THEN 'Type 2 Diabetes|' ELSE '' END ||
  CASE WHEN c_custkey % 3 = 0 THEN 'Hypertension|' ELSE '' END ||
  CASE WHEN c_custkey % 5 = 0 THEN 'Heart Failure|' ELSE '' END ||
  CASE WHEN c_custkey % 7 = 0 THEN 'COPD|' ELSE '' END ||
  CASE WHEN c_custkey % 11 = 0 THEN 'chronic kidney disease|' ELSE '' END ||
  CASE WHEN c_custkey % 17 = 0 THEN 'afib|' ELSE '' END ||
  CASE WHEN c_custkey % 19 = 0 THEN 'obese|' ELSE '' END ||
  CASE WHEN c_custkey % 23 = 0 THEN 'Depression' ELSE '' END END AS comorbidities,
 TIMESTAMP '{AS_OF} 00:00:00' AS loaded_at
FROM customer)"""


def raw_admissions(spark: SparkSession, sf: str) -> DataFrame:
    stays = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("units"))
    orders = table(spark, sf, "orders")
    places = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_mktsegment", "n_name")
    )
    joined = orders.join(stays, orders.o_orderkey == stays.l_orderkey, "left").join(
        places, orders.o_custkey == places.c_custkey, "left"
    )
    return joined.selectExpr(
        "CAST(o_orderkey AS STRING) AS admission_id",
        "CAST(o_custkey AS STRING) AS patient_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS admission_date",
        "CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE concat(date_format(date_add(CAST(o_orderdate AS DATE), coalesce(units, 0) % 20), 'yyyy-MM-dd'), ' ') END AS discharge_date",
        "CASE WHEN o_orderkey % 10 = 3 THEN ' ' ELSE concat(' ', CAST(units AS STRING)) END AS los_days",
        "CASE WHEN o_orderkey % 97 <> 0 THEN concat(' ', n_name) END AS department",
        "CASE o_orderpriority WHEN '1-URGENT' THEN ' emergency' WHEN '2-HIGH' THEN 'ED' WHEN '3-MEDIUM' THEN 'Scheduled' WHEN '5-LOW' THEN 'Urgent Care' END AS admission_type",
        "CASE o_orderkey % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'skilled nursing facility' WHEN 2 THEN 'Expired' END AS discharge_disposition",
        "CASE WHEN o_orderkey % 101 <> 0 THEN c_mktsegment END AS primary_diagnosis_category",
        "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(greatest(units % 7 - 3, 0) AS STRING) END AS icu_days",
        "CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE concat('DRG', CAST(o_orderkey % 20 AS STRING)) END AS drg_code",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total_charges",
        "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE ' Yes' END WHEN 'O' THEN '0' END AS readmitted_30_day",
        f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' AS loaded_at",
    )


RAW_ADMISSIONS = f"""raw_admissions AS (
SELECT CAST(o_orderkey AS VARCHAR) AS admission_id, CAST(o_custkey AS VARCHAR) AS patient_id,
 strftime(o_orderdate, '%Y-%m-%d') AS admission_date,
 CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + CAST(coalesce(units, 0) % 20 AS INTEGER), '%Y-%m-%d') || ' ' END AS discharge_date,
 CASE WHEN o_orderkey % 10 = 3 THEN ' ' ELSE ' ' || CAST(units AS VARCHAR) END AS los_days,
 CASE WHEN o_orderkey % 97 <> 0 THEN ' ' || n_name END AS department,
 CASE o_orderpriority WHEN '1-URGENT' THEN ' emergency' WHEN '2-HIGH' THEN 'ED' WHEN '3-MEDIUM' THEN 'Scheduled' WHEN '5-LOW' THEN 'Urgent Care' END AS admission_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'skilled nursing facility' WHEN 2 THEN 'Expired' END AS discharge_disposition,
 CASE WHEN o_orderkey % 101 <> 0 THEN c_mktsegment END AS primary_diagnosis_category,
 CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(greatest(units % 7 - 3, 0) AS VARCHAR) END AS icu_days,
 CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'DRG' || CAST(o_orderkey % 20 AS VARCHAR) END AS drg_code,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_charges,
 CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE ' Yes' END WHEN 'O' THEN '0' END AS readmitted_30_day,
 TIMESTAMP '{AS_OF} 00:00:00' AS loaded_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INTEGER) AS units FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "patients", lambda: stage_patients(raw_patients(spark, sf), as_of()))


# Fixed values of the SQL twins: spellings by meaning, bands and keywords.
GENDERS = {"M": "Male", "MALE": "Male", "F": "Female", "FEMALE": "Female"}
COMMERCIAL = {name: "Commercial" for name in ("HMO", "PPO", "COMMERCIAL", "BLUE CROSS", "AETNA", "CIGNA", "HUMANA")}
ADMISSION_KINDS = {"EMERGENCY": "Emergency", "ED": "Emergency", "ER": "Emergency", "URGENT CARE": "Emergency", "ELECTIVE": "Elective", "SCHEDULED": "Elective"}
EMERGENCY_ROOM = {"EMERGENCY": "yes", "ED": "yes", "ER": "yes"}
TRUE_WORDS = {"1": "yes", "true": "yes", "True": "yes", "TRUE": "yes", "yes": "yes", "Yes": "yes"}
AGE_BANDS, AGE_STARTS = ["18-30", "31-45", "46-60", "61-75", "76+"], [31, 46, 61, 76]
CONDITION_WORDS = {
    "has_diabetes": ["DIABETES"], "has_hypertension": ["HYPERTENSION"], "has_chf": ["HEART FAILURE", "CHF"],
    "has_copd": ["COPD"], "has_ckd": ["CKD", "CHRONIC KIDNEY"], "has_afib": ["ATRIAL", "AFIB"],
    "has_obesity": ["OBESITY", "OBESE"], "has_depression": ["DEPRESSION"],
}


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def looked_up(text: str, meanings: dict[str, str]) -> str:
    """SQL: the meaning of a spelling, NULL for one that isn't listed."""
    return f"map({_quoted(meanings)}, {_quoted(meanings.values())})[{text}]"


def age_band_sql(age: str, lowest: int = 0) -> str:
    """SQL: the band by how many band starts an age has reached; the last one for ages out of range."""
    return f"CASE WHEN {age} >= {lowest} THEN {_quoted(AGE_BANDS)}[1 + len(list_filter({AGE_STARTS}, lambda s: {age} >= s))] ELSE '{AGE_BANDS[-1]}' END"


def insurance_sql(text: str) -> str:
    """SQL: the first public payer that the text names, else the meaning of the whole text."""
    named = f"list_filter(['Medicare', 'Medicaid'], lambda x: contains({text}, upper(x)))[1]"
    return f"coalesce({named}, {looked_up(text, COMMERCIAL)}, 'Other')"


def keyword_sql(text: str, words: list[str]) -> str:
    """SQL: whether the text holds any of the words; NULL for no text."""
    return f"CASE WHEN {text} IS NOT NULL THEN len(list_filter({_quoted(words)}, lambda w: contains(upper({text}), w))) > 0 END"


def number_sql(text: str, kind: str = "INTEGER") -> str:
    return f"TRY_CAST(trim({text}) AS {kind})"


STG_PATIENTS = f"""known_patients AS (
SELECT *, {number_sql('age')} AS years, upper(trim(gender)) AS gender_word, upper(trim(insurance_type)) AS payer_word FROM raw_patients WHERE length(trim(patient_id)) > 0),
stg_patients AS (
SELECT patient_id, mrn, years AS age, years AS age_at_snapshot, 2024 - years AS birth_year, {age_band_sql('years')} AS age_group,
 coalesce({looked_up('gender_word', GENDERS)}, 'Other') AS gender, {insurance_sql('payer_word')} AS insurance_category,
 trim(ethnicity) AS race_ethnicity, substr(array_to_string(regexp_extract_all(zip_code, '[0-9]'), ''), 1, 3) AS zip_code_prefix, upper(trim(state)) AS state,
 trim(primary_language) AS primary_language, {number_sql('num_comorbidities')} AS comorbidity_count, trim(comorbidities) AS comorbidities_raw,
 {', '.join(f'{keyword_sql("comorbidities", words)} AS {name}' for name, words in CONDITION_WORDS.items())}, loaded_at
FROM known_patients)"""


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "admissions", lambda: stage_admissions(raw_admissions(spark, sf)))


STG_ADMISSIONS = f"""known_admissions AS (
SELECT *, {number_sql('admission_date', 'DATE')} AS came, {number_sql('discharge_date', 'DATE')} AS went, {number_sql('los_days')} AS told_days, {number_sql('icu_days')} AS icu,
 upper(trim(admission_type)) AS kind FROM raw_admissions WHERE length(trim(admission_id)) > 0 AND length(trim(patient_id)) > 0),
stg_admissions AS (
SELECT admission_id, patient_id, came AS admission_date, went AS discharge_date, coalesce(told_days, CAST(date_diff('day', came, went) AS INTEGER)) AS length_of_stay_days, trim(department) AS department,
 coalesce({looked_up('kind', ADMISSION_KINDS)}, 'Urgent') AS admission_type, coalesce(trim(discharge_disposition), 'Unknown') AS discharge_disposition,
 trim(primary_diagnosis_category) AS primary_diagnosis_category, icu AS icu_days, CASE WHEN length(trim(drg_code)) > 0 THEN trim(drg_code) END AS drg_code, {number_sql('total_charges', 'DECIMAL(18,2)')} AS total_charges,
 CASE WHEN kind IS NOT NULL THEN {looked_up('kind', EMERGENCY_ROOM)} IS NOT NULL END AS emergency_flag, icu > 0 AS icu_flag,
 {looked_up('trim(readmitted_30_day)', TRUE_WORDS)} IS NOT NULL AS readmit_30day_flag, loaded_at,
 year(came) * 10000 + month(came) * 100 + day(came) AS admit_date_key, year(went) * 10000 + month(went) * 100 + day(went) AS discharge_date_key
FROM known_admissions WHERE told_days IS NULL OR (told_days >= 0 AND told_days <= 365))"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "history", lambda: lookback_history(admissions(spark, sf)))


HISTORY = """history AS (
SELECT *, CAST(admission_date - last_discharge_date AS INTEGER) AS days_since_last_discharge,
 prior_admissions_12m >= 3 AS high_utilizer_flag FROM (
SELECT c.admission_id, c.patient_id, c.admission_date,
 count(p.admission_id) FILTER (WHERE p.admission_date >= c.admission_date - INTERVAL 12 MONTH) AS prior_admissions_12m,
 count(p.admission_id) FILTER (WHERE p.admission_date >= c.admission_date - INTERVAL 90 DAY) AS prior_admissions_90d,
 CAST(coalesce(sum(CAST(p.readmit_30day_flag AS INTEGER)) FILTER (WHERE p.admission_date >= c.admission_date - INTERVAL 12 MONTH), 0) AS BIGINT) AS prior_readmissions_1y,
 count(p.admission_id) FILTER (WHERE p.icu_flag AND p.admission_date >= c.admission_date - INTERVAL 12 MONTH) AS prior_icu_stays,
 round(coalesce(avg(p.length_of_stay_days) FILTER (WHERE p.admission_date >= c.admission_date - INTERVAL 12 MONTH), 0), 2) AS prior_los_avg_days,
 max(p.discharge_date) AS last_discharge_date
FROM stg_admissions c LEFT JOIN stg_admissions p ON p.patient_id = c.patient_id AND p.admission_date < c.admission_date
GROUP BY c.admission_id, c.patient_id, c.admission_date))"""


def comorbidity(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "comorbidity", lambda: comorbidity_scores(patients(spark, sf)))


COMORBIDITY = """cci AS (
SELECT *, charlson_raw + age_adjustment AS charlson_comorbidity_index FROM (
SELECT patient_id, age, comorbidity_count, CAST(has_chf AS INTEGER) AS cci_chf, CAST(has_copd AS INTEGER) AS cci_copd, CAST(has_ckd AS INTEGER) * 2 AS cci_ckd,
 CAST(has_diabetes AS INTEGER) AS cci_diabetes, CAST(has_afib AS INTEGER) AS cci_afib,
 CAST(has_chf AS INTEGER) + CAST(has_copd AS INTEGER) + 2 * CAST(has_ckd AS INTEGER) + CAST(has_diabetes AS INTEGER) + CAST(has_afib AS INTEGER) AS charlson_raw,
 greatest(0, (coalesce(age, 0) - 50) // 10) AS age_adjustment FROM stg_patients))"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Stored predictions: every event of a user is a score of that user's admission at that time."""
    events = table(spark, sf, "events")
    score = F.round((F.col("value") % 1.0).cast("decimal(18,4)"), 4)
    return events.select(
        F.col("event_id").alias("prediction_id"),
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("user_id").cast("string").alias("admission_id"),
        F.col("event_type").alias("model_name"),
        F.lit("1").alias("model_version"),
        F.col("ts").alias("predicted_at"),
        score.alias("risk_score"),
        scoring.risk_tier(score).alias("risk_tier"),
        (F.col("event_id") % 3 == 0).alias("clinician_reviewed"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") > 10).alias("actual_outcome"),
    )


SCORES = """scores AS (SELECT *, CASE WHEN risk_score >= 0.80 THEN 'critical' WHEN risk_score >= 0.65 THEN 'high'
 WHEN risk_score >= 0.35 THEN 'medium' ELSE 'low' END AS risk_tier FROM (
SELECT event_id AS prediction_id, CAST(user_id AS VARCHAR) AS patient_id, CAST(user_id AS VARCHAR) AS admission_id,
 event_type AS model_name, '1' AS model_version, ts AS predicted_at,
 CAST(value % 1.0 AS DECIMAL(18,4)) AS risk_score, event_id % 3 = 0 AS clinician_reviewed,
 CASE WHEN event_id % 4 <> 0 THEN value > 10 END AS actual_outcome FROM events))"""


def with_tables(*parts: str) -> str:
    """A WITH clause of the given expressions followed by the last part."""
    *tables, last = parts
    return "WITH " + ",\n".join(tables) + "\n" + last


ADMISSION_TABLES = (RAW_ADMISSIONS, STG_ADMISSIONS)
PATIENT_TABLES = (RAW_PATIENTS, STG_PATIENTS)


def half_up(numerator: str, denominator: str, places: int) -> str:
    """SQL for an integer ratio rounded half away from zero, NULL for an empty group."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE CAST(sign({n}) * ((2 * abs({n}) * {10 ** places} + {d}) // (2 * {d})) AS DOUBLE) / {10 ** places} END)"
    )


def mean_sql(expression: str, places: int, scale: int = 1, over: str = "") -> str:
    """SQL for the exact mean of a measure with up to four decimals, rounded half away from zero."""
    total = f"(sum(CAST({expression} AS DECIMAL(18,4))) {over} * 10000)"
    return half_up(f"coalesce({total}, 0) * {scale}", f"(count({expression}) {over} * 10000)", places)


def share_sql(flag: str, places: int = 4, scale: int = 1) -> str:
    return mean_sql(f"CAST({flag} AS INTEGER)", places, scale)

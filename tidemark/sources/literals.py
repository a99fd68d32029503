"""Small fixed lookup tables as DataFrames.

They are literal rows, so Spark knows their size and broadcasts them on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Benchmark rates, departments, dispositions, diagnoses, procedures.
BENCHMARK_RATES = [
    ("Cardiology", "0.180"), ("Internal Medicine", "0.140"), ("Pulmonology", "0.160"), ("Neurology", "0.120"),
    ("Orthopedics", "0.080"), ("Nephrology", "0.200"), ("Oncology", "0.150"), ("Endocrinology", "0.130"),
    ("Gastroenterology", "0.100"), ("General Surgery", "0.090"), ("Medical ICU", "0.250"), ("Cardiac ICU", "0.230"),
]
DEPARTMENTS = [
    ("CARD", "Cardiology", "Heart & Vascular", False, False, "0.180"),
    ("IMED", "Internal Medicine", "General Medicine", False, False, "0.140"),
    ("PULM", "Pulmonology", "Respiratory", False, False, "0.160"),
    ("NEUR", "Neurology", "Neuroscience", False, False, "0.120"),
    ("ORTH", "Orthopedics", "Musculoskeletal", False, True, "0.080"),
    ("NEPH", "Nephrology", "Kidney Care", False, False, "0.200"),
    ("ONCO", "Oncology", "Cancer Center", False, True, "0.150"),
    ("ENDO", "Endocrinology", "Metabolic Health", False, False, "0.130"),
    ("GAST", "Gastroenterology", "GI Services", False, True, "0.100"),
    ("GSUR", "General Surgery", "Surgical Services", False, True, "0.090"),
    ("MICU", "Medical ICU", "Critical Care", True, False, "0.250"),
    ("CICU", "Cardiac ICU", "Critical Care", True, False, "0.230"),
    ("NICU", "Neurological ICU", "Critical Care", True, False, "0.210"),
]
DISPOSITIONS = [
    ("01", "Home", "Home", False, "Home"),
    ("06", "Home with Home Health Agency", "Home", False, "Home"),
    ("02", "Short-term General Hospital", "Transfer", True, "Transfer"),
    ("03", "Skilled Nursing Facility", "Post-Acute", True, "Post-Acute Care"),
    ("04", "Intermediate Care Facility", "Post-Acute", True, "Post-Acute Care"),
    ("05", "Another Type of Institution", "Post-Acute", True, "Post-Acute Care"),
    ("62", "Inpatient Rehabilitation Facility", "Post-Acute", True, "Post-Acute Care"),
    ("63", "Long-term Care Hospital", "Post-Acute", True, "Post-Acute Care"),
    ("65", "Psychiatric Hospital", "Post-Acute", True, "Post-Acute Care"),
    ("07", "Left Against Medical Advice", "AMA", True, "AMA"),
    ("20", "Expired", "Expired", False, "Expired"),
    ("21", "Expired — Medically Assisted Death", "Expired", False, "Expired"),
    ("30", "Still Patient", "Other", False, "Other"),
    ("50", "Hospice — Home", "Hospice", False, "Hospice"),
    ("51", "Hospice — Medical Facility", "Hospice", False, "Hospice"),
]
DIAGNOSES = [
    ("I50.9", "Heart failure, unspecified", "Cardiovascular", True, True),
    ("I50.1", "Left ventricular failure, unspecified", "Cardiovascular", True, True),
    ("I50.20", "Unspecified systolic heart failure", "Cardiovascular", True, True),
    ("I50.30", "Unspecified diastolic heart failure", "Cardiovascular", True, True),
    ("I50.40", "Unspecified combined systolic and diastolic HF", "Cardiovascular", True, True),
    ("J44.1", "Chronic obstructive pulmonary disease with exacerbation", "Respiratory", True, True),
    ("J44.0", "COPD with acute lower respiratory infection", "Respiratory", True, True),
    ("J44.9", "COPD, unspecified", "Respiratory", True, False),
    ("J18.9", "Pneumonia, unspecified organism", "Respiratory", False, False),
    ("J18.1", "Lobar pneumonia, unspecified organism", "Respiratory", False, False),
    ("J15.9", "Unspecified bacterial pneumonia", "Respiratory", False, False),
    ("J15.1", "Pneumonia due to Pseudomonas", "Respiratory", False, False),
    ("A41.9", "Sepsis, unspecified organism", "Infectious", False, True),
    ("A41.51", "Sepsis due to Escherichia coli", "Infectious", False, True),
    ("A41.01", "Sepsis due to methicillin susceptible Staph aureus", "Infectious", False, True),
    ("A40.0", "Sepsis due to streptococcus, group A", "Infectious", False, True),
    ("E11.9", "Type 2 diabetes mellitus without complications", "Endocrine", True, False),
    ("E11.65", "Type 2 diabetes with hyperglycemia", "Endocrine", True, True),
    ("E11.649", "Type 2 diabetes with hypoglycemia without coma", "Endocrine", True, True),
    ("E10.9", "Type 1 diabetes mellitus without complications", "Endocrine", True, False),
    ("I21.9", "Acute myocardial infarction, unspecified", "Cardiovascular", False, True),
    ("I21.3", "ST elevation MI of unspecified site", "Cardiovascular", False, True),
    ("I21.0", "STEMI of anterior wall", "Cardiovascular", False, True),
    ("I21.4", "Non-ST elevation myocardial infarction", "Cardiovascular", False, True),
    ("I63.9", "Cerebral infarction, unspecified", "Neurological", False, True),
    ("I63.50", "Cerebral infarction due to unspecified occlusion or stenosis", "Neurological", False, True),
    ("N18.5", "Chronic kidney disease, stage 5", "Renal", True, True),
    ("N18.6", "End stage renal disease", "Renal", True, True),
    ("N18.4", "Chronic kidney disease, stage 4", "Renal", True, True),
    ("N18.3", "Chronic kidney disease, stage 3 (unspecified)", "Renal", True, False),
    ("S72.001A", "Fracture of unspecified part of neck of right femur", "Musculoskeletal", False, False),
    ("S72.002A", "Fracture of unspecified part of neck of left femur", "Musculoskeletal", False, False),
    ("N39.0", "Urinary tract infection, site not specified", "Genitourinary", False, False),
    ("N10", "Acute pyelonephritis", "Genitourinary", False, False),
    ("I10", "Essential (primary) hypertension", "Cardiovascular", True, False),
    ("I48.91", "Unspecified atrial fibrillation", "Cardiovascular", True, True),
    ("E66.9", "Obesity, unspecified", "Endocrine", True, False),
    ("F32.9", "Major depressive disorder, single episode, unspecified", "Psychiatric", True, False),
    ("D64.9", "Anemia, unspecified", "Hematological", False, False),
    ("E03.9", "Hypothyroidism, unspecified", "Endocrine", True, False),
]
PROCEDURES = [
    ("99232", "Subsequent hospital care, moderate complexity", "E&M", 2, False, False),
    ("99233", "Subsequent hospital care, high complexity", "E&M", 3, False, False),
    ("93306", "Echo transthoracic real-time w/ image doc, complete", "Imaging", 2, False, True),
    ("93307", "Echo transthoracic real-time w/ image doc, limited", "Imaging", 1, False, True),
    ("71046", "Radiologic examination chest, 2 views", "Imaging", 1, False, True),
    ("80053", "Comprehensive metabolic panel", "Lab", 1, False, True),
    ("85025", "Blood count; complete (CBC), automated", "Lab", 1, False, True),
    ("36415", "Collection of venous blood by venipuncture", "Procedure", 1, False, False),
    ("93000", "Electrocardiogram routine ECG with 12 leads", "Diagnostic", 1, False, True),
    ("99291", "Critical care, evaluation and management, first hour", "E&M", 5, False, False),
    ("31500", "Endotracheal intubation, emergency", "Procedure", 4, False, False),
    ("36561", "Insert tunneled CVC, age 5 or older", "Surgery", 4, True, False),
    ("92953", "Temporary transcutaneous pacing", "Procedure", 4, False, False),
    ("43239", "EGD with biopsy single/multiple", "Surgery", 3, True, True),
]


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a table."""
    return spark.createDataFrame(rows, schema)


def benchmark_rates(spark: SparkSession, rows: list[tuple[str, str]] = BENCHMARK_RATES) -> DataFrame:
    frame = values_table(spark, rows, "department_name string, benchmark_readmission_rate string")
    return frame.withColumn("benchmark_readmission_rate", frame.benchmark_readmission_rate.cast("decimal(10,4)"))


def departments(spark: SparkSession, rows: list[tuple] = DEPARTMENTS) -> DataFrame:
    frame = values_table(
        spark, rows,
        "department_code string, department_name string, service_line string, is_icu boolean, is_surgical boolean, "
        "benchmark_readmission_rate string",
    )
    return frame.withColumn("benchmark_readmission_rate", frame.benchmark_readmission_rate.cast("decimal(10,4)"))


def dispositions(spark: SparkSession, rows: list[tuple] = DISPOSITIONS) -> DataFrame:
    return values_table(
        spark, rows,
        "disposition_code string, disposition_name string, disposition_group string, high_risk_flag boolean, cms_category string",
    )


def diagnoses(spark: SparkSession, rows: list[tuple] = DIAGNOSES) -> DataFrame:
    return values_table(spark, rows, "icd10_code string, icd10_description string, category string, chronic_flag boolean, high_readmission_risk_flag boolean")


def procedures(spark: SparkSession, rows: list[tuple] = PROCEDURES) -> DataFrame:
    return values_table(spark, rows, "cpt_code string, cpt_description string, procedure_category string, complexity_tier int, is_surgical boolean, is_diagnostic boolean")

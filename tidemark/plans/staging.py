"""Raw text tables to typed staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cleaning as c
from tidemark.operators.joins import enrich


def _present(name: str) -> Column:
    return F.trim(F.col(name)) != ""


def stage_patients(raw: DataFrame, as_of: Column) -> DataFrame:
    age = c.blank_to_null_cast("age", "int")
    return raw.filter(_present("patient_id")).select(
        "patient_id",
        "mrn",
        age.alias("age"),
        age.alias("age_at_snapshot"),
        c.birth_year(age, as_of).alias("birth_year"),
        c.age_group(age).alias("age_group"),
        c.gender("gender").alias("gender"),
        F.trim("ethnicity").alias("race_ethnicity"),
        c.zip_prefix("zip_code").alias("zip_code_prefix"),
        F.upper(F.trim("state")).alias("state"),
        F.trim("primary_language").alias("primary_language"),
        c.insurance_category("insurance_type").alias("insurance_category"),
        c.blank_to_null_cast("num_comorbidities", "int").alias("comorbidity_count"),
        F.trim("comorbidities").alias("comorbidities_raw"),
        *[flag.alias(name) for name, flag in c.keyword_flags("comorbidities").items()],
        "loaded_at",
    )


def stage_admissions(raw: DataFrame, longest_stay: int = 365) -> DataFrame:
    admitted = c.blank_to_null_cast("admission_date", "date")
    discharged = c.blank_to_null_cast("discharge_date", "date")
    stay = c.blank_to_null_cast("los_days", "int")
    icu_days = c.blank_to_null_cast("icu_days", "int")
    kept = raw.filter(_present("admission_id") & _present("patient_id")).filter(
        stay.isNull() | stay.between(0, longest_stay)
    )
    return kept.select(
        "admission_id",
        "patient_id",
        admitted.alias("admission_date"),
        discharged.alias("discharge_date"),
        c.length_of_stay(stay, admitted, discharged).alias("length_of_stay_days"),
        F.trim("department").alias("department"),
        c.admission_type("admission_type").alias("admission_type"),
        F.coalesce(F.trim("discharge_disposition"), F.lit("Unknown")).alias("discharge_disposition"),
        F.trim("primary_diagnosis_category").alias("primary_diagnosis_category"),
        icu_days.alias("icu_days"),
        c.blank_to_null("drg_code").alias("drg_code"),
        c.blank_to_null_cast("total_charges", "decimal(18,2)").alias("total_charges"),
        c.emergency_flag("admission_type").alias("emergency_flag"),
        c.icu_flag(icu_days).alias("icu_flag"),
        c.truthy("readmitted_30_day").alias("readmit_30day_flag"),
        c.date_key(admitted).alias("admit_date_key"),
        c.date_key(discharged).alias("discharge_date_key"),
        "loaded_at",
    )


def stage_diagnoses(raw: DataFrame, reference: DataFrame) -> DataFrame:
    """Clean diagnosis rows with the category and flags of their normalised code."""
    code = F.upper(F.trim("icd10_code"))
    kept = raw.filter(
        _present("diagnosis_id") & F.col("admission_id").isNotNull() & _present("icd10_code")
    )
    fields = ["category", "icd10_description", "chronic_flag", "high_readmission_risk_flag"]
    return enrich(kept, reference, code, "icd10_code", fields).select(
        "diagnosis_id",
        "admission_id",
        code.alias("icd10_code"),
        F.trim("description").alias("raw_description"),
        c.valid_icd10("icd10_code").alias("valid_icd10_format"),
        c.diagnosis_type("diagnosis_type").alias("diagnosis_type"),
        c.blank_to_null_cast("sequence", "smallint").alias("sequence_number"),
        F.col("category").alias("diagnosis_category"),
        "icd10_description",
        "chronic_flag",
        "high_readmission_risk_flag",
        F.lit(None).cast("boolean").alias("poa_flag"),
        "loaded_at",
    )

"""The default library of evidence-based actions.

A rule applies when all its triggers hold (``__gte`` is a lower bound) or when one of its trigger codes is present.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _rule(category, action, rationale, triggers, grade, source, pct, role, when, codes, code_triggers=()):
    return {
        "action": action, "category": category, "rationale_template": rationale, "triggers": triggers, "evidence_grade": grade,
        "source": source, "reduces_readmission_by_pct": pct, "responsible_role": role, "time_sensitivity": when,
        "icd10_relevance": list(codes), "icd10_trigger": list(code_triggers),
    }


# The actions, their triggers and their evidence.
ACTION_LIBRARY: dict[str, dict[str, Any]] = {
    "chf_home_health": _rule(
        "discharge_planning", "Arrange home health nursing for daily weight monitoring and medication assessment",
        "Patient has CHF with {prior_admissions_12m} prior admissions. Daily weight monitoring detects fluid retention before decompensation.",
        {"has_chf": True, "prior_admissions_12m__gte": 1}, "A", "ACC/AHA Heart Failure Guidelines 2022 (Class I, LOE B-R)", 28,
        "care_coordinator", "before_discharge", ["I50.9", "I50.1", "I50.20", "I50.30", "I50.40"],
    ),
    "snf_placement_complex": _rule(
        "discharge_planning", "Evaluate for skilled nursing facility (SNF) placement prior to discharge",
        "LOS {length_of_stay_days} days with CCI {charlson_comorbidity_index} suggests patient cannot safely self-manage at home.",
        {"length_of_stay_days__gte": 7, "charlson_comorbidity_index__gte": 4, "age__gte": 70}, "B",
        "NEJM JAMA Hospitalist Best Practices 2021", 18, "care_coordinator", "before_discharge", [],
    ),
    "early_followup_appointment": _rule(
        "discharge_planning", "Schedule follow-up appointment within 7 days of discharge (primary care or specialist)",
        "Early outpatient follow-up within 7 days reduces 30-day readmission by 25% in high-risk patients.",
        {"readmit_30day_flag__history_gte": 1}, "A", "JAMA Internal Medicine 2015; CMS Transitional Care Management", 25,
        "care_coordinator", "before_discharge", [],
    ),
    "transitional_care_nurse": _rule(
        "discharge_planning", "Assign transitional care nurse for 30-day post-discharge phone follow-up protocol",
        "Patient profile matches Coleman Care Transitions Intervention candidates: high CCI, prior readmission history.",
        {"charlson_comorbidity_index__gte": 3, "prior_readmissions_1y__gte": 1}, "A",
        "Coleman Care Transitions Intervention (JAMA 2006)", 22, "care_coordinator", "before_discharge", [],
    ),
    "copd_pulmonary_rehab": _rule(
        "discharge_planning", "Enroll patient in outpatient pulmonary rehabilitation program",
        "Post-exacerbation COPD patients benefit from pulmonary rehab, which reduces readmission and improves exercise tolerance.",
        {"has_copd": True, "icu_flag": True}, "A", "GOLD COPD Guidelines 2023 — Group D recommendation", 31,
        "care_coordinator", "within_7d", ["J44.1", "J44.0"],
    ),
    "medication_reconciliation": _rule(
        "medication_management", "Complete pharmacist-led medication reconciliation before discharge",
        "Patient is on multiple medications. Polypharmacy (comorbidity count {comorbidity_count}) significantly increases adverse drug event risk post-discharge.",
        {"comorbidity_count__gte": 3}, "A", "ISMP; Joint Commission NPSG.03.06.01", 14, "pharmacist", "before_discharge", [],
    ),
    "chf_loop_diuretic_titration": _rule(
        "medication_management", "Optimize loop diuretic dosing; verify weight-based titration instructions given to patient",
        "CHF readmissions are commonly caused by fluid retention. Clear diuretic self-titration instructions reduce ER visits.",
        {"has_chf": True}, "B", "ACC/AHA 2022 Heart Failure Guideline 7.4 — Self-care", 16, "pharmacist", "before_discharge",
        ["I50.9", "I50.20", "I50.30"],
    ),
    "insulin_education_diabetes": _rule(
        "medication_management", "Provide structured insulin self-administration and hypoglycemia management education",
        "Patient with Type 2 DM requires insulin education to prevent hypoglycemia-related ER visits post-discharge.",
        {"has_diabetes": True, "charlson_comorbidity_index__gte": 2}, "B", "ADA Standards of Care in Diabetes 2024 — Section 5", 19,
        "pharmacist", "before_discharge", ["E11.9", "E11.65", "E10.9"],
    ),
    "anticoagulation_monitoring_afib": _rule(
        "medication_management", "Schedule anticoagulation clinic follow-up within 1 week post-discharge",
        "Patient with A-Fib on anticoagulation requires INR/anti-Xa monitoring to prevent bleeding or stroke.",
        {"has_afib": True}, "A", "AHA/ACC AFib Guidelines 2023 — Section 8.2", 20, "pharmacist", "within_7d", ["I48.91"],
    ),
    "ckd_nephrotoxic_avoidance": _rule(
        "medication_management", "Review and discontinue/substitute nephrotoxic medications (NSAIDs, contrast agents, ACE+ARB combination)",
        "CKD Stage {ckd_stage} patient is at high risk for AKI. Nephrotoxic drug avoidance reduces eGFR decline and prevents dialysis initiation.",
        {"has_ckd": True}, "A", "KDIGO CKD Guidelines 2022 — Chapter 3.1.14", 15, "pharmacist", "before_discharge",
        ["N18.3", "N18.4", "N18.5", "N18.6"],
    ),
    "chf_symptom_education": _rule(
        "patient_education", "Provide teach-back education on CHF warning signs: sudden weight gain, ankle edema, shortness of breath at rest",
        "Teach-back CHF symptom education reduces 30-day readmission by enabling patients to recognize decompensation early.",
        {"has_chf": True}, "A", "Teach-to-Goal (TTG) RCT, JAMA 2013", 21, "nurse", "before_discharge", ["I50.9", "I50.1"],
    ),
    "copd_inhaler_technique": _rule(
        "patient_education", "Demonstrate and verify correct inhaler technique for COPD maintenance and rescue inhalers",
        "Incorrect inhaler technique is present in 70-80% of COPD patients and directly causes preventable exacerbations.",
        {"has_copd": True}, "A", "GOLD 2023 — Patient education section 5", 24, "nurse", "before_discharge", ["J44.1", "J44.0", "J44.9"],
    ),
    "diabetes_hypoglycemia_signs": _rule(
        "patient_education", "Educate patient and caregiver on hypoglycemia recognition and emergency glucose protocols",
        "Hypoglycemia is the leading cause of DM-related ER visits. Patient education reduces ER presentation rate by 30%.",
        {"has_diabetes": True}, "A", "ADA 2024 Standards of Care — Section 6: Glycemic Targets", 17, "nurse", "before_discharge",
        ["E11.649", "E11.65"],
    ),
    "sepsis_red_flag_education": _rule(
        "patient_education",
        "Educate patient and family on post-sepsis syndrome: fatigue, cognitive changes, immune vulnerability, red flags for re-infection",
        "Post-sepsis patients have 30% 90-day readmission rate. Early recognition of recurring infection signs reduces mortality.",
        {}, "B", "Post-Sepsis Syndrome Guidelines, Critical Care Medicine 2020", 15, "nurse", "before_discharge", ["A41.9", "A41.51"],
        ["A41.9", "A41.51", "A41.01"],
    ),
    "ckd_diet_fluid_education": _rule(
        "patient_education", "Provide renal diet education: fluid restriction, low-potassium, low-phosphorus, and protein guidance",
        "CKD dietary non-adherence is a leading cause of electrolyte crises requiring hospitalization.",
        {"has_ckd": True}, "A", "KDIGO CKD 2022 — Chapter 3.1.13", 12, "nurse", "before_discharge", ["N18.5", "N18.6"],
    ),
    "social_work_sdoh_screening": _rule(
        "social_support", "Complete PRAPARE social determinants of health (SDoH) screening; connect with community health worker",
        "Patient's insurance (Medicaid) and age suggest potential housing instability, food insecurity, or transportation barriers that increase readmission risk.",
        {"insurance_category": "Medicaid"}, "B", "NACHC PRAPARE Tool; NEJM Catalyst SDoH Framework 2020", 18, "social_worker", "before_discharge", [],
    ),
    "transportation_assistance": _rule(
        "social_support", "Arrange medical transportation for post-discharge follow-up appointments",
        "Transportation barriers are responsible for 20-30% of missed follow-up appointments, directly causing preventable readmissions.",
        {"insurance_category": "Medicaid", "age__gte": 70}, "B", "Health Affairs 2017 — NEMT and Readmission Reduction", 11,
        "social_worker", "before_discharge", [],
    ),
    "caregiver_support_assessment": _rule(
        "social_support", "Assess caregiver availability and burden; refer to caregiver support services if isolated patient",
        "Patient age {age} and complexity level suggest need for caregiver support assessment to prevent self-care gaps.",
        {"age__gte": 75, "comorbidity_count__gte": 3}, "B", "AARP Caregiving Report 2023; JAMA Internal Medicine 2019", 13,
        "social_worker", "before_discharge", [],
    ),
    "food_insecurity_referral": _rule(
        "social_support", "Screen for food insecurity (HFSSM-2 item screen); refer to hospital food pantry or Meals on Wheels",
        "Food insecurity is associated with 2x readmission risk in patients with diabetes and heart failure.",
        {"has_diabetes": True, "insurance_category": "Medicaid"}, "B", "Hunger Free America; JAMA Network Open 2020", 9,
        "social_worker", "before_discharge", [],
    ),
    "daily_weight_monitoring": _rule(
        "clinical_monitoring", "Instruct patient to weigh daily and call if weight increases >2 lbs in 1 day or >5 lbs in 1 week",
        "Weight monitoring is the most sensitive early warning for CHF decompensation. Guideline-mandated for all CHF patients at discharge.",
        {"has_chf": True}, "A", "ACC/AHA 2022 Heart Failure Guidelines — 7.2 Self-monitoring", 22, "nurse", "before_discharge",
        ["I50.9", "I50.20", "I50.30"],
    ),
    "blood_glucose_monitoring": _rule(
        "clinical_monitoring", "Prescribe structured home blood glucose monitoring schedule; target fasting glucose 80-130 mg/dL",
        "Glycemic instability post-discharge is associated with wound complications and infection-related readmissions.",
        {"has_diabetes": True}, "A", "ADA Standards of Care 2024 — Section 7: Technology", 14, "physician", "before_discharge",
        ["E11.9", "E11.65", "E10.9"],
    ),
    "ckd_labs_followup": _rule(
        "clinical_monitoring", "Order CMP (creatinine, eGFR, potassium) and urinalysis within 2 weeks post-discharge",
        "CKD patients require close electrolyte monitoring post-hospitalization to detect AKI or electrolyte imbalances.",
        {"has_ckd": True}, "A", "KDIGO 2022 AKI Guideline — Post-AKI follow-up", 16, "physician", "within_7d",
        ["N18.3", "N18.4", "N18.5", "N18.6"],
    ),
    "vital_signs_remote_monitoring": _rule(
        "clinical_monitoring", "Enroll patient in remote vital sign monitoring program (blood pressure, SpO2 telemonitoring)",
        "High-utilizer patients benefit from remote monitoring, which catches deterioration 2-3 days earlier than scheduled visits.",
        {"high_utilizer_flag": True, "prior_admissions_12m__gte": 3}, "B", "JAMA Cardiology 2020 — Remote Monitoring RCT; CMS RCHC Model", 26,
        "care_coordinator", "within_48h", [],
    ),
    "icu_followup_clinic": _rule(
        "clinical_monitoring", "Schedule ICU follow-up clinic appointment within 2 weeks post-discharge",
        "Post-ICU patients have high rates of PTSD, cognitive impairment, and physical deconditioning requiring structured follow-up.",
        {"icu_flag": True, "icu_days__gte": 3}, "B", "Post-ICU Syndrome (PICS) Framework — Critical Care Medicine 2019", 20, "physician",
        "within_7d", [],
    ),
    "cardiology_referral_chf": _rule(
        "specialist_referral", "Refer to heart failure specialty clinic within 14 days of discharge",
        "CHF patients seen in a specialty clinic within 14 days post-discharge have 34% lower 30-day readmission rates.",
        {"has_chf": True, "prior_readmissions_1y__gte": 1}, "A", "JAMA 2011 — Post-Discharge HF Clinic RCT; ACC/AHA 2022", 34, "physician",
        "within_7d", ["I50.9", "I50.20"],
    ),
    "nephrology_referral_ckd": _rule(
        "specialist_referral", "Refer to nephrology for eGFR <30 or rapid decline in kidney function",
        "CKD Stage 4-5 patients benefit from nephrology co-management for dialysis preparation, anemia management, and CKD progression prevention.",
        {"has_ckd": True, "charlson_comorbidity_index__gte": 3}, "A", "KDIGO CKD 2022 — Chapter 5: Referral to Specialist", 17, "physician",
        "within_7d", ["N18.4", "N18.5", "N18.6"],
    ),
    "pulmonology_referral_copd": _rule(
        "specialist_referral", "Refer to pulmonology for spirometry review and management optimization if FEV1 < 50% predicted",
        "Post-exacerbation COPD patients benefit from specialist-optimized maintenance therapy to reduce future exacerbations.",
        {"has_copd": True, "prior_admissions_12m__gte": 2}, "A", "GOLD 2023 — Exacerbation Prevention, Group D", 27, "physician",
        "within_7d", ["J44.1", "J44.0"],
    ),
    "endocrinology_referral_dm": _rule(
        "specialist_referral", "Refer to endocrinology or diabetes educator for structured diabetes self-management training (DSMT)",
        "DSMT is associated with 26% lower all-cause hospitalization in uncontrolled T2DM patients.",
        {"has_diabetes": True, "prior_admissions_12m__gte": 2}, "A", "ADA 2024 — Section 5: Facilitating Behavior Change", 23, "physician",
        "within_7d", ["E11.65", "E11.649"],
    ),
    "psychiatry_referral_depression": _rule(
        "specialist_referral", "Screen for depression (PHQ-9); refer to behavioral health services if PHQ-9 ≥ 10",
        "Depression is present in 25% of CHF patients and doubles readmission risk. Untreated depression reduces medication adherence.",
        {"has_depression": True}, "B", "AHA/ACC Depression and Heart Disease Statement 2021", 18, "physician", "within_7d", ["F32.9"],
    ),
    "cardiac_rehab_post_ami": _rule(
        "specialist_referral", "Refer to cardiac rehabilitation program (minimum 36 sessions) post-MI or post-CABG",
        "Cardiac rehab reduces post-MI mortality by 25% and readmission by 31%. Enrollment rates remain low (<30%); active referral is critical.",
        {}, "A", "ACC/AHA STEMI Guidelines 2013 — Class I; Cochrane SR 2016", 31, "care_coordinator", "within_7d",
        ["I21.9", "I21.3", "I21.0", "I21.4"], ["I21.9", "I21.3", "I21.0", "I21.4"],
    ),
}


def read_library(spark: SparkSession, path: str) -> dict[str, dict[str, Any]]:
    """A library of the same form from one JSON file on any file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])

"""Cleaning, standardising and encoding of raw text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category spellings, bands, codes and keyword lists.
ADMISSION_TYPES = {"Emergency": ["EMERGENCY", "ED", "ER", "URGENT CARE"], "Elective": ["ELECTIVE", "SCHEDULED"]}
EMERGENCY_SPELLINGS = ["EMERGENCY", "ED", "ER"]
GENDERS = {"Male": ["M", "MALE"], "Female": ["F", "FEMALE"]}
DIAGNOSIS_TYPES = {"Primary": ["PRIMARY", "PRINCIPAL", "ADMITTING"], "Discharge": ["DISCHARGE", "FINAL"]}
COMMERCIAL_PLANS = ["HMO", "PPO", "COMMERCIAL", "BLUE CROSS", "AETNA", "CIGNA", "HUMANA"]
TRUE_SPELLINGS = ["1", "true", "True", "TRUE", "yes", "Yes"]
AGE_BANDS = [(30, "18-30"), (45, "31-45"), (60, "46-60"), (75, "61-75")]
OLDEST_BAND = "76+"
CONDITION_KEYWORDS = {
    "has_diabetes": ["DIABETES"],
    "has_hypertension": ["HYPERTENSION"],
    "has_chf": ["HEART FAILURE", "CHF"],
    "has_copd": ["COPD"],
    "has_ckd": ["CKD", "CHRONIC KIDNEY"],
    "has_afib": ["ATRIAL", "AFIB"],
    "has_obesity": ["OBESITY", "OBESE"],
    "has_depression": ["DEPRESSION"],
}
LOAD_CONDITION_KEYWORDS = {
    "has_diabetes": ["DIABETES"],
    "has_hypertension": ["HYPERTENSION"],
    "has_chf": ["HEART FAILURE"],
    "has_copd": ["COPD"],
    "has_ckd": ["CKD", "KIDNEY"],
    "has_afib": ["ATRIAL"],
    "has_obesity": ["OBESITY"],
    "has_depression": ["DEPRESSION"],
}
AGE_GROUP_CODES = {"18-30": 0, "31-45": 1, "46-60": 2, "61-75": 3}
GENDER_CODES = {"Male": 0, "Female": 1}
INSURANCE_CODES = {"Medicare": 0, "Medicaid": 1, "Commercial": 2}
ADMISSION_TYPE_CODES = {"Emergency": 2, "Urgent": 1}
FEATURE_LABELS = {
    "prior_admissions_12m": "Prior admissions (12 months)",
    "prior_admissions_90d": "Prior admissions (90 days)",
    "prior_readmissions_1y": "Prior readmissions (1 year)",
    "prior_icu_stays": "Prior ICU stays",
    "charlson_comorbidity_index": "Charlson Comorbidity Index",
    "comorbidity_count": "Number of comorbidities",
    "length_of_stay_days": "Current length of stay",
    "icu_days": "ICU days this admission",
    "high_utilizer_flag": "High utilizer flag",
    "icu_flag": "ICU admission",
    "emergency_flag": "Emergency admission",
    "age": "Patient age",
    "has_diabetes": "Diabetes",
    "has_chf": "Congestive heart failure",
    "has_copd": "COPD",
    "has_ckd": "Chronic kidney disease",
    "has_afib": "Atrial fibrillation",
    "has_depression": "Depression",
    "days_since_last_discharge": "Days since last discharge",
    "admitted_on_weekend": "Admitted on weekend",
    "total_charges": "Total charges",
    "prior_los_avg_days": "Avg LOS of prior admissions",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, blank as NULL."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def blank_to_null_cast(c: Column | str, data_type: str) -> Column:
    """Trimmed text cast to a type; blanks and unreadable values become NULL."""
    return blank_to_null(c).try_cast(data_type)


def unreadable(c: Column | str, data_type: str) -> Column:
    """True where text is present but does not cast; feed it to a quality rule."""
    return blank_to_null(c).isNotNull() & blank_to_null_cast(c, data_type).isNull()


def length_of_stay(given: Column, start: Column, end: Column) -> Column:
    """The stated stay, else days between the dates."""
    return F.coalesce(given, F.datediff(end, start))


def map_spellings(c: Column | str, spellings: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """First label whose spellings hold the upper-cased trimmed value; NULL goes to ``otherwise``."""
    value = F.upper(F.trim(col(c)))
    labels = reduce(
        lambda chain, item: chain.when(value.isin(list(item[1])), item[0]), spellings.items(), F
    )
    return labels.otherwise(otherwise)


def admission_type(c: Column | str) -> Column:
    return map_spellings(c, ADMISSION_TYPES, "Urgent")


def gender(c: Column | str) -> Column:
    return map_spellings(c, GENDERS, "Other")


def diagnosis_type(c: Column | str) -> Column:
    return map_spellings(c, DIAGNOSIS_TYPES, "Secondary")


def emergency_flag(c: Column | str) -> Column:
    """NULL on NULL; narrower than the Emergency label."""
    return F.upper(F.trim(col(c))).isin(EMERGENCY_SPELLINGS)


def icu_flag(icu_days: Column | str) -> Column:
    return col(icu_days) > 0


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).isin(TRUE_SPELLINGS), F.lit(False))


def date_key(c: Column | str) -> Column:
    """Date as YYYYMMDD integer."""
    d = col(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def age_group(c: Column | str, lowest: int = 0) -> Column:
    """Age band; ages under ``lowest`` and NULL fall into the oldest band."""
    age = col(c)
    bands = reduce(
        lambda chain, band: chain.when((age >= lowest) & (age <= band[0]), band[1]), AGE_BANDS, F
    )
    return bands.otherwise(OLDEST_BAND)


def insurance_category(c: Column | str) -> Column:
    value = F.upper(F.trim(col(c)))
    return (
        F.when(value.contains("MEDICARE"), "Medicare")
        .when(value.contains("MEDICAID"), "Medicaid")
        .when(value.isin(COMMERCIAL_PLANS), "Commercial")
        .otherwise("Other")
    )


def insurance_category_at_load(c: Column | str) -> Column:
    """Looser plan patterns used on the warehouse load path."""
    value = col(c)
    return (
        F.when(value.ilike("Medicare"), "Medicare")
        .when(value.ilike("Medicaid"), "Medicaid")
        .when(value.ilike("%HMO%") | value.ilike("%PPO%") | value.ilike("Commercial%"), "Commercial")
        .otherwise("Other")
    )


def zip_prefix(c: Column | str, digits: int = 3) -> Column:
    return F.left(F.regexp_replace(F.trim(col(c)), "[^0-9]", ""), F.lit(digits))


def birth_year(age: Column | str, as_of: Column) -> Column:
    return F.year(as_of) - col(age)


def keyword_flags(c: Column | str, keywords: Mapping[str, Sequence[str]] = CONDITION_KEYWORDS) -> dict[str, Column]:
    """One boolean per name: the upper-cased text holds any of its keywords; NULL on NULL text."""
    text = F.upper(col(c))
    return {
        name: reduce(lambda a, b: a | b, [text.contains(word) for word in words])
        for name, words in keywords.items()
    }


def valid_icd10(c: Column | str) -> Column:
    return F.trim(col(c)).rlike("^[A-Z][0-9]{2}")


def encode(c: Column | str, codes: Mapping[str, int], otherwise: int) -> Column:
    """Ordinal code of a label; unlisted and NULL get ``otherwise``."""
    value = col(c)
    chain = reduce(lambda acc, item: acc.when(value == item[0], item[1]), codes.items(), F)
    return chain.otherwise(otherwise)


def iso_weekday(c: Column | str) -> Column:
    return F.weekday(col(c)) + 1


def is_weekend(c: Column | str) -> Column:
    return F.weekday(col(c)) >= 5


def period_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def fill_template(template: Column | str, fields: Mapping[str, Column]) -> Column:
    """Put ``{field}`` values into the template; leave it as it is if any field it names is missing."""
    text = col(template)
    filled = reduce(
        lambda acc, item: F.replace(acc, F.lit("{" + item[0] + "}"), F.coalesce(item[1].cast("string"), F.lit("None"))),
        fields.items(),
        text,
    )
    return F.when(filled.rlike(r"\{[A-Za-z_][A-Za-z0-9_]*\}"), text).otherwise(filled)


def feature_label(c: Column | str) -> Column:
    """Display label of a feature name; unknown names are spaced and title-cased."""
    name = col(c)
    known = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))

import hashlib
import hmac
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as c
from tidemark.functions import masking as m
from tidemark.functions import scoring as s


@pytest.mark.parametrize(
    "fn, values, expected",
    [
        (lambda x: c.blank_to_null_cast(x, "int"), [" 7 ", "", "  ", "x", None], [7, None, None, None, None]),
        (c.admission_type, ["ed", " Urgent Care", "scheduled", "other", None], ["Emergency", "Emergency", "Elective", "Urgent", "Urgent"]),
        (c.emergency_flag, ["er", "URGENT CARE", None], [True, False, None]),
        (c.truthy, [" 1", "Yes", "yES", "0", None], [True, True, False, False, False]),
        (c.gender, ["m", " female", "x", None], ["Male", "Female", "Other", "Other"]),
        (c.insurance_category, ["Medicare Adv", "x medicaid", "ppo", "self", None], ["Medicare", "Medicaid", "Commercial", "Other", "Other"]),
        (c.insurance_category_at_load, ["medicare", "Medicare Adv", "my ppo plan", None], ["Medicare", "Other", "Commercial", "Other"]),
        (c.zip_prefix, ["9-4 105", "12", None], ["941", "12", None]),
        (c.valid_icd10, ["I50.9", "i50", " E11", None], [True, False, True, None]),
        (c.diagnosis_type, ["Admitting", "final", "any", None], ["Primary", "Discharge", "Secondary", "Secondary"]),
        (lambda x: c.keyword_flags(x)["has_chf"], ["Heart failure|x", "chf", "none", None], [True, True, False, None]),
        (c.feature_label, ["icu_flag", "new_made_up"], ["ICU admission", "New Made Up"]),
        (m.mask_ssn, ["123-45-6789", "12345", None], ["***-**-6789", "***-**-****", None]),
        (m.mask_phone, ["(555) 123-4567", "123", None], ["555-***-****", "***-***-****", None]),
        (m.mask_email, ["a.b@x-y.org", "none", None], ["@x-y.org", "[EMAIL REDACTED]", None]),
        (m.mask_address, ["1 Way", None], ["[ADDRESS REDACTED]", None]),
        (
            m.generalize_year,
            ["1980-02-29", "02/28/1981", "28-02-1982", "1983/2/1", "1981-02-30", "Feb 1980", None],
            ["1980", "1981", "1982", "1983", "UNKNOWN", "UNKNOWN", None],
        ),
        (
            m.scrub_text,
            ["id 123-45-6789 or 123456789, call (555) 123-4567", "Dr. Smith mail a@b.co MRN:1234567", "é123456789", None],
            [
                "id [SSN-REDACTED] or [SSN-REDACTED], call [PHONE-REDACTED]", "[NAME-REDACTED] mail [EMAIL-REDACTED] [MRN-REDACTED]",
                "é123456789", None,
            ],
        ),
    ],
)
def test_text_columns(column, fn, values, expected):
    assert column(fn, values) == expected


def test_linear_email_form_finds_the_same(column):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab1.-_%@ é"), 40)) for _ in range(400)] + ["x@b.co-y@c.org", "a" * 5000 + "@b.co", "a@b.comx@c.org"]
    plain = lambda t: re.sub(m.SCRUB_PATTERNS[3][0], "[EMAIL-REDACTED]", t)
    linear = column(lambda x: F.regexp_replace(x, "(?U)" + next(iter(m._LINEAR_FORMS.values())), "[EMAIL-REDACTED]"), texts)
    assert linear == [plain(t) for t in texts]


def test_age_groups(column):
    ages = [0, 17, 18, 30, 31, 60, 75, 76, None, -1]
    assert column(c.age_group, ages, "int") == ["18-30"] * 4 + ["31-45", "46-60", "61-75", "76+", "76+", "76+"]
    assert column(lambda x: c.age_group(x, 18), ages, "int")[:2] == ["76+", "76+"]


def test_dates(spark):
    row = spark.sql("SELECT date'2024-02-29' AS d, date'2024-03-02' AS e, CAST(NULL AS int) AS los").select(
        c.date_key("d"), c.iso_weekday("d"), c.is_weekend("e"), c.length_of_stay(F.col("los"), F.col("d"), F.col("e")), c.period_start(F.lit(2024), F.lit(2)).cast("string"),
    ).first()
    assert tuple(row) == (20240229, 4, True, 2, "2024-02-01")


def test_template_keeps_text_when_a_field_is_missing(spark):
    frame = spark.createDataFrame([(3, None)], "n int, t string")
    fields = {"n": F.col("n"), "t": F.col("t")}
    got = frame.select(c.fill_template(F.lit("a {n} {t}"), fields), c.fill_template(F.lit("a {n} {other}"), fields)).first()
    assert tuple(got) == ("a 3 None", "a {n} {other}")


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_pseudonyms_equal_hmac(column, key):
    names = ["Ann Lee", "Zoë", " pad ", "nan", "  ", "", None]
    token = lambda t: "ANON-" + hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:8].upper()
    expected = [token(n) for n in names[:3]] + ["ANON-UNKNOWN"] * 3 + [None]
    assert column(lambda x: m.pseudonymize(x, key), names) == expected


def test_tiers_and_scores(column, spark):
    assert column(s.risk_tier, [0.8, 0.79, 0.65, 0.35, 0.34, None, 1.5], "double") == ["critical", "high", "high", "medium", "low", "low", "critical"]
    assert column(s.comorbidity_tier, [0, 2, 4, 5, None], "int") == ["None", "Low", "Moderate", "High", "High"]
    assert column(s.age_points, [None, 45, 59, 60, 79], "int") == [0, 0, 0, 1, 2]
    assert [float(x) for x in column(s.ten_year_survival, [0, 5], "int")] == [0.983, round(0.983 ** math.exp(4.5), 4)]
    frame = spark.createDataFrame([(20, 3, True, 5, None)], "charlson_comorbidity_index int, prior_readmissions_1y int, high_utilizer_flag boolean, prior_admissions_12m int, icu_flag int")
    assert frame.select(s.heuristic_score()).first()[0] == 0.95


def test_top_contributions(spark):
    got = spark.range(1).select(s.top_contributions({"a": F.lit(0.1), "b": F.lit(-0.5), "c": F.lit(0.3), "d": F.lit(None)}, 2)).first()[0]
    assert list(got.items()) == [("b", -0.5), ("c", 0.3)]


def test_cohort_rules_with_nulls(spark):
    rows = [(6, 0, False, 0, 0, False), (None, None, True, 2, 0, None), (4, 0, False, 0, 0, False), (0, 2, None, 0, 0, False), (0, 0, None, 0, 2, False), (None, 0, None, None, 0, None)]
    frame = spark.createDataFrame(rows, "i int, r int, icu boolean, d90 int, m12 int, hu boolean").coalesce(1)
    got = [x[0][:2] for x in frame.select(s.risk_cohort("i", "r", "icu", "d90", "m12", "hu")).collect()]
    assert got == ["T1", "T1", "T2", "T2", "T3", "T4"]

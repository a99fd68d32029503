"""Risk scores, tiers, stars and factor lists as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col, feature_label

# Weights, bands, thresholds and labels.
COMORBIDITY_WEIGHTS = {"has_chf": 1, "has_copd": 1, "has_ckd": 2, "has_diabetes": 1, "has_afib": 1}
RISK_BANDS = [(0.80, "critical"), (0.65, "high"), (0.35, "medium")]
THREE_RISK_BANDS = [(0.65, "HIGH"), (0.35, "MEDIUM")]
HEURISTIC_WEIGHTS = {
    "charlson_comorbidity_index": 0.05,
    "prior_readmissions_1y": 0.12,
    "high_utilizer_flag": 0.10,
    "prior_admissions_12m": 0.04,
    "icu_flag": 0.08,
}
HEURISTIC_BASE, HEURISTIC_CAP = 0.10, 0.95
FACTOR_WEIGHTS = [
    ("prior_readmissions_1y", "Prior readmissions (1yr)", 0.12),
    ("charlson_comorbidity_index", "Charlson CCI", 0.05),
    ("high_utilizer_flag", "High utilizer", 0.10),
    ("prior_admissions_12m", "Prior admissions (12m)", 0.04),
    ("icu_flag", "ICU this admission", 0.08),
    ("comorbidity_count", "Comorbidity count", 0.03),
    ("length_of_stay_days", "Length of stay", 0.02),
]
FACTOR_THRESHOLDS = [
    ("prior_admissions_12m", "Prior admissions (12m)", 3),
    ("prior_readmissions_1y", "Prior readmissions (1yr)", 1),
    ("charlson_comorbidity_index", "Charlson CCI score", 3),
    ("length_of_stay_days", "Current LOS (days)", 7),
    ("icu_days", "ICU days", 2),
    ("comorbidity_count", "Comorbidity count", 4),
    ("high_utilizer_flag", "High utilizer", 1),
    ("days_since_last_discharge", "Days since last discharge", 30),
]
VITAL_RANGES = {
    "systolic_bp": (40, 300),
    "diastolic_bp": (20, 200),
    "heart_rate": (0, 400),
    "spo2_pct": (0, 100),
    "temperature_f": (85, 115),
}
ALERT_VITAL_RANGES = {"spo2_pct": (95, 100), "heart_rate": (60, 100)}
STAR_BANDS = [(-0.04, 5), (-0.01, 4), (0.01, 3), (0.04, 2)]
COHORT_RANKS = {"T1_CatastrophicRisk": 1, "T2_HighRisk": 2, "T3_ModerateRisk": 3}
SEVERITY_RANKS = {"critical": 0, "high": 1, "warning": 2}
STATUS_RANKS = {"fail": 0, "warn": 1}


def _number(c: Column | str) -> Column:
    """Booleans and numbers as double, NULL as 0."""
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def comorbidity_raw(weights: Mapping[str, int] = COMORBIDITY_WEIGHTS) -> Column:
    """Weighted sum of condition flags; NULL if any flag is NULL."""
    return reduce(lambda a, b: a + b, [col(flag).cast("int") * weight for flag, weight in weights.items()])


def age_points(age: Column | str, start: int = 50, step: int = 10) -> Column:
    """One point per full decade over ``start``."""
    years = F.coalesce(col(age), F.lit(0)) - start
    return F.greatest(F.lit(0), F.floor(years / step).cast("int"))


def comorbidity_tier(index: Column | str) -> Column:
    score = col(index)
    return (
        F.when(score == 0, "None")
        .when(score.between(1, 2), "Low")
        .when(score.between(3, 4), "Moderate")
        .otherwise("High")
    )


def ten_year_survival(index: Column | str) -> Column:
    return F.round(F.pow(F.lit(0.983), F.exp(col(index) * 0.9)).cast("decimal(20,10)"), 4)


def risk_tier(score: Column | str, bands: Sequence[tuple[float, str]] = RISK_BANDS, lowest: str = "low") -> Column:
    """Half-open bands from the top; anything else, NULL included, is the lowest tier."""
    value = col(score)
    chain = reduce(lambda acc, band: acc.when(value >= band[0], band[1]), bands, F)
    return chain.otherwise(lowest)


def heuristic_score(
    weights: Mapping[str, float] = HEURISTIC_WEIGHTS, base: float = HEURISTIC_BASE, cap: float = HEURISTIC_CAP
) -> Column:
    total = reduce(lambda a, b: a + b, [_number(c) * w for c, w in weights.items()]) + base
    return F.least(F.lit(cap), total)


def additive_score(
    index: Column | str, prior: Column | str, icu: Column | str, emergency: Column | str,
    high_utilizer: Column | str, stay: Column | str,
) -> Column:
    """The second additive score, without its random term, kept within 0.03 and 0.97."""
    total = (
        F.lit(0.10)
        + _number(index) * 0.038
        + _number(prior) * 0.11
        + _number(icu) * 0.12
        + _number(emergency) * 0.07
        + _number(high_utilizer) * 0.08
        + F.least(F.coalesce(col(stay).cast("double"), F.lit(3.0)), F.lit(14.0)) * 0.012
    )
    return F.round(F.greatest(F.lit(0.03), F.least(F.lit(0.97), total)).cast("decimal(20,10)"), 4)


def weighted_factors(
    factors: Sequence[tuple[str, str, float]] = FACTOR_WEIGHTS, keep: int = 6
) -> Column:
    """Non-zero factors with value and contribution, in list order, at most ``keep``."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(label).alias("display_label"),
                _number(name).alias("value"),
                F.round((_number(name) * weight).cast("decimal(20,8)"), 4).cast("double").alias("contribution"),
                F.lit("increases_risk").alias("direction"),
            )
            for name, label, weight in factors
        ]
    )
    return F.slice(F.filter(items, lambda x: x["value"] != 0), 1, keep)


def threshold_factors(factors: Sequence[tuple[str, str, float]] = FACTOR_THRESHOLDS) -> Column:
    """Factors whose value reaches its threshold."""
    items = F.array(
        *[
            F.when(
                _number(name) >= threshold,
                F.struct(
                    F.lit(name).alias("feature"),
                    _number(name).alias("value"),
                    F.lit("increases_risk").alias("direction"),
                    F.lit(label).alias("display_label"),
                ),
            )
            for name, label, threshold in factors
        ]
    )
    return F.filter(items, lambda x: x.isNotNull())


def top_contributions(contributions: Mapping[str, Column], k: int = 5) -> Column:
    """Map of the k largest contributions by absolute value, rounded to 4 places."""
    items = F.array(
        *[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in contributions.items()]
    )
    ordered = F.array_sort(
        F.filter(items, lambda x: x["value"].isNotNull()),
        lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
        .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
        .when(a["name"] < b["name"], -1)
        .when(a["name"] > b["name"], 1)
        .otherwise(0),
    )
    rounded = F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["name"], F.round(x["value"], 4)))
    return F.map_from_entries(rounded)


def labelled_features(features: Column | str, keep: int = 8) -> Column:
    """Feature map as an array of labelled structs with a direction, at most ``keep``."""
    entries = F.slice(F.map_entries(col(features)), 1, keep)
    return F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("feature"),
            feature_label(e["key"]).alias("display_label"),
            e["value"].alias("value"),
            F.when(e["value"] > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
        ),
    )


def outside(c: Column | str, low: float, high: float) -> Column:
    """True where the value lies outside the closed range; NULL on NULL."""
    return (col(c) < low) | (col(c) > high)


def range_flags(ranges: Mapping[str, tuple[float, float]] = VITAL_RANGES, suffix: str = "_out") -> dict[str, Column]:
    return {name + suffix: outside(name, low, high) for name, (low, high) in ranges.items()}


def star_rating(delta: Column | str, bands: Sequence[tuple[float, int]] = STAR_BANDS) -> Column:
    value = col(delta)
    chain = reduce(lambda acc, band: acc.when(value <= F.lit(str(band[0])).cast("decimal(10,4)"), band[1]), bands, F)
    return chain.otherwise(1)


def performance_label(delta: Column | str, margin: str = "0.02") -> Column:
    value, edge = col(delta), F.lit(margin).cast("decimal(10,4)")
    return F.when(value < -edge, "Outperforming").when(value > edge, "Underperforming").otherwise("On Target")


def risk_cohort(
    index: Column | str, prior_readmissions: Column | str, icu: Column | str, prior_90d: Column | str,
    prior_12m: Column | str, high_utilizer: Column | str,
) -> Column:
    """Ordered cohort rules; NULL inputs simply do not satisfy a rule."""
    index, prior_readmissions = col(index), col(prior_readmissions)
    return (
        F.when((index >= 6) | (prior_readmissions >= 3) | (col(icu) & (col(prior_90d) >= 2)), "T1_CatastrophicRisk")
        .when(index.between(3, 5) | (prior_readmissions == 2) | col(high_utilizer), "T2_HighRisk")
        .when(index.between(1, 2) | (col(prior_12m) >= 2), "T3_ModerateRisk")
        .otherwise("T4_LowRisk")
    )


def rank_of(c: Column | str, ranks: Mapping[str, int], otherwise: int) -> Column:
    """Sort rank of a label."""
    value = col(c)
    chain = reduce(lambda acc, item: acc.when(value == item[0], item[1]), ranks.items(), F)
    return chain.otherwise(otherwise)


def cohort_rank(c: Column | str) -> Column:
    return rank_of(c, COHORT_RANKS, 4)


def severity_rank(c: Column | str) -> Column:
    return rank_of(c, SEVERITY_RANKS, 3)


def status_rank(c: Column | str) -> Column:
    return rank_of(c, STATUS_RANKS, 2)

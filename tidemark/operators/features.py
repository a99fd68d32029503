"""Feature tables for scoring: one row per admission, numeric and complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cleaning as c
from tidemark.functions import scoring
from tidemark.operators.aggregates import count_by, measure_stats
from tidemark.operators.ranks import exact_quantiles
from tidemark.session import written

# Columns that never enter a model.
NON_FEATURES = ["readmitted_30_day", "admission_id", "patient_id", "admission_date", "discharge_date", "mrn"]
CONDITION_FLAGS = list(c.CONDITION_KEYWORDS)


def comorbidity_scores(patients: DataFrame) -> DataFrame:
    """Comorbidity index, tier and survival estimate per patient."""
    weights = scoring.COMORBIDITY_WEIGHTS
    raw = patients.select(
        "patient_id",
        "age",
        "comorbidity_count",
        *[(F.col(flag).cast("int") * weight).alias("cci_" + flag[4:]) for flag, weight in weights.items()],
        scoring.comorbidity_raw(weights).alias("charlson_raw"),
        scoring.age_points("age").alias("age_adjustment"),
    )
    total = F.col("charlson_raw") + F.col("age_adjustment")
    return raw.withColumns(
        {
            "charlson_comorbidity_index": total,
            "cci_risk_tier": scoring.comorbidity_tier(total),
            "estimated_10yr_survival": scoring.ten_year_survival(total),
        }
    )


def admission_features(
    admissions: DataFrame, patients: DataFrame, history: DataFrame, comorbidity: DataFrame
) -> DataFrame:
    """The joined, encoded feature row of every admission with its label.

    History comes first, by admission, so that the columns of a patient are joined last and never shuffled with the admissions.
    """
    history = history.drop("patient_id", "admission_date")
    index = comorbidity.select("patient_id", "charlson_comorbidity_index")
    people = patients.select("patient_id", "age", "age_group", "gender", "insurance_category", "comorbidity_count", *CONDITION_FLAGS)
    joined = admissions.join(history, "admission_id", "left").join(people.join(index, "patient_id", "left"), "patient_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    as_int = lambda name: F.col(name).cast("int").alias(name)
    return joined.select(
        "admission_id",
        "patient_id",
        "admission_date",
        "discharge_date",
        as_int("readmit_30day_flag"),
        zero("age"),
        c.encode("age_group", c.AGE_GROUP_CODES, 4).alias("age_group_encoded"),
        c.encode("gender", c.GENDER_CODES, 2).alias("gender_encoded"),
        c.encode("insurance_category", c.INSURANCE_CODES, 3).alias("insurance_encoded"),
        zero("comorbidity_count"),
        zero("charlson_comorbidity_index"),
        *[as_int(flag) for flag in CONDITION_FLAGS],
        zero("length_of_stay_days"),
        zero("icu_days"),
        as_int("icu_flag"),
        as_int("emergency_flag"),
        zero("total_charges"),
        c.encode("admission_type", c.ADMISSION_TYPE_CODES, 0).alias("admission_type_encoded"),
        c.iso_weekday("admission_date").alias("admit_day_of_week"),
        F.coalesce(c.is_weekend("admission_date"), F.lit(False)).cast("int").alias("admitted_on_weekend"),
        F.month("admission_date").alias("admit_month"),
        zero("prior_admissions_12m"),
        zero("prior_admissions_90d"),
        zero("prior_readmissions_1y"),
        zero("prior_icu_stays"),
        zero("prior_los_avg_days"),
        as_int("high_utilizer_flag"),
        F.coalesce(F.col("days_since_last_discharge"), F.lit(-1)).alias("days_since_last_discharge"),
    )


def category_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a category column. Each becomes a column of ``one_hot``, so they are as few as columns are."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Replace a category by 0/1 columns named ``column_value``, without the first value; NULL gets all zeros."""
    values = list(values) if values is not None else category_values(df, column)
    hot = {f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values[1:]}
    return df.withColumns(hot).drop(column) if hot else df.drop(column)


def fill_with_median(df: DataFrame, columns: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Replace NULLs by the exact median of their column; the medians of all columns come from one ordered pass."""
    tall = df.select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), F.col(name).cast("double").alias("_value")) for name in columns]))
    ).filter(F.col("_value").isNotNull())
    medians = exact_quantiles(tall, "_value", [0.5], ["_name"], pieces)
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("_name", F.col("quantiles")[0]))).alias("m"))
    with_map = df.withColumn("_medians", lookup.scalar())
    filled = {name: F.coalesce(F.col(name).cast("double"), F.try_element_at("_medians", F.lit(name))) for name in columns}
    return with_map.withColumns(filled).drop("_medians")


def feature_matrix(
    admissions: DataFrame, patients: DataFrame, vitals: DataFrame, diagnoses: DataFrame, history: DataFrame,
    vital_columns: Sequence[str], categories: Mapping[str, Sequence[str]], vital_score: str | None = None,
) -> DataFrame:
    """Model matrix: demographics, vital summaries, look-back counts, diagnosis counts, one-hot codes, median fill.

    The joined rows are written once to the shared folder, as the median fill reads them three times.
    """
    people = patients.select("patient_id", "age", "gender", "insurance_category", "comorbidity_count")
    joined = (
        admissions.join(people, "patient_id", "left")
        .join(measure_stats(vitals, ["admission_id"], vital_columns, vital_score), "admission_id", "left")
        .join(history.select("admission_id", "prior_admissions_90d", "prior_readmissions_1y"), "admission_id", "left")
        .join(count_by(diagnoses, "admission_id", "num_diagnoses"), "admission_id", "left")
    )
    for column, values in categories.items():
        joined = one_hot(joined, column, values)
    numeric = [
        f.name for f in joined.schema.fields
        if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    ]
    return fill_with_median(written(joined, "feature-matrix"), numeric)


def feature_columns(df: DataFrame, excluded: Sequence[str] = NON_FEATURES) -> list[str]:
    """Columns a model may see: everything but keys, dates and the label."""
    return [name for name in df.columns if name not in set(excluded)]


def split_by_time(df: DataFrame, date: str, first_holdout_day: str) -> tuple[DataFrame, DataFrame]:
    """Training rows before the day, holdout rows from it on."""
    day = F.lit(first_holdout_day).cast("date")
    return df.filter(F.col(date) < day), df.filter(F.col(date) >= day)

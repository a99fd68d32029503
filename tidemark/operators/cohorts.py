"""Clusters, projections and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col
from tidemark.operators.aggregates import exact, group_profile, mode_by
from tidemark.operators.neighbours import nearest_rows
from tidemark.operators.ranks import top_per_group

# Features, naming thresholds, defaults.
CLUSTER_FEATURES = [
    "age", "comorbidity_count", "charlson_comorbidity_index", "has_diabetes", "has_hypertension", "has_chf", "has_copd", "has_ckd",
    "has_afib", "has_obesity", "prior_admissions_12m", "prior_admissions_90d", "prior_readmissions_1y", "prior_icu_stays",
    "high_utilizer_flag", "length_of_stay_days", "emergency_flag", "avg_risk_score",
]
CONDITIONS = ["has_diabetes", "has_hypertension", "has_chf", "has_copd", "has_ckd", "has_afib", "has_obesity"]
HIGH_AGE, HIGH_INDEX, HIGH_USE, HIGH_RETURN = 70.0, 4.0, 2.0, 2.0
COMMON_SHARE = 0.3
SEED, RANGE = 42, (3, 10)
EXTRA_NEIGHBOURS = 20


def standardise(df: DataFrame, features: Sequence[str], out: str = "standardised") -> DataFrame:
    """Available features with NULL as 0, centred and divided by the population deviation, as one array column."""
    present = [f for f in features if f in df.columns]
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    stats = df.agg(
        F.struct(*[F.avg(value(f)).alias(f"m{i}") for i, f in enumerate(present)], *[F.stddev_pop(value(f)).alias(f"s{i}") for i, f in enumerate(present)]).alias("x")
    ).scalar()
    with_stats = df.withColumn("_stats", stats)
    unit = lambda i: F.when(F.col(f"_stats.s{i}") > 0, F.col(f"_stats.s{i}")).otherwise(1.0)
    parts = [(value(f) - F.col(f"_stats.m{i}")) / unit(i) for i, f in enumerate(present)]
    return with_stats.withColumn(out, F.array(*parts)).drop("_stats")


def project(df: DataFrame, vector: str, k: int = 2, out: str = "projected") -> DataFrame:
    """First ``k`` principal components of an array column; only a small covariance matrix leaves the tasks."""
    held = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(held)
    return model.transform(held).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def explained_share(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Share of variance of each component; free of the sign of the axes."""
    held = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    shares = PCA(k=k, inputCol="_v", outputCol="_p").fit(held).explainedVariance.toArray().tolist()
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(shares, start=1)], "component int, share double")


def fit_clusters(df: DataFrame, vector: str, k_range: tuple[int, int] = RANGE, seed: int = SEED) -> tuple[KMeansModel, DataFrame]:
    """K-means for every k of the range; the model with the best silhouette and the table of silhouettes.

    The vectors are held in executor memory and disk while the range is tried.
    """
    held = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster_id")
    best, scores = None, []
    try:
        for k in range(k_range[0], k_range[1] + 1):
            model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(held)
            scores.append((k, round(judge.evaluate(model.transform(held)), 4)))
            if best is None or scores[-1][1] > best[1]:
                best = (model, scores[-1][1])
    finally:
        held.unpersist()
    return best[0], df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def assign_clusters(model: KMeansModel, df: DataFrame, vector: str) -> DataFrame:
    held = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(held).drop("_v")


def cluster_name(
    age: Column, index: Column, prior: Column, returns: Column, rate: Column, conditions: Column, cluster_id: Column
) -> Column:
    """Ordered naming rules over cluster means, with a numbered fallback."""
    has = lambda c: F.coalesce(F.array_contains(conditions, c), F.lit(False))
    elderly, complex_, frequent = age >= HIGH_AGE, index >= HIGH_INDEX, prior >= HIGH_USE
    return (
        F.when(elderly & complex_ & frequent, "Complex Elderly MultiMorbid")
        .when(complex_ & has("Chf") & has("Ckd"), "Cardio-Renal Syndrome")
        .when(frequent & (returns >= HIGH_RETURN), "High-Utilization Chronic")
        .when(elderly & (index < 2) & (prior <= 1), "Elderly Low-Complexity")
        .when((age < 50) & (index <= 1) & (rate < 0.10), "Acute Single-Event Young")
        .when(has("Diabetes") & complex_, "Diabetic Multimorbid")
        .when(has("Copd") | has("Chf"), "Chronic Cardiopulmonary")
        .when(~elderly & complex_, "Mid-Age MultiMorbid")
        .otherwise(F.concat(F.lit("Mixed Cohort "), (cluster_id + 1).cast("string")))
    )


def cluster_profiles(df: DataFrame, cluster: str = "cluster_id", modes: Sequence[str] = ("insurance_category", "age_group"), conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Size, share, means, common conditions, dominant categories and name of each cluster."""
    measures = {
        "avg_age": ("age", 1), "avg_comorbidity_count": ("comorbidity_count", 2), "avg_cci": ("charlson_comorbidity_index", 2),
        "avg_risk_score": ("avg_risk_score", 4), "readmission_rate": ("readmit_30day_flag", 4), "avg_los_days": ("length_of_stay_days", 2),
        "high_utilizer_pct": ("high_utilizer_flag", 4),
    }
    present = {name: (col(c).cast("double"), places) for name, (c, places) in measures.items() if c in df.columns}
    profile = group_profile(df, [cluster], present)
    flags = [c for c in conditions if c in df.columns]
    mean = lambda c: F.avg(exact(F.col(c).cast("double"))) if c in df.columns else F.lit(0.0)
    extra = df.groupBy(cluster).agg(
        *[F.avg(exact(F.col(c).cast("int"))).alias(c) for c in flags], mean("age").alias("_age"), mean("charlson_comorbidity_index").alias("_index"),
        mean("prior_admissions_12m").alias("_prior"), mean("prior_readmissions_1y").alias("_returns"), mean("readmit_30day_flag").alias("_rate"),
    )
    shown = lambda c: " ".join(w.capitalize() for w in c.removeprefix("has_").split("_"))
    common = F.filter(
        F.array(*[F.struct((-F.col(c)).alias("order"), F.lit(i).alias("position"), F.lit(shown(c)).alias("name")) for i, c in enumerate(flags)]),
        lambda x: x["order"] <= -F.lit(COMMON_SHARE),
    )
    top = F.transform(F.slice(F.array_sort(common), 1, 3), lambda x: x["name"])
    named = extra.withColumn("top_comorbidities", top).select(
        cluster, "top_comorbidities",
        cluster_name(F.col("_age"), F.col("_index"), F.col("_prior"), F.col("_returns"), F.col("_rate"), F.col("top_comorbidities"), F.col(cluster)).alias("cluster_name"),
    )
    kept_modes = [m for m in modes if m in df.columns]
    found = profile.join(named, cluster)
    return found.join(mode_by(df, cluster, kept_modes), cluster) if kept_modes else found


def similar_entities(
    df: DataFrame, queries: DataFrame | Sequence, key: str, vector: str, n: int = 5, outcome: str | None = None, fields: Sequence[str] = (),
) -> DataFrame:
    """Nearest ``n`` other rows of each queried row, nearest first; ``queries`` are rows of (key, vector), or a few keys.

    With ``outcome`` the nearest ``n`` + 20 are fetched first and rows with a true outcome are then dropped.
    """
    asked = queries if isinstance(queries, DataFrame) else df.filter(F.col(key).isin(list(queries)))
    kept = list(dict.fromkeys([*fields, *([outcome] if outcome else [])]))
    pool = nearest_rows(df, asked, key, vector, n + (EXTRA_NEIGHBOURS if outcome else 0)).drop("position")
    pool = pool.withColumnsRenamed({"id": key, "distance": "similarity_distance"}).join(df.select(key, *kept), key).select("query_id", key, *kept, "similarity_distance")
    if outcome:
        pool = pool.filter(~F.coalesce(F.col(outcome).cast("boolean"), F.lit(False)))
        pool = top_per_group(pool, ["query_id"], [F.asc("similarity_distance"), F.asc(key)], n).drop("position")
    return pool.withColumns(
        {"similarity_distance": F.round("similarity_distance", 4), "similarity": F.round(1 / (1 + F.round("similarity_distance", 4)), 3)}
    )


def neighbour_cohort(neighbours: DataFrame, cohort: str, profiles: DataFrame | None = None, rate: str = "avg_risk_score") -> DataFrame:
    """Most common cohort among each query's neighbours (smallest name on ties), with that cohort's mean risk."""
    found = neighbours.groupBy("query_id").agg(F.mode(F.col(cohort), True).alias("cohort_name"))
    if profiles is None:
        return found
    rates = profiles.select(F.col(cohort).alias("cohort_name"), F.col(rate).alias("cohort_avg_risk")).dropDuplicates(["cohort_name"])
    return found.join(rates, "cohort_name", "left").withColumn("cohort_avg_risk", F.coalesce("cohort_avg_risk", F.lit(0.5)))

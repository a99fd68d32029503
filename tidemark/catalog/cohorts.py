"""Cluster and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.scoring import FEATURE_TABLES, some_features
from tidemark.operators import cohorts as c
from tidemark.operators.layout import spectral_layout
from tidemark.session import written


def embeddings(spark, sf):
    return v.table(spark, sf, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))


@query("cl01_standardised_features", """SELECT o_orderkey, round((coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END, 0) - (SELECT avg(coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END, 0)) FROM orders)) / (SELECT stddev_pop(coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END, 0)) FROM orders), 6) AS z_price,
 round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders), 6) AS z_customer FROM orders""")
def standardised(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    found = c.standardise(orders, ["price", "o_custkey", "absent"])
    return found.select("o_orderkey", F.round(F.col("standardised")[0], 6).alias("z_price"), F.round(F.col("standardised")[1], 6).alias("z_customer"))


@query("cl02_projection")
def projection(spark, sf):
    found = c.project(embeddings(spark, sf), "vector", 2)
    return found.select("vec_id", F.col("projected")[0].alias("x"), F.col("projected")[1].alias("y"))


@query("cl02_projection_invariants", "SELECT count(*) AS n, TRUE AS is_uncorrelated, TRUE AS is_ordered FROM embeddings")
def projection_invariants(spark, sf):
    """Both axes of a projection are uncorrelated, and the first spreads the rows most."""
    found = projection(spark, sf)
    return found.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.corr("x", "y")) < 1e-6).alias("is_uncorrelated"), (F.var_pop("x") >= F.var_pop("y")).alias("is_ordered")
    )


@query("cl02_neighbour_layout")
def neighbour_layout(spark, sf):
    return spectral_layout(embeddings(spark, sf), "vec_id", "vector")


@query("cl02_explained_variance")
def explained(spark, sf):
    return c.explained_share(embeddings(spark, sf), "vector", 2)


@query("cl03_best_k_clusters")
def best_k(spark, sf):
    model, scores = c.fit_clusters(embeddings(spark, sf), "vector", (3, 10))
    sizes = c.assign_clusters(model, embeddings(spark, sf), "vector").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    best = scores.agg(F.max("silhouette").alias("s")).scalar()
    return sizes.withColumn("best_silhouette", best)


PROFILE_ROWS = "pr AS (SELECT features.*, CAST(age_group_encoded AS BIGINT) AS cluster_id, insurance_category, age_group FROM features JOIN (SELECT patient_id, insurance_category, age_group FROM stg_patients) USING (patient_id))"


def profile_rows(spark, sf):
    """The columns that profiles read; written once by their users, as a profile reads them several times."""
    found = some_features(
        spark, sf, "patient_id", "age_group_encoded", "age", "comorbidity_count", "charlson_comorbidity_index", *c.CONDITIONS, "prior_admissions_12m",
        "prior_readmissions_1y", "readmit_30day_flag", "length_of_stay_days", "high_utilizer_flag",
    )
    return found.withColumnRenamed("age_group_encoded", "cluster_id")


@query("cl04_cluster_profiles", v.with_tables(*FEATURE_TABLES, PROFILE_ROWS, """m AS (SELECT cluster_id, count(*) AS size, """ + v.half_up("count(*)", "(SELECT count(*) FROM pr)", 4) + f""" AS size_pct,
 {v.mean_sql('age', 1)} AS avg_age, {v.mean_sql('comorbidity_count', 2)} AS avg_comorbidity_count, {v.mean_sql('charlson_comorbidity_index', 2)} AS avg_cci, {v.mean_sql('readmit_30day_flag', 4)} AS readmission_rate, {v.mean_sql('length_of_stay_days', 2)} AS avg_los_days,
 {v.mean_sql('high_utilizer_flag', 4)} AS high_utilizer_pct, mode(insurance_category) AS dominant_insurance_category, mode(age_group) AS dominant_age_group,
 array_to_string(list_transform(list_sort(list_filter([struct_pack(o := -avg(has_diabetes), p := 0, n := 'Diabetes'), struct_pack(o := -avg(has_hypertension), p := 1, n := 'Hypertension'), struct_pack(o := -avg(has_chf), p := 2, n := 'Chf'), struct_pack(o := -avg(has_copd), p := 3, n := 'Copd')], lambda x: x.o <= -0.3))[1:3], lambda x: x.n), ',') AS top_comorbidities FROM pr GROUP BY 1)""", "SELECT * FROM m"))
def cluster_profiles(spark, sf):
    payer = v.patients(spark, sf).select("patient_id", "insurance_category", "age_group")
    rows = profile_rows(spark, sf).join(payer, "patient_id").drop("patient_id")
    found = c.cluster_profiles(written(rows, "profile-rows")).drop("cluster_name")
    return found.withColumn("top_comorbidities", F.array_join("top_comorbidities", ","))


@query("cl05_cluster_names", v.with_tables(*FEATURE_TABLES, PROFILE_ROWS, """m AS (SELECT cluster_id, avg(age) AS a, avg(charlson_comorbidity_index) AS c, avg(prior_admissions_12m) AS p, avg(prior_readmissions_1y) AS q, avg(readmit_30day_flag) AS r, avg(has_diabetes) AS d, avg(has_chf) AS f, avg(has_copd) AS o, avg(has_ckd) AS k FROM pr GROUP BY 1)""",
"""SELECT cluster_id, CASE WHEN a >= 70 AND c >= 4 AND p >= 2 THEN 'Complex Elderly MultiMorbid' WHEN c >= 4 AND f >= 0.3 AND k >= 0.3 THEN 'Cardio-Renal Syndrome' WHEN p >= 2 AND q >= 2 THEN 'High-Utilization Chronic' WHEN a >= 70 AND c < 2 AND p <= 1 THEN 'Elderly Low-Complexity'
 WHEN a < 50 AND c <= 1 AND r < 0.10 THEN 'Acute Single-Event Young' WHEN d >= 0.3 AND c >= 4 THEN 'Diabetic Multimorbid' WHEN o >= 0.3 OR f >= 0.3 THEN 'Chronic Cardiopulmonary' WHEN a < 70 AND c >= 4 THEN 'Mid-Age MultiMorbid' ELSE 'Mixed Cohort ' || CAST(cluster_id + 1 AS VARCHAR) END AS cluster_name FROM m"""))
def cluster_names(spark, sf):
    rows = written(profile_rows(spark, sf).drop("patient_id"), "profile-rows")
    return c.cluster_profiles(rows).select("cluster_id", "cluster_name")


DISTANCES = """d AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS dist
 FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"""


@query("cl06_nearest_neighbours", v.with_tables(DISTANCES, "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rn FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rk FROM r WHERE rn <= 25 AND label <> 1)",
       "SELECT query_id, vec_id, label = 1 AS readmitted, round(dist, 4) AS similarity_distance, round(1 / (1 + round(dist, 4)), 3) AS similarity FROM f WHERE rk <= 5"))
def neighbours(spark, sf):
    rows = embeddings(spark, sf).withColumn("readmitted", F.col("label") == 1)
    return c.similar_entities(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "vector", 5, "readmitted")


@query("cl07_cohort_of_neighbours", v.with_tables(DISTANCES, "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rn FROM d), k AS (SELECT query_id, label, count(*) AS n FROM r WHERE rn <= 9 GROUP BY 1, 2)",
       "SELECT query_id, 'group ' || CAST(label AS VARCHAR) AS cohort_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM k) WHERE r = 1"))
def neighbour_cohort(spark, sf):
    rows = embeddings(spark, sf).withColumn("cohort", F.concat(F.lit("group "), F.col("label").cast("string")))
    return c.neighbour_cohort(c.similar_entities(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "vector", 9, fields=["cohort"]), "cohort")

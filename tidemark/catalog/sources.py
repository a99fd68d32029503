"""Source and sink queries: write below the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.events import AUDIT_SQL, access_log
from tidemark.catalog.quality import DAMAGED_SQL, ZERO, gate_rules, rules_sql
from tidemark.catalog.rules import BASKET_SQL, itemset_sql, rules, rules_sql as mined_sql
from tidemark.operators import checks as q
from tidemark.operators import cohorts as c
from tidemark.operators import events as e
from tidemark.plans import star
from tidemark.session import shared_folder
from tidemark.sources import files
from tidemark.sources.literals import DIAGNOSES, PROCEDURES, benchmark_rates, diagnoses, procedures


@query("io01_raw_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def raw_csv(spark, sf):
    path = shared_folder(spark, "csv")
    files.write_csv(v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return files.read_raw_csv(spark, path, ["c_custkey", "c_name", "c_nationkey"])


@query("io02_staging_load", "SELECT c_custkey, c_name, '2024-01-15 00:00:00.000000' AS loaded_at FROM customer")
def staging_load(spark, sf):
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_name")
    return files.load_staging(rows, shared_folder(spark, "staging"), F.lit(v.AS_OF).cast("timestamp_ntz"))


@query("io03_append", "SELECT o_orderkey, o_totalprice FROM orders")
def append(spark, sf):
    path = shared_folder(spark, "append")
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in ("F", "O", "P"):
        files.append_rows(orders.filter(F.col("o_orderstatus") == status), path)
    return spark.read.schema(orders.schema).parquet(path).drop("o_orderstatus")


@query("io04_parametrised_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def parametrised_sql(spark, sf):
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least"
    return files.read_sql(spark, text, {"status": "F", "least": 300000}, orders=v.table(spark, sf, "orders"))


@query("io05_feature_snapshot", "SELECT o_orderkey, o_totalprice FROM orders")
def feature_snapshot(spark, sf):
    root = shared_folder(spark, "features")
    files.write_snapshot(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), root, "v1")
    return files.read_snapshot(spark, root, "v1")


@query("io06_stored_rules", v.with_tables(BASKET_SQL, itemset_sql(0.002, 4), mined_sql(0.05, 1.0), """SELECT '["' || array_to_string(antecedents, '","') || '"]' AS antecedent_items, CASE WHEN len(consequents) = 1 THEN consequents[1] ELSE '[''' || array_to_string(consequents, ''', ''') || ''']' END AS consequent_item,
 round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(least(conviction, 999.99), 6) AS conviction, evidence_count, 'diagnosis_association' AS rule_type FROM rules"""))
def stored_rules(spark, sf):
    return files.write_rules(rules(spark, sf), shared_folder(spark, "rules")).drop("rule_id")


@query("io07_cluster_assignments")
def assignments(spark, sf):
    rows = v.table(spark, sf, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    model, _ = c.fit_clusters(rows, "vector", (3, 10))
    placed = c.project(c.assign_clusters(model, rows, "vector"), "vector").withColumns({"x": F.col("projected")[0], "y": F.col("projected")[1]})
    return files.write_assignments(placed, shared_folder(spark, "clusters"), "vec_id", ["cluster_id", "x", "y"])


@query("io08_ranked_csv", v.with_tables(v.SCORES, "SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, risk_tier, printf('%.1f', CAST(risk_score * 100 AS DOUBLE)) AS risk_score_pct FROM scores WHERE risk_score * 100 >= 70"))
def ranked_csv(spark, sf):
    path = shared_folder(spark, "ranked")
    rows = v.scores(spark, sf).filter(F.col("risk_score") * 100 >= 70)
    files.write_csv(files.ranked_list(rows, "risk_score", ["prediction_id", "risk_tier"]), path)
    return files.read_raw_csv(spark, path, ["prediction_id", "risk_tier", "risk_score_pct"])


@query("io09_audit_csv", v.with_tables(AUDIT_SQL, "SELECT CAST(event_id AS VARCHAR) AS audit_id, path FROM lg WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 10000"))
def audit_csv(spark, sf):
    path = shared_folder(spark, "audit")
    found = e.audit_query(access_log(spark, sf), event_type="view", limit=10000).select("audit_id", "path")
    files.write_csv(found, path)
    return files.read_raw_csv(spark, path, ["audit_id", "path"])


@query("io10_json_report", rules_sql("orders", DAMAGED_SQL, [
    ("null_o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", ZERO), ("null_o_orderpriority", "count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority = '')", ZERO),
    ("range_o_totalprice", "count(*) FILTER (WHERE o_totalprice < 0)", ZERO), ("null_share_o_custkey", "avg(CAST(o_custkey IS NULL AS INTEGER))", "CASE WHEN x > 0.5 THEN 'FAIL' WHEN x > 0.05 THEN 'WARN' ELSE 'PASS' END")]))
def json_report(spark, sf):
    path = shared_folder(spark, "report")
    results = gate_rules(spark, sf)
    files.write_report(results, q.summarise(results), path)
    return spark.read.schema(results.schema).json(f"{path}/results")


@query("io11_inline_values", "SELECT n_name, CAST(rate AS DOUBLE) AS benchmark_readmission_rate, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (VALUES ('NATION_1', 0.1), ('NATION_2', 0.2), ('NATION_3', 0.3)) AS t(name, rate) ON name = n_name GROUP BY 1, 2")
def inline_values(spark, sf):
    rates = benchmark_rates(spark, [(f"NATION_{i}", f"0.{i}") for i in (1, 2, 3)])
    customers = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = customers.join(rates, F.col("n_name") == F.col("department_name"))
    return joined.groupBy("n_name", "benchmark_readmission_rate").agg(F.count(F.lit(1)).alias("n"))


@query("io12_date_spine", "SELECT strftime(d, '%Y-%m-%d') AS full_date FROM (SELECT unnest(generate_series((SELECT min(l_shipdate) FROM lineitem), (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY)) AS d)")
def spine(spark, sf):
    return star.spine_between(v.table(spark, sf, "lineitem"), "l_shipdate")


@query("io13_table_sample", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def table_sample(spark, sf):
    return files.sample_rows({"orders": v.table(spark, sf, "orders")}, "orders", order=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


def _values_sql(rows: list[tuple]) -> str:
    text = lambda x: str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(map(text, row))})" for i, row in enumerate(rows))


@query("io11_code_lookups", f"""SELECT category, procedure_category, count(*) AS n, count(*) FILTER (WHERE chronic AND surgical) AS chronic_and_surgical, CAST(sum(tier) AS BIGINT) AS complexity FROM lineitem
 JOIN (VALUES {_values_sql(DIAGNOSES)}) AS d(i, code, name, category, chronic, risky) ON i = l_partkey % {len(DIAGNOSES)} JOIN (VALUES {_values_sql(PROCEDURES)}) AS p(j, code, name, procedure_category, tier, surgical, diagnostic) ON j = l_suppkey % {len(PROCEDURES)} GROUP BY 1, 2""")
def code_lookups(spark, sf):
    """Items by diagnosis and procedure category, codes dealt to parts and suppliers in turn."""
    codes = lambda rows, at, code: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (F.col(at) % len(rows) + 1).cast("int")).alias(code)
    items = v.table(spark, sf, "lineitem").select(codes(DIAGNOSES, "l_partkey", "icd10_code"), codes(PROCEDURES, "l_suppkey", "cpt_code"))
    joined = items.join(diagnoses(spark), "icd10_code").join(procedures(spark), "cpt_code")
    return joined.groupBy("category", "procedure_category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("chronic_flag") & F.col("is_surgical")).alias("chronic_and_surgical"), F.sum("complexity_tier").alias("complexity")
    )


@query("io07_assignment_invariants", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS misplaced, TRUE AS within_range FROM embeddings")
def assignment_invariants(spark, sf):
    """Every row is in the cluster of its nearest centre, and their number is one of the range."""
    rows = v.table(spark, sf, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    model, _ = c.fit_clusters(rows, "vector", (3, 10))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in centre]) for centre in model.clusterCenters()])
    squares = F.transform(centres, lambda m: F.aggregate(F.zip_with("vector", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    placed = c.assign_clusters(model, rows, "vector").withColumn("_own", F.element_at(squares, F.col("cluster_id") + 1))
    further = F.col("_own") > F.array_min(squares) + 1e-9
    return placed.agg(F.count(F.lit(1)).alias("n"), F.count_if(further).alias("misplaced"), F.countDistinct("cluster_id").between(3, 10).alias("within_range"))

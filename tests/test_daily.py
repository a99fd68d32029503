import os

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import star, views
from tidemark.plans.daily import quality_rules, run_daily
from tidemark.plans.star import surrogate_key
from tidemark.sources.literals import benchmark_rates, departments

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def clean_extracts(spark):
    patients, admissions = views.raw_patients(spark, SF), views.raw_admissions(spark, SF)
    ends = F.when(F.col("discharge_date") == "", F.col("admission_date")).otherwise(F.col("discharge_date"))
    stays = F.when(F.trim("los_days").try_cast("int") > 365, "365").otherwise(F.col("los_days"))
    admissions = admissions.withColumn("los_days", stays)
    return {"patients": patients.withColumn("full_name", F.col("mrn")).drop("loaded_at"), "admissions": admissions.withColumn("discharge_date", ends).drop("loaded_at")}


def run(spark, raw, root, day="2024-01-15"):
    dimension = departments(spark).withColumn("department_key", surrogate_key("department_code"))
    return run_daily(raw, root, b"key", F.lit(day).cast("date"), benchmark_rates(spark), dimension, min_rows={"patients": 100, "admissions": 500})


def test_daily_run_and_rerun(spark, tmp_path):
    raw = clean_extracts(spark)
    tables = run(spark, raw, f"{tmp_path}/a")
    n, p = raw["admissions"].count(), raw["patients"].count()
    assert tables["features"].count() == tables["predictions"].count() == tables["fact_admissions"].count() == n
    assert tables["dim_patient"].count() == tables["risk_cohorts"].join(tables["dim_patient"], "patient_id", "right").count() == p
    assert tables["dashboard"].agg(F.sum("total_admissions")).first()[0] == n
    assert spark.read.parquet(f"{tmp_path}/a/staging/patients").filter(~F.col("full_name").startswith("ANON-")).count() == 0
    again = run(spark, raw, f"{tmp_path}/a")
    assert again["dim_patient"].count() == p and again["fact_admissions"].count() == again["features"].count() == n


def test_two_days_in_one_root(spark, tmp_path):
    raw = clean_extracts(spark)
    half = F.col("admission_id").cast("bigint") % 2
    first = run(spark, {**raw, "admissions": raw["admissions"].filter(half == 0)}, f"{tmp_path}/a", "2024-01-14")
    brought = {r.admission_id for r in first["fact_admissions"].select("admission_id").collect()}
    second = run(spark, {**raw, "admissions": raw["admissions"].filter(half == 1)}, f"{tmp_path}/a")
    whole = run(spark, raw, f"{tmp_path}/b")
    kept = [r.admission_id for r in second["fact_admissions"].select("admission_id").collect()]
    assert brought < set(kept) and len(kept) == len(set(kept)) == raw["admissions"].count()
    for name in ("features", "department_performance", "dashboard", "risk_cohorts", "stay_by_category_and_payer", "high_risk"):
        rows = [sorted(map(str, t[name].collect())) for t in (second, whole)]
        assert rows[0] == rows[1], name
    orphans = second["fact_admissions"].join(second["dim_patient"], "patient_key", "left_anti").count()
    assert orphans == 0


def test_gate_stops_before_marts(spark, tmp_path):
    raw = clean_extracts(spark)
    with pytest.raises(ValueError, match="patients.source"):
        run(spark, {**raw, "patients": raw["patients"].limit(5)}, f"{tmp_path}/a")
    lost = raw["patients"].filter("CAST(patient_id AS int) > 20")
    with pytest.raises(ValueError, match="orphan_patient_id"):
        run(spark, {**raw, "patients": lost}, f"{tmp_path}/b")
    assert not os.path.exists(f"{tmp_path}/b/dashboard")


def test_two_days_of_orders_whose_even_numbers_have_more_outcomes(spark, tmp_path, monkeypatch):
    """Even orders that have an outcome flag are positive in six of ten cases, all orders in three of ten: the gate must not see the former."""
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'REGION_0' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'NATION_0' AS n_name, 0 AS n_regionkey",
        "customer": "SELECT id AS c_custkey, 0 AS c_nationkey, 1000D + id AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(20)",
        "lineitem": "SELECT id AS l_orderkey, 5D AS l_quantity FROM range(400)",
        "orders": """SELECT id AS o_orderkey, id % 20 AS o_custkey, CASE WHEN id % 20 < 12 THEN 'F' ELSE 'O' END AS o_orderstatus, 100D AS o_totalprice,
         TIMESTAMP '1998-01-01 00:00:00' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(400) UNION ALL SELECT NULL, 1, 'O', 1D, TIMESTAMP '1998-01-01 00:00:00', NULL""",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    brought, found = [], []

    def gated(raw, *_, **__):
        brought.extend(int(r[0]) for r in raw["admissions"].select("admission_id").collect())
        found.extend(r.check_status for r in quality_rules(raw["patients"], raw["admissions"]).collect())

    monkeypatch.setattr(star, "run_daily", gated)
    star.two_days(spark, str(tmp_path))
    assert sorted(brought) == list(range(400)) and "FAIL" not in found

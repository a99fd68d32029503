import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, features, joins, lineage
from tidemark.operators.masking import mask_audit, mask_table
from tidemark.plans import marts, star
from tidemark.plans.staging import stage_diagnoses
from tidemark.sources import files, literals
from tidemark.sources.versions import Tables


def day(text):
    return F.lit(text).cast("date")


def test_dimension_history_through_three_loads(spark):
    load = lambda rows: spark.createDataFrame(rows, "patient_id string, plan string, age int")
    first = star.apply_history(None, load([("a", "x", 1), ("b", "y", None)]), "patient_id", ["plan", "age"], day("2024-01-01"))
    second = star.apply_history(first, load([("a", "z", 1), ("c", "w", 2)]), "patient_id", ["plan", "age"], day("2024-02-01"))
    third = star.apply_history(second, load([("a", "z", 1), ("b", "y", None)]), "patient_id", ["plan", "age"], day("2024-03-01"))
    got = sorted((r["patient_id"], r["plan"], str(r["effective_date"]), str(r["expiry_date"]), r["is_current"]) for r in third.collect())
    assert got == [
        ("a", "x", "2024-01-01", "2024-02-01", False), ("a", "z", "2024-02-01", "9999-12-31", True),
        ("b", "y", "2024-01-01", "9999-12-31", True), ("c", "w", "2024-02-01", "9999-12-31", True),
    ]
    assert third.select("patient_key").distinct().count() == 4


def test_date_dimension(spark):
    days = star.date_spine(spark, "2023-12-31", "2024-10-01")
    rows = {str(r["full_date"]): r for r in star.date_dimension(days).collect()}
    assert len(rows) == 276
    new_year, leap, autumn = rows["2024-01-01"], rows["2024-02-29"], rows["2024-10-01"]
    assert (new_year["week_of_year"], new_year["day_name"], new_year["fiscal_quarter"], new_year["season"]) == (1, "Monday", 2, "Winter")
    assert rows["2023-12-31"]["week_of_year"] == 52 and rows["2023-12-31"]["is_weekend"]
    assert leap["date_key"] == 20240229 and (autumn["fiscal_quarter"], autumn["fiscal_year"], autumn["season"]) == (1, 2025, "Fall")
    assert star.spine_between(days.limit(0), "full_date").count() == 0


@pytest.mark.parametrize("lateness, expected", [(0, ["1:old", "2:new", "4:new"]), (5, ["1:old", "2:new", "3:new", "4:new"])])
def test_incremental_merge(spark, lateness, expected):
    existing = spark.createDataFrame([(1, "2024-01-01", "old"), (2, "2024-01-10", "old")], "k int, d string, v string").withColumn("d", F.to_date("d"))
    incoming = spark.createDataFrame([(2, "2024-01-11", "new"), (3, "2024-01-08", "new"), (4, "2024-01-12", "new")], "k int, d string, v string").withColumn("d", F.to_date("d"))
    got = star.incremental_merge(existing, incoming, "k", "d", lateness).collect()
    assert sorted(f"{r['k']}:{r['v']}" for r in got) == expected
    assert star.incremental_merge(existing.limit(0), incoming, "k", "d").count() == 3


def test_facts_look_up_keys_and_skip_known(spark):
    adm = spark.createDataFrame(
        [("1", "p", "Cardiology", "home", 5.0), ("2", "p", None, "x", 1.0), ("3", "q", "Cardiology", None, 1.0), ("1", "p", "Cardiology", "home", 5.0)],
        "admission_id string, patient_id string, department string, discharge_disposition string, total_charges double",
    )
    people = star.apply_history(None, spark.createDataFrame([("p", 1)], "patient_id string, age int"), "patient_id", ["age"], day("2024-01-01"))
    departments = literals.departments(spark).withColumn("department_key", star.surrogate_key("department_code"))
    dispositions = literals.dispositions(spark).withColumn("disposition_key", F.col("disposition_code"))
    facts = star.admission_facts(adm, people, departments, dispositions=dispositions)
    got = {r["admission_id"]: (r["department_key"] is not None, r["disposition_key"]) for r in facts.collect()}
    assert got == {"1": (True, "01"), "2": (False, None)}
    again = star.admission_facts(adm, people, departments, dispositions=dispositions, existing=facts.filter("admission_id = '1'"))
    assert [r["admission_id"] for r in again.collect()] == ["2"]


def test_bridge_and_vitals_are_unique(spark):
    facts = spark.createDataFrame([("1", 10, 7, "2024-01-01")], "admission_id string, admission_key long, patient_key long, admission_date string").withColumn("admission_date", F.to_date("admission_date"))
    codes = spark.createDataFrame([("I10", 1), ("E11", 2)], "icd10_code string, diagnosis_key int")
    child = spark.createDataFrame([("1", "I10"), ("1", "I10"), ("1", "E11"), ("1", "zz"), ("2", "I10")], "admission_id string, icd10_code string")
    assert star.bridge(child, facts, codes, "icd10_code", "diagnosis_key").count() == 2
    vitals = spark.createDataFrame([("v", "1", "2024-01-01 12:30:00", " 80 "), ("v", "1", "2024-01-01 12:30:00", "80"), ("w", "1", "2024-01-02 00:00:00", "")], "vital_id string, admission_id string, recorded_at string, heart_rate string")
    found = star.vital_facts(vitals.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz")), facts, ["heart_rate"])
    assert sorted((r["vital_id"], r["heart_rate"], r["hours_since_admit"]) for r in found.collect()) == [("v", 80.0, 12.5), ("w", None, 24.0)]


def test_department_performance_counts_rows_not_months(spark):
    rows = [("A", "2024-01-05", True), ("A", "2024-01-09", False), ("A", "2024-03-01", True), ("A", "2024-04-01", False), (None, "2024-01-01", False)]
    adm = spark.createDataFrame(rows, "department string, admission_date string, readmit_30day_flag boolean").withColumns({
        "admission_date": F.to_date("admission_date"), "length_of_stay_days": F.lit(2), "total_charges": F.lit(1).cast("decimal(18,2)"), "icu_days": F.lit(None).cast("int"), "emergency_flag": F.lit(None).cast("boolean"),
    })
    got = {(r["department_name"], r["month"]): r for r in marts.department_performance(adm, literals.benchmark_rates(spark, [("A", "0.49")])).collect()}
    april = got[("A", 4)]
    assert [float(x) for x in (april["rolling_3m_avg"], april["prior_month_readmission_rate"], april["mom_readmission_delta"])] == [0.5, 1.0, -1.0]
    assert (got[("A", 1)]["cms_star_rating"], got[("A", 1)]["performance_label"], got[("A", 1)]["emergency_rate"]) == (3, "On Target", None)
    unknown = got[("Unknown", 1)]
    assert (float(unknown["benchmark_readmission_rate"]), unknown["cms_star_rating"], unknown["performance_label"]) == (0.15, 5, "Outperforming")


def test_staged_diagnoses(spark):
    raw = spark.createDataFrame([("1", "a", " i50.9 ", "x", "admitting", "1"), ("2", "a", "zz", None, None, "?"), ("", "a", "I10", None, None, None), ("3", None, "I10", None, None, None)],
                                "diagnosis_id string, admission_id string, icd10_code string, description string, diagnosis_type string, sequence string").withColumn("loaded_at", F.lit(0))
    reference = spark.createDataFrame([("I50.9", "Cardiovascular", "d", True, True)], "icd10_code string, category string, icd10_description string, chronic_flag boolean, high_readmission_risk_flag boolean")
    got = {r["diagnosis_id"]: (r["icd10_code"], r["diagnosis_category"], r["diagnosis_type"], r["sequence_number"], r["valid_icd10_format"]) for r in stage_diagnoses(raw, reference).collect()}
    assert got == {"1": ("I50.9", "Cardiovascular", "Primary", 1, False), "2": ("ZZ", None, "Secondary", None, False)}


def test_rules_on_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, None, -1.0), (None, "b", None)], "k int, c string, v double")
    rules = [checks.unique("k"), checks.in_domain("c", ["a"]), checks.in_domain("c", ["a"], null_is_bad=False), checks.in_range("v", 0), checks.null_rate("v", 0.5), checks.key_present("k")]
    assert [r["value"] for r in checks.run_rules(df, "t", rules).collect()] == [1, 2, 1, 1, pytest.approx(1 / 3), 1]
    assert {r["check_status"] for r in checks.run_rules(df.limit(0), "t", rules).collect()} == {"PASS"}
    with pytest.raises(ValueError, match="t.unique_k"):
        checks.gate(checks.run_rules(df, "t", rules))
    samples = checks.domain_samples(df, {"c": ["a"]}).collect()
    assert [r["bad_value"] for r in samples] == [None, "b"]


def test_monitors(spark):
    rows = [(f"2024-01-{d:02d}", "a" if i else "b", None if d == 10 and i == 0 else 1) for d in range(1, 11) for i in range(4 if d < 10 else 40)]
    df = spark.createDataFrame(rows, "d string, c string, n int").withColumn("d", F.to_date("d"))
    assert checks.row_count_anomaly(df, "t", "d", "2024-01-10").first()["status"] == "ok"
    wobble = df.unionByName(df.filter("d = date'2024-01-02'"))
    assert checks.row_count_anomaly(wobble, "t", "d", "2024-01-10").first()["status"] == "critical"
    assert checks.row_count_anomaly(df, "t", "d", "2024-01-03").first()["status"] == "skip"
    assert checks.null_rate_change(df, "t", "d", "2024-01-10", [], ["n"]).first()["status"] == "ok"
    assert checks.null_rate_change(df, "t", "d", "2024-01-10", ["n"], []).first()["status"] == "critical"
    assert checks.category_drift(df, "t", "c", "d", "2024-01-10").first()["status"] == "critical"
    assert checks.category_drift(df, "t", "c", "d", "2024-02-10").count() == 0
    report = checks.run_monitor({"t": checks.Monitored(df, "d", ["n"], [], ["c"]), "u": checks.Monitored(df, "absent")}, "2024-01-10")
    assert {r["table_name"]: r["status"] for r in report.collect() if r["check_name"] == "table_error"} == {"u": "critical"}


@pytest.mark.parametrize("x, k, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (15.086272, 5, 0.01), (23.209251, 10, 0.01), (2000.0, 2000, 0.4957948), (2106.2, 2000, 0.0484), (0.0, 3, 1.0)])
def test_chi_square_tail(spark, x, k, p):
    got = spark.createDataFrame([(x, k)], "x double, k int").select(checks.chi_square_tail("x", "k")).first()[0]
    assert got == pytest.approx(p, rel=1e-5 if k < 100 else 2e-2)


def test_freshness(spark):
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    runs = spark.createDataFrame([("success", "2024-01-01 07:00:00"), ("failed", "2024-01-01 11:00:00")], "status string, ended_at string").withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz"))
    assert tuple(checks.freshness(runs, as_of).select("hours_since_last_run", "freshness_sla_met").first()) == (5.0, True)
    assert tuple(checks.freshness(runs.filter("status = 'none'"), as_of).select("hours_since_last_run", "freshness_sla_met").first()) == (999.0, False)


def test_masked_table(spark):
    df = spark.createDataFrame([("Ann", "x@y.zz", None), (None, "bad", "1")], "full_name string, email string, other string")
    masked = mask_table(df, {"full_name": "pseudonymize", "email": "mask_email", "absent": "mask_ssn"}, b"k").collect()
    assert masked[0]["email"] == "@y.zz" and masked[1]["full_name"] is None and masked[1]["other"] == "1"
    assert [r["masked"] for r in mask_audit(df, "t", {"full_name": "pseudonymize", "email": "mask_email"}).collect()] == [1, 2]
    with pytest.raises(ValueError, match="Unknown masking strategy"):
        mask_table(df, {"email": "rot13"}, b"k")


def test_median_fill_and_one_hot(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 4.0, None), (4, 7.0, "c")], "i int, v double, g string")
    filled = {r["i"]: r["v"] for r in features.fill_with_median(df, ["v"], 4).collect()}
    assert filled == {1: 1.0, 2: 4.0, 3: 4.0, 4: 7.0}
    hot = {r["i"]: (r["g_b"], r["g_c"]) for r in features.one_hot(df, "g").collect()}
    assert hot == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    assert features.feature_columns(df.withColumn("patient_id", F.lit(1))) == ["i", "v", "g"]
    many = spark.range(1500).select(F.format_string("v%04d", "id").alias("c"))
    assert len(features.category_values(many, "c")) == 1500


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1,), (1,)], "j int")
    assert [r["v"] for r in joins.orphans(a, b, "k", "j").collect()] == ["y"]
    counts = joins.align_counts(a.select("v"), a.filter("k = 1").select("v").unionByName(spark.createDataFrame([(None,)], "v string")), "v")
    assert {r["v"]: (r["baseline_count"], r["current_count"]) for r in counts.collect()} == {"x": (1, 1), "y": (1, 0), None: (0, 1)}
    newest = joins.union_newest({1: a.withColumn("t", F.lit(1)), 0: a.filter("k = 1").withColumns({"v": F.lit("live"), "t": F.lit(0)})}, "k", "t")
    assert sorted((str(r["k"]), r["v"]) for r in newest.collect()) == [("1", "live"), ("None", "y")]


def test_lineage(spark):
    edges = spark.createDataFrame([("raw", "stg"), ("stg", "fact"), ("raw", "fact"), ("fact", "view")], "source string, target string")
    got = {(r["ancestor"], r["descendant"]): r["hops"] for r in lineage.lineage_paths(edges).collect()}
    assert got == {("raw", "stg"): 1, ("stg", "fact"): 1, ("raw", "fact"): 1, ("fact", "view"): 1, ("stg", "view"): 2, ("raw", "view"): 2}
    nodes = {r["node"]: (r["upstream"], r["downstream"], r["row_count"]) for r in lineage.lineage_nodes(edges, {"fact": edges}).collect()}
    assert nodes["fact"] == (2, 1, 4) and nodes["raw"] == (0, 2, None)
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(60)], "source string, target string")
    found = lineage.lineage_paths(chain).collect()
    assert len(found) == 60 * 61 // 2 and max(r["hops"] for r in found) == 60
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert {(r["ancestor"], r["descendant"], r["hops"]) for r in lineage.lineage_paths(cycle).collect()} == {
        (x, y, 1 + (ord(y) - ord(x) - 1) % 3) for x in "abc" for y in "abc"
    }


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", ok'), ("2", None)], "a string, b string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.read_raw_csv(spark, f"{tmp_path}/csv", ["a", "b"]).collect())) == sorted(map(tuple, df.collect()))
    ranked = files.ranked_list(spark.createDataFrame([("p", 0.12345), ("q", 0.9)], "patient_id string, s double"), "s", ["patient_id"])
    assert list(map(tuple, ranked.collect())) == [("q", "90.0"), ("p", "12.3")]
    with pytest.raises(ValueError, match="not found"):
        files.sample_rows({"t": df}, "u")
    star.refresh({"x": df}, Tables(spark, str(tmp_path)))
    assert Tables(spark, str(tmp_path)).read("x").count() == 2

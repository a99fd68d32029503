import inspect
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import cohorts as cohorts_catalog
from tidemark.catalog import modelling, scoring, views
from tidemark.operators import baskets as b
from tidemark.operators import boosting, cohorts, evaluate, events, explain, model
from tidemark.operators import recommend as r
from tidemark.session import shared_folder, written
from tidemark.sources.action_library import ACTION_LIBRARY, read_library
from tidemark.sources.versions import Tables
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(1)
    return [sorted({f"i{x}" for x in rng.choice(6, rng.integers(1, 5), p=[0.35, 0.25, 0.15, 0.1, 0.1, 0.05])}) for _ in range(200)]


def brute_itemsets(sets, support, longest):
    found = {}
    for size in range(1, longest + 1):
        for combo in combinations(sorted({i for s in sets for i in s}), size):
            n = sum(set(combo) <= set(s) for s in sets)
            if n >= np.ceil(support * len(sets)):
                found[combo] = n
    return found


def test_rules_equal_all_subsets(spark, sets):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, items array<string>")
    counts = brute_itemsets(sets, 0.03, 3)
    itemsets = b.frequent_itemsets(frame, 0.03, 3)
    assert {tuple(x["items"]): x["freq"] for x in itemsets.collect()} == counts
    want = {}
    for items, n in counts.items():
        for size in range(1, len(items)):
            for left in combinations(items, size):
                right = tuple(i for i in items if i not in left)
                confidence, base = n / counts[left], counts[right] / len(sets)
                if confidence >= 0.3 and confidence / base >= 1.1:
                    want[left, right] = (confidence, confidence / base, float("inf") if confidence == 1 else (1 - base) / (1 - confidence), n)
    got = {(tuple(x["antecedents"]), tuple(x["consequents"])): (x["confidence"], x["lift"], x["conviction"], x["evidence_count"]) for x in b.association_rules(itemsets, 0.3, 1.1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_success_only_baskets_are_degenerate(spark):
    out = spark.createDataFrame([("1", False), ("2", True), ("3", False)], "admission_id string, readmit_30day_flag boolean")
    dx = spark.createDataFrame([("1", "A"), ("1", "A"), ("2", "A"), ("9", "A")], "admission_id string, icd10_code string")
    px = spark.createDataFrame([("1", "P")], "admission_id string, cpt_code string")
    every = {x["admission_id"]: x["items"] for x in b.tagged_baskets(out, dx, px).collect()}
    assert every == {"1": ["CPT:P", "DX:A", "NO_READMIT"], "2": ["DX:A"], "3": ["NO_READMIT"]}
    good = b.tagged_baskets(out, dx, px, successes_only=True)
    assert [x["admission_id"] for x in good.collect()] == ["1"]
    rules = b.outcome_rules(b.frequent_itemsets(good, 0.1, 5))
    assert {(x["confidence"], x["lift"]) for x in rules.collect()} == {(1.0, 1.0)}
    assert {x["conviction"] for x in b.rules_for_storage(rules).collect()} == {999.99}


def test_rule_matching(spark):
    rules = spark.createDataFrame(
        [(1, ["DX:A", "CPT:P"], 0.8, 1.5, 10), (2, ["DX:A", "DX:B", "CPT:Q"], 0.9, 1.5, 10), (3, ["DX:B"], 0.5, 1.2, 4), (4, ["DX:A", "CPT:P"], 0.7, 1.1, 3), (5, ["DX:A", "DX:C", "DX:D"], 0.9, 9.0, 99)],
        "rule_id long, antecedents array<string>, confidence double, lift double, evidence_count long",
    ).withColumn("rule_type", F.lit(b.EFFECTIVENESS))
    people = spark.createDataFrame([("x", ["DX:A"]), ("y", ["DX:B", "DX:A"]), ("z", ["DX:A", "DX:A"]), ("w", ["DX:Z"])], "id string, items array<string>")
    got = {}
    for row in r.match_rules(people, rules, "id", n=5).collect():
        got.setdefault(row["id"], []).append((row["rank"], row["rule_id"], row["action"][:33]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "x": [(1, 1, "Apply intervention bundle: CPT:P")], "z": [(1, 1, "Apply intervention bundle: CPT:P")],
        "y": [(1, 2, "Apply intervention bundle: CPT:Q"), (2, 1, "Apply intervention bundle: CPT:P"), (3, 3, "Continue current care protocols")],
    }
    assert r.match_rules(people, rules, "id", n=1).count() == 3
    mined = r.mined_candidates(r.match_rules(people, rules, "id"), "id")
    assert mined.filter("id = 'y'").count() == 3


def applicable(features, codes):
    """The stated semantics, one row at a time."""
    found = []
    for name, rule in ACTION_LIBRARY.items():
        triggers, listed = rule["triggers"], rule["icd10_trigger"]
        hit = not triggers and not listed or any(c in listed for c in codes)
        if triggers:
            ok = []
            for f, v in triggers.items():
                if f.endswith("__gte"):
                    ok.append((features.get(f[:-5]) or 0) >= v)
                else:
                    a = features.get(f)
                    ok.append(a == v or (isinstance(v, bool) and bool(a) == v))
            hit = hit or all(ok)
        if hit:
            found.append((-rule["reduces_readmission_by_pct"] * r.GRADE_WEIGHTS[rule["evidence_grade"]], name))
    return [n for _, n in sorted(found, key=lambda x: x[0])]


def test_library_equals_row_by_row(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        flag = lambda: None if rng.random() < 0.1 else int(rng.integers(0, 2))
        rows.append((i, flag(), flag(), flag(), flag(), flag(), flag(), bool(rng.integers(0, 2)), int(rng.integers(0, 6)), int(rng.integers(0, 5)), int(rng.integers(0, 4)), int(rng.integers(40, 95)), int(rng.integers(0, 12)), int(rng.integers(0, 5)), str(rng.choice(["Medicaid", "Other"])), [str(x) for x in rng.choice(["I21.9", "A41.9", "Z"], 1)]))
    names = ["id", "has_chf", "has_copd", "has_ckd", "has_diabetes", "has_afib", "icu_flag", "high_utilizer_flag", "charlson_comorbidity_index", "prior_admissions_12m", "prior_readmissions_1y", "age", "length_of_stay_days", "icu_days", "insurance_category", "codes"]
    kinds = "id int, has_chf int, has_copd int, has_ckd int, has_diabetes int, has_afib int, icu_flag int, high_utilizer_flag boolean, charlson_comorbidity_index int, prior_admissions_12m int, prior_readmissions_1y int, age int, length_of_stay_days int, icu_days int, insurance_category string, codes array<string>"
    df = spark.createDataFrame(rows, kinds)
    got = {}
    for x in r.library_candidates(df, ACTION_LIBRARY, "id", "codes", 30).collect():
        got.setdefault(x["id"], []).append((-x["score"], x["_order"], x["key"], x["rationale"]))
    for row in rows:
        features = dict(zip(names, row))
        assert [k for _, _, k, _ in sorted(got.get(row[0], []))] == applicable(features, row[-1])
        for _, _, key, text in got.get(row[0], []):
            template = ACTION_LIBRARY[key]["rationale_template"]
            try:
                assert text == template.format(**features)
            except KeyError:
                assert text == template


def test_plan_caps(spark):
    rows = [("p", f"k{i}", f"action {i % 9}", f"c{i % 3}", "A", 10 + i, "before_discharge", 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, key string, action string, category string, evidence_grade string, reduces_readmission_by_pct int, time_sensitivity string, score double").withColumns(
        {c: F.lit("") for c in ("rationale", "source", "responsible_role", "evidence_source")} | {"_stream": F.lit(0), "_order": F.lit(0)}
    )
    plan = sorted(r.ranked_plan(df, "id", 2, 5).collect(), key=lambda x: x["priority"])
    assert [x["priority"] for x in plan] == [1, 2, 3, 4, 5] and len({x["action"] for x in plan}) == 5
    assert max(pd.Series([x["category"] for x in plan]).value_counts()) <= 2
    assert plan[0]["key"] == "k19" and plan[0]["composite_score"] == 3 * 29 + 6
    assert len(r.nested_plans(r.ranked_plan(df, "id"), "id").first()["recommendations"]) == 9


def test_library_file(spark, tmp_path):
    path = tmp_path / "library.json"
    path.write_text('{"chf_home_health": {"action": "x", "category": "y"}, "extra": {"action": "z", "category": "y"}}')
    merged = r.merge_library(ACTION_LIBRARY, read_library(spark, str(path)))
    assert len(merged) == len(ACTION_LIBRARY) + 1 and merged["chf_home_health"]["action"] == "x"


def test_clusters_and_neighbours(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 0.2, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5))])
    df = spark.createDataFrame([(i, p.tolist(), i % 4 == 0, f"g{i // 40}") for i, p in enumerate(points)], "id int, v array<double>, bad boolean, g string")
    fitted, silhouettes = cohorts.fit_clusters(df, "v", (2, 4))
    assert silhouettes.orderBy(F.desc("silhouette")).first()["k"] == 3
    assert {x["count"] for x in cohorts.assign_clusters(fitted, df, "v").groupBy("cluster_id").count().collect()} == {40}
    centred = points - points.mean(0)
    share = np.linalg.svd(centred, compute_uv=False) ** 2
    assert [x["share"] for x in cohorts.explained_share(df, "v", 2).orderBy("component").collect()] == pytest.approx((share / share.sum())[:2].tolist())
    near = cohorts.similar_entities(df, [5, 50], "id", "v", 4, "bad", ["g"])
    for q in (5, 50):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        pool = [i for i in np.argsort(d, kind="stable") if i != q][:24]
        want = [int(i) for i in pool if i % 4][:4]
        got = near.filter(F.col("query_id") == q).orderBy("similarity_distance").collect()
        assert [x["id"] for x in got] == want and got[0]["similarity_distance"] == round(d[want[0]], 4)
    assert {(x["query_id"], x["cohort_name"]) for x in cohorts.neighbour_cohort(near, "g").collect()} == {(5, "g0"), (50, "g1")}
    many = cohorts.similar_entities(df.filter("id < 30"), [*range(30), *range(1000, 1300)], "id", "v", 2)
    assert many.groupBy("query_id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (2, 2, 30)


def test_standardised_constant_column(spark):
    df = spark.createDataFrame([(1.0, 7), (3.0, 7), (None, 7)], "a double, b int").coalesce(1)
    got = np.array([x[0] for x in cohorts.standardise(df, ["a", "b"]).select("standardised").collect()])
    a = np.array([1.0, 3.0, 0.0])
    np.testing.assert_allclose(got[:, 0], (a - a.mean()) / a.std())
    np.testing.assert_allclose(got[:, 1], 0)


def test_training_and_scoring(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "y": y}))
    folds = model.cross_validate(df, ["a", "b"], "y", "id", folds=2, trees=3, depth=2, pieces=1).collect()
    assert sum(f["n_samples"] for f in folds) == 600 and all(f["roc_auc"] > 0.9 for f in folds)
    scored = model.score_batch(model.train(df, ["a", "b"], "y", "linear"), df, ["a", "b"], "id", 1).collect()
    assert all(list(s["top_features"]) in (["a"], ["b"]) for s in scored)
    assert {s["risk_tier"] for s in scored} <= {"HIGH", "MEDIUM", "LOW"} and len(scored) == 600
    assert evaluate.promotion_gate(spark.createDataFrame([(0.9, 0.3), (0.7, None)], "roc_auc double, psi double")).select("promoted").collect() == [(False,), (False,)]


def test_alert_rules(spark):
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    scores = spark.createDataFrame([(1, "p", "2024-01-01 23:00:00", 0.4), (2, "p", "2024-01-02 03:00:00", 0.7), (3, "p", "2024-01-02 12:00:00", 0.99), (4, "q", "2024-01-02 12:00:00", 0.99)],
                                   "prediction_id int, patient_id string, predicted_at string, risk_score double").withColumn("predicted_at", ts("predicted_at"))
    spikes = events.score_spike_alerts(scores).collect()
    assert [s["description"] for s in spikes] == ["p risk increased from 40% to 70% in last 6h"]
    vitals = spark.createDataFrame([("p", "2024-01-01 00:00:00", 88.0, 142.0), ("q", "2024-01-01 00:00:00", None, 80.0)], "patient_id string, recorded_at string, spo2_pct double, heart_rate double").withColumn("recorded_at", ts("recorded_at"))
    found = events.raise_alerts([events.vital_alerts(vitals), events.score_spike_alerts(scores)])
    assert sorted(x["alert_type"] for x in found.collect()) == ["risk_score_spike", "vital_anomaly", "vital_anomaly"]
    assert found.select("alert_id").distinct().count() == 3
    assert events.unread_counts(found).first().asDict() == {"critical": 0, "high": 3, "warning": 0, "info": 0, "total": 3}
    changed, n = events.acknowledge(found, F.col("alert_type") == "vital_anomaly", "dr", "ok", F.lit("2024-01-03").cast("timestamp_ntz"))
    assert n.first()["affected"] == 2 and events.open_alerts(changed).count() == 1


def test_streams_over_several_batches(spark):
    folder = shared_folder(spark, "test-scores")
    rows = spark.createDataFrame([(1, "p", "2024-01-01 00:00:00", 0.2), (2, "p", "2024-01-01 02:00:00", 0.5), (3, "p", "2024-01-01 09:00:00", 0.9), (4, "q", "2024-01-01 02:00:00", 0.9), (5, "z", "2024-01-09 00:00:00", 0.1)],
                                 "n int, patient_id string, predicted_at string, risk_score double").withColumn("predicted_at", F.col("predicted_at").cast("timestamp_ntz"))
    for n in (1, 2, 3, 4, 5):
        rows.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.read_stream(spark, folder, rows, files_per_batch=1)
    found = streams.run_to_end(streams.score_spike_stream(stream), "test-spikes").collect()
    assert [(x["entity"], x["previous"], x["score"]) for x in found] == [("p", 0.2, 0.5)]


def test_late_scores_give_no_false_spikes(spark):
    """A row four days older than the known score isn't compared with it; a row after both is compared with the newer one."""
    folder = shared_folder(spark, "test-late")
    data = [(1, "p", "2024-01-10 00:00:00", 0.2), (2, "p", "2024-01-06 00:00:00", 0.9), (3, "p", "2024-01-09 23:00:00", 0.8), (3, "p", "2024-01-10 01:00:00", 0.5), (4, "p", "2024-01-20 00:00:00", 0.1), (5, "p", "2024-01-20 01:00:00", 0.9), (6, "z", "2024-01-29 00:00:00", 0.1)]
    rows = spark.createDataFrame(data, "n int, patient_id string, predicted_at string, risk_score double").withColumn("predicted_at", F.col("predicted_at").cast("timestamp_ntz"))
    for n in (1, 2, 3, 4, 5, 6):
        rows.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.read_stream(spark, folder, rows, files_per_batch=1)
    found = streams.run_to_end(streams.score_spike_stream(stream), "test-late").collect()
    assert [(x["previous"], x["score"]) for x in sorted(found, key=lambda x: x["at"])] == [(0.2, 0.5), (0.1, 0.9)]


def test_folds_hold_equal_shares_of_each_class(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 97 == 0).cast("double").alias("y"))
    folds = model.with_folds(rows, "id", "y", 5)
    counts = {(r["y"], r["fold"]): r["n"] for r in folds.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0.0, 1.0):
        sizes = [counts[y, fold] for fold in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = model.with_folds(rows.repartition(7), "id", "y", 5)
    assert folds.exceptAll(again).count() == 0 and folds.columns == ["id", "y", "fold"]


def test_incremental_features_over_batches(spark, tmp_path):
    rows = lambda data: spark.createDataFrame(data, "k int, d string, v string").withColumn("d", F.to_date("d"))
    batches = [
        rows([(1, "2024-01-05", "a"), (2, "2024-02-10", "a")]),
        rows([(3, "2024-02-20", "b"), (2, "2024-02-12", "b"), (4, "2024-01-01", "late")]),
        rows([(1, "2024-02-19", "moved"), (5, "2024-02-16", "kept"), (6, "2024-02-10", "late")]),
    ]
    merge = streams.append_features(str(tmp_path), "k", "d", 5)
    for n, batch in enumerate(batches):
        merge(batch, n)
    read = lambda: sorted((r["k"], str(r["d"]), r["v"]) for r in Tables(spark, str(tmp_path)).read("rows").collect())
    want = [(1, "2024-02-19", "moved"), (2, "2024-02-12", "b"), (3, "2024-02-20", "b"), (5, "2024-02-16", "kept")]
    assert read() == want
    merge(batches[2], 2)
    assert read() == want


def test_training_query_has_the_settings_of_the_operator(spark, monkeypatch):
    called, signature = [], inspect.signature(model.cross_validate)
    monkeypatch.setattr(modelling, "features", lambda *_: spark.createDataFrame([], ", ".join(f"{c} double" for c in ["admission_id", "readmit_30day_flag", *modelling.MODEL_FEATURES])))
    monkeypatch.setattr(modelling.m, "cross_validate", lambda *args, **named: called.append(signature.bind(*args, **named)))
    monkeypatch.setattr(modelling.v, "stored", lambda _spark, _sf, _name, build: build())
    modelling.fold_metrics(spark, "")
    called[0].apply_defaults()
    assert called[0].arguments["folds"] == 5 and not called[0].arguments.get("settings")
    assert (model.TREES, model.DEPTH) == (300, 6)


def test_rule_ids_are_unique(spark, sets):
    baskets = spark.createDataFrame(list(enumerate(sets)), "id int, items array<string>")
    found = b.association_rules(b.frequent_itemsets(baskets, 0.01, 4), 0.0, 0.0)
    assert found.count() == found.select("rule_id").distinct().count() > 0


@pytest.fixture(scope="module")
def few_orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("few"))
    tables = {
        "nation": ("n_nationkey int, n_name string", [(1, "X")]),
        "customer": ("c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int", [(k, 900.0 * k, "BUILDING", 1) for k in range(1, 9)]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice double, o_orderstatus string",
            [(k, k % 8 + 1, date(2024, 1, 1) + timedelta(k), "1-URGENT", 10.0 * k, "FO"[k % 2]) for k in range(1, 41)] + [(7, 8, date(2024, 1, 8), "1-URGENT", 70.0, "O")],
        ),
        "lineitem": ("l_orderkey long, l_quantity double", [(k, float(k % 9)) for k in range(1, 41)]),
    }
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("run", [scoring.additive, cohorts_catalog.cluster_profiles, cohorts_catalog.cluster_names])
def test_scores_and_profiles_store_no_wide_table(spark, few_orders, monkeypatch, run):
    stored, names = views.stored, []
    monkeypatch.setattr(views, "stored", lambda s, sf, name, build: names.append(name) or stored(s, sf, name, build))
    assert run(spark, few_orders).count()
    assert not {"admissions", "history", "features"} & set(names)


def test_some_features_are_those_of_the_table(spark, few_orders):
    names = ["admission_id", "patient_id", "age", "has_chf", "length_of_stay_days", "emergency_flag", "prior_readmissions_1y", "high_utilizer_flag"]
    whole, some = scoring.features(spark, few_orders).select(*names), scoring.some_features(spark, few_orders, *names)
    assert sorted(map(str, whole.collect())) == sorted(map(str, some.collect()))
    assert whole.filter("admission_id = '7'").count() == 4  # a repeated admission meets each of its histories


def test_boosted_folds_share_the_jobs_of_a_level(spark):
    """Learns what no single split shows, holds folds apart, gives the same again, and runs one job a level for all folds."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(900), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    tracker, counted = spark.sparkContext.statusTracker(), {}
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"boosted-{trees}", "folds")
        folds = model.cross_validate(rows, ["a", "b", "c"], "y", "id", folds=3, trees=trees, depth=3, pieces=1).collect()
        counted[trees] = len(tracker.getJobIdsForGroup(f"boosted-{trees}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(f["n_samples"] for f in folds) == [300, 300, 300] and all(f["roc_auc"] > 0.95 for f in folds)
    assert counted[12] - counted[2] <= 10 * 3
    again = model.cross_validate(rows.repartition(5), ["a", "b", "c"], "y", "id", folds=3, trees=12, depth=3, pieces=1).collect()
    assert sorted(folds) == sorted(again)


def test_few_rows_are_fitted_by_one_job(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > x[:, 1]).astype(float)}))
    tracker, counted = spark.sparkContext.statusTracker(), {}
    for trees in (2, 8):
        spark.sparkContext.setJobGroup(f"few-{trees}", "trees")
        assert len(model.train_forest(rows, ["a", "b"], "y", trees=trees, depth=3).trees) == trees
        counted[trees] = len(tracker.getJobIdsForGroup(f"few-{trees}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted[8] == counted[2]


def test_many_rows_are_added_up_for_one_child_of_a_split(spark, monkeypatch):
    """Only the lighter child of a split is added up, and the trees are those of sums over all nodes."""
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(6000, 3)), 1)
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (x[:, 0] * x[:, 1] + rng.normal(size=6000) > 0.8).astype(float), "fold": np.arange(6000) % 2})
    rows, names = written(spark.createDataFrame(frame), "many"), ["a", "b", "c"]
    monkeypatch.setattr(boosting, "ROWS_A_PARTITION", 2000)
    monkeypatch.setattr(boosting, "BLOCK", (500, 600))
    asked, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda grown, level, t, nodes, *rest: asked.append((level, t, nodes)) or sums(grown, level, t, nodes, *rest))
    found = boosting.fit(rows, names, "y", "fold", [0, 1], trees=4, depth=3, rate=0.5, row_share=0.8, column_share=1.0, seed=3)
    assert len(asked) == 12
    for level, t, nodes in asked:
        for forest, some in zip(found, nodes):
            above = forest[t]["feature"][2 ** (level - 1) - 1 : 2**level - 1] if level else np.zeros(1)
            assert len(some) == (above >= 0).sum()
    points = boosting.split_points(rows, names)
    blocks = boosting._blocks(rows, names, "y", "fold", points, 2, 3, 500).collect()
    assert len(blocks) >= 3 and sum(len(block[2]) for block in blocks) == 6000
    ratios = [(part["y"] == 0).sum() / part["y"].sum() for part in (frame[frame["fold"] != out] for out in (0, 1))]
    want = boosting._fit_alone(blocks, points, (4, 3, 0.5, 3, 3), ([0, 1], ratios, 0.8, 3))
    for forest, expected in zip(found, want):
        for tree, other in zip(forest, expected):
            assert (tree["feature"] == other["feature"]).all() and (tree["bin"] == other["bin"]).all()
            assert np.allclose(tree["value"], other["value"], atol=1e-5) and np.allclose(tree["cover"], other["cover"], rtol=1e-5)


def test_first_boosted_tree_is_the_best_split():
    sums = np.zeros((1, 2, boosting.BINS, 2))
    sums[0, 0, :3] = [(4.0, 4.0), (4.0, -4.0), (2.0, -2.0)]  # weight and weight times residual of feature 0's bins
    sums[0, 1, :2] = [(5.0, -1.0), (5.0, -1.0)]
    tree = {"feature": np.full(3, -1), "bin": np.zeros(3, int), "value": np.zeros(3), "cover": np.zeros(3)}
    boosting._split(tree, sums, 0, np.ones((1, 2), bool), [np.array([1.0, 2.0]), np.array([0.5])])
    assert (tree["feature"][0], tree["bin"][0]) == (0, 0) and tree["value"].tolist() == [-0.2, 1.0, -1.0] and tree["cover"].tolist() == [10.0, 4.0, 6.0]
    bins = np.array([[0, 1, 2], [0, 0, 1]], np.uint8)
    assert boosting.reached(tree | {"threshold": np.zeros(3)}, bins, np.arange(3), 1).tolist() == [1, 2, 2]


def test_forest_scores_and_contributions(spark):
    """One job a tree level; the parts of a row are those of its leaves one by one, and add up to the log odds that the trees give."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(500, 4)), 1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.5).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3], "y": np.where(np.arange(500) % 50, y, np.nan)}))
    rows = rows.withColumn("y", F.nanvl("y", F.lit(None)))
    names, tracker, counted = ["a", "b", "c", "d"], spark.sparkContext.statusTracker(), {}
    for trees in (2, 9):
        spark.sparkContext.setJobGroup(f"forest-{trees}", "trees")
        fitted = model.train_forest(rows, names, "y", trees=trees, depth=4)
        counted[trees] = len(tracker.getJobIdsForGroup(f"forest-{trees}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted[9] - counted[2] <= 7 * 4
    nodes = fitted.nodes()
    leaves = [leaf for tree in nodes for leaf in explain._leaves(tree)]
    points = explain.split_points(nodes, 4)
    lookups = explain.lookups_of(nodes, points)
    assert sum(len(lookup.sums) for lookup in lookups) <= len(leaves) / 2
    found = explain.odds_and_parts(x, lookups, points)
    want = np.zeros((500, 4))
    for leaf in leaves:
        known = sum(((x[:, f] > low) & (x[:, f] <= high)).astype(int) << j for j, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)))
        want[:, leaf.features] += explain.gains(np.array([leaf.value]), np.array([leaf.z]))[0][known]
    assert np.allclose(found[:, 1:], want, atol=1e-9)
    assert np.allclose(found[:, 0], 2 * boosting.margins_of(x, fitted.trees)) and np.allclose(found.sum(axis=1) - found[:, 0] + explain.base_value(leaves), found[:, 0])
    scored = model.score_batch(fitted, rows, names, "id", 2).collect()
    chance = 1 / (1 + np.exp(-found[:, 0]))
    assert len(scored) == 500 and all(abs(s["risk_score"] - chance[s["id"]]) <= 5.1e-5 for s in scored)
    assert all(set(s["top_features"]) == {names[f] for f in np.argsort(-np.abs(found[s["id"], 1:]))[:2]} for s in scored)
    with pytest.raises(ValueError):
        model.train_forest(rows.limit(0), names, "y")


def test_batch_scores_fit_by_tree_levels(spark, few_orders, monkeypatch):
    monkeypatch.setattr(model, "train", None)  # Spark's learner takes several jobs a level
    monkeypatch.setattr(model, "TREES", 3)
    assert modelling.batch_scores(spark, few_orders).count() == scoring.features(spark, few_orders).count()

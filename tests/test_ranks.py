import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, evaluate, filters, ranks
from tidemark.operators.history import lookback_history


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "a", "b"], n, p=[0.8, 0.15, 0.05]), "s": np.round(rng.beta(2, 3, n), 2), "y": rng.integers(0, 2, n),
        "x": np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(0, 2, n)),
    })
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("pieces", [1, 2, 16])
def test_running_totals_by_key(scores, pieces):
    pdf, df = scores
    got = ranks.running_totals(df, "s", {"n": F.lit(1), "p": F.col("y")}, ["g"], pieces).toPandas()
    want = pdf.groupby(["g", "s"]).agg(n=("y", "size"), p=("y", "sum")).reset_index().sort_values(["g", "s"])
    want["n_upto"], want["p_upto"] = want.groupby("g")["n"].cumsum(), want.groupby("g")["p"].cumsum()
    pd.testing.assert_frame_equal(got.sort_values(["g", "s"]).reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("pieces", [1, 8])
def test_quantiles_are_exact(scores, pieces):
    pdf, df = scores
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = ranks.exact_quantiles(df, "x", shares, ["g"], pieces).collect()
    for row in got:
        np.testing.assert_allclose(row["quantiles"], np.quantile(pdf[pdf.g == row["g"]].x, shares), rtol=1e-12)
    whole = ranks.exact_quantiles(df, "x", shares, pieces=pieces).first()
    np.testing.assert_allclose(whole["quantiles"], np.quantile(pdf.x, shares), rtol=1e-12)
    assert whole["n"] == len(pdf)


def test_quantiles_with_many_keys(spark):
    pdf = pd.DataFrame({"g": np.arange(6000) % 1500, "x": np.random.default_rng(3).normal(size=6000)})
    got = {r["g"]: r["quantiles"][0] for r in ranks.exact_quantiles(spark.createDataFrame(pdf), "x", [0.5], ["g"], 8).collect()}
    assert got == pytest.approx(pdf.groupby("g").x.median().to_dict())


def test_quantiles_of_empty_input(spark):
    empty = spark.createDataFrame([], "x double")
    assert ranks.exact_quantiles(empty, "x", [0.5]).filter("n > 0").count() == 0


def pair_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def average_precision(s, y):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = (y[hit] == 1).sum() / (y == 1).sum(), (y[hit] == 1).mean()
        total, last = total + (recall - last) * precision, recall
    return total


@pytest.mark.parametrize("pieces", [1, 8])
def test_metrics_equal_pair_counting(scores, pieces):
    pdf, df = scores
    got = evaluate.binary_metrics(df, "s", "y", pieces=pieces).first()
    s, y = pdf.s.to_numpy(), pdf.y.to_numpy()
    assert got["roc_auc"] == pytest.approx(pair_auc(s, y), abs=6e-5)
    assert got["average_precision"] == pytest.approx(average_precision(s, y), abs=6e-5)
    assert got["brier_score"] == pytest.approx(((s - y) ** 2).mean(), abs=6e-5)
    for row in evaluate.subgroup_metrics(df, ["g"], "s", "y", pieces=pieces).collect():
        part = pdf[pdf.g == row["group"]]
        assert row["roc_auc"] == pytest.approx(pair_auc(part.s.to_numpy(), part.y.to_numpy()), abs=6e-5)


def test_one_class_labels_give_no_auc(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1)], "s double, y int")
    assert evaluate.binary_metrics(df, "s", "y", pieces=1).first()["roc_auc"] is None
    assert evaluate.subgroup_metrics(df.withColumn("g", F.lit("a")), ["g"], "s", "y", pieces=1).count() == 0
    assert evaluate.auc_check(df, "s", "y", pieces=1).first()["status"] == "skip"


def numpy_psi(base, cur, bins=10):
    edges = np.percentile(base, np.linspace(0, 100, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    share = lambda a: np.where((h := np.histogram(a, edges)[0] / len(a)) == 0, 1e-6, h)
    b, c = share(base), share(cur)
    return float(np.sum((c - b) * np.log(c / b)))


@pytest.mark.parametrize("kind", ["continuous", "skewed", "constant", "disjoint"])
def test_psi_equals_histogram(spark, kind):
    rng = np.random.default_rng(3)
    base, cur = rng.normal(0, 1, 800), rng.normal(0.3, 1.2, 300)
    if kind == "skewed":
        base, cur = np.where(base < 0.6, 0.0, base), np.where(cur < 0.2, 0.0, cur)
    elif kind == "constant":
        base, cur = np.full(100, 5.0), np.array([5.0] * 50 + [6.0] * 10 + [1.0])
    elif kind == "disjoint":
        cur = cur + 100
    frames = [spark.createDataFrame(pd.DataFrame({"x": a})) for a in (base, cur)]
    got = drift.population_stability(*frames, "x", pieces=4).first()["psi"]
    assert got == pytest.approx(numpy_psi(base, cur), rel=1e-9)


def test_feature_drift_leaves_out_small_and_absent(spark):
    base = spark.range(100).selectExpr("CAST(id AS double) AS a", "CASE WHEN id < 5 THEN id END AS b")
    got = drift.feature_drift(base, base, ["a", "b", "c"], pieces=4).collect()
    assert [(r["feature"], r["psi"], r["status"]) for r in got] == [("a", 0.0, "ok")]


def test_chunked_lag_equals_plain_lag(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b"], 500, p=[0.9, 0.1]), "t": rng.integers(0, 40, 500), "i": range(500), "v": rng.normal(size=500)})
    pdf.loc[::7, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ranks.chunked_lag(df, ["k"], ["t", "i"], ["v", "i"], F.floor(F.col("t") / 5)).toPandas().sort_values(["k", "t", "i"])
    want = pdf.sort_values(["k", "t", "i"]).assign(previous_v=lambda d: d.groupby("k").v.shift(), previous_i=lambda d: d.groupby("k").i.shift())
    np.testing.assert_allclose(got.previous_v.astype(float), want.previous_v, equal_nan=True)
    np.testing.assert_allclose(got.previous_i.astype(float), want.previous_i, equal_nan=True)


def test_history_equals_self_join(spark):
    days = ["2023-02-28", "2023-03-01", "2023-03-31", "2023-12-01", "2024-02-28", "2024-02-29", "2024-02-29", "2024-03-31", "2025-02-28", "2025-03-01", None]
    rows, i = [], 0
    for patient in ("a", "b"):
        for d in days if patient == "a" else days[::2]:
            rows.append((f"{i}", patient, d, None if i % 4 == 0 else "2024-06-01" if i % 3 else d, None if i % 5 == 0 else i, None if i % 7 == 0 else i % 2 == 0, None if i % 6 == 0 else i % 3 == 0))
            i += 1
    df = spark.createDataFrame(rows, "admission_id string, patient_id string, admission_date string, discharge_date string, length_of_stay_days int, readmit_30day_flag boolean, icu_flag boolean")
    df = df.withColumns({c: F.to_date(c) for c in ("admission_date", "discharge_date")})
    df.createOrReplaceTempView("adm")
    want = spark.sql("""
      SELECT c.admission_id, count_if(w) AS prior_admissions_12m, count_if(p.admission_date >= c.admission_date - INTERVAL 90 DAYS) AS prior_admissions_90d,
        coalesce(sum(CASE WHEN w THEN CAST(p.readmit_30day_flag AS int) END), 0) AS prior_readmissions_1y, count_if(w AND p.icu_flag) AS prior_icu_stays,
        round(coalesce(avg(CASE WHEN w THEN CAST(p.length_of_stay_days AS decimal(18,4)) END), 0), 2) AS prior_los_avg_days, max(p.discharge_date) AS last_discharge_date
      FROM adm c LEFT JOIN LATERAL (SELECT *, admission_date >= c.admission_date - INTERVAL 12 MONTHS AS w FROM adm x WHERE x.patient_id = c.patient_id AND x.admission_date < c.admission_date) p
      GROUP BY c.admission_id""")
    got = lookback_history(df).select(*want.columns)
    key = lambda r: r["admission_id"]
    assert [[str(x) for x in r] for r in sorted(got.collect(), key=key)] == [[str(x) for x in r] for r in sorted(want.collect(), key=key)]
    assert lookback_history(df.limit(0)).count() == 0


def test_latest_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, t int, v string")
    assert sorted(r["v"] for r in ranks.latest_per_key(df, ["k"], [F.desc("t"), F.asc("v")]).collect()) == ["w", "y"]
    assert sorted(r["v"] for r in ranks.ties_at_top(df, ["k"], [F.desc("t")]).collect()) == ["w", "y", "z"]


def test_group_limit_comes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = ranks.top_per_group(df, ["k"], [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_paging_and_children(spark):
    df = spark.range(53).selectExpr("id", "id % 5 AS k")
    rows = filters.page(df, [F.asc("id")], 6, 10).collect()
    assert [r["id"] for r in rows] == [50, 51, 52] and {(r["total"], r["pages"]) for r in rows} == {(53, 6)}
    parents = spark.createDataFrame([(0,), (9,)], "k long")
    nested = {r["k"]: [x["id"] for x in r["latest"]] for r in filters.with_latest_children(parents, df, "k", [F.desc("id")], ["id"], 3).collect()}
    assert nested == {0: [50, 45, 40], 9: []}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "i int, s string, n int")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(filters.filter_by(df, {"s": None}, n__gte=5)) == [2, 3]
    assert ids(filters.filter_by(df, s=["a", "b"], n__known=False)) == [1]
    assert ids(filters.search(df, "B", ["s", "n"])) == [2]
    assert ids(filters.search(df, "7", ["s", "n"])) == [3]
    assert ids(filters.every_nth(df.withColumn("g", F.lit(1)), ["g"], [F.asc("i")], 2)) == [1, 3]

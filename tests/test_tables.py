"""Versioned tables, bitmaps and mining, neighbours and layouts, contributions, and streams with timers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baskets, bitmaps, explain, model, neighbours, recommend
from tidemark.operators.layout import spectral_layout
from tidemark.plans import star
from tidemark.session import shared_folder
from tidemark.sources.versions import Tables
from tidemark.streaming import streams


def dated(spark, rows):
    return spark.createDataFrame(rows, "k int, d string, v string").withColumn("d", F.to_date("d"))


def rows_of(tables, name="t"):
    return sorted((r["k"], str(r["d"]), r["v"]) for r in tables.read(name).collect())


def test_merge_rewrites_touched_months_only(spark, tmp_path):
    root = str(tmp_path)
    tables = Tables(spark, root)
    assert tables.merge("t", dated(spark, [(1, "2024-01-05", "a"), (2, "2024-02-10", "a"), (3, "2024-03-01", "a"), (4, None, "a")]), "k", "d") == ["2024-01", "2024-02", "2024-03", "none"]
    tables.publish()
    before = dict(Tables(spark, root).tables["t"]["parts"])
    again = Tables(spark, root)
    assert again.merge("t", dated(spark, [(2, "2024-03-05", "moved"), (5, "2024-03-07", "new"), (5, "2024-03-06", "older")]), "k", "d") == ["2024-02", "2024-03"]
    assert rows_of(Tables(spark, root)) == [(1, "2024-01-05", "a"), (2, "2024-02-10", "a"), (3, "2024-03-01", "a"), (4, "None", "a")]
    again.publish()
    now = Tables(spark, root)
    assert rows_of(now) == [(1, "2024-01-05", "a"), (2, "2024-03-05", "moved"), (3, "2024-03-01", "a"), (4, "None", "a"), (5, "2024-03-07", "new")]
    after = now.tables["t"]["parts"]
    assert after["2024-01"] == before["2024-01"] and after["none"] == before["none"] and "2024-02" not in after and after["2024-03"] != before["2024-03"]
    late = Tables(spark, root)
    assert late.merge("t", dated(spark, [(1, "2024-02-01", "late")]), "k", "d", 5) == []
    assert late.merge("t", dated(spark, [(6, "2024-03-04", "in time")]), "k", "d", 5) == ["2024-03"]
    late.publish()
    late.forget_older()
    assert len(rows_of(Tables(spark, root))) == 6


def test_a_run_that_dies_before_the_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path))
    star.refresh({"a": dated(spark, [(1, "2024-01-01", "old")]), "b": spark.range(3).withColumn("x", F.lit(1))}, tables)
    dying = Tables(spark, str(tmp_path))
    dying.put("a", dated(spark, [(1, "2024-01-01", "new")]))
    dying.put_parts("b", spark.range(2).withColumn("part", F.lit("p")), "part", ())
    monkeypatch.setattr(Tables, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        star.refresh({"b": spark.range(9)}, dying)
    kept = Tables(spark, str(tmp_path))
    assert rows_of(kept, "a") == [(1, "2024-01-01", "old")] and kept.read("b").count() == 3 and kept.version == 1


def test_bitmaps(spark):
    sets = [[], [0], [63, 64], [1, 5, 130], list(range(70))]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<int>").withColumn("b", bitmaps.bitmap(F.col("s"), 3))
    shown = frame.select("i", bitmaps.members(F.col("b")).alias("m"), bitmaps.count_bits(F.col("b")).alias("n"), bitmaps.members(bitmaps.beyond(F.col("b"), F.lit(63))).alias("after"))
    for r in shown.collect():
        assert (r.m, r.n, r.after) == (sets[r.i], len(sets[r.i]), [x for x in sets[r.i] if x > 63])
    both = frame.alias("x").crossJoin(frame.withColumnsRenamed({"i": "j", "b": "c"}).select("j", "c"))
    for r in both.select("i", "j", bitmaps.count_bits(bitmaps.common(F.col("b"), F.col("c"))).alias("n")).collect():
        assert r.n == len(set(sets[r.i]) & set(sets[r.j]))


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_itemsets_equal_counting_all_subsets(spark, longest):
    pick = random.Random(longest)
    sets = [sorted(pick.sample([f"i{j}" for j in range(80)], pick.choice([0, 1, 3])) + pick.sample(["a", "b", "c", "d", "e", "f"], pick.choice([0, 3, 5]))) for _ in range(120)]
    found = baskets.frequent_itemsets(spark.createDataFrame(list(enumerate(sets)), "id int, items array<string>"), 0.03, longest).collect()
    counts = {}
    for s in sets:
        for k in range(1, longest + 1):
            for part in itertools.combinations(s, k):
                counts[part] = counts.get(part, 0) + 1
    assert {tuple(r["items"]): r.freq for r in found} == {p: n for p, n in counts.items() if n >= math.ceil(0.03 * 120)}
    assert all(r.baskets == 120 for r in found)


def test_matches_equal_comparing_every_rule(spark):
    pick = random.Random(3)
    items = [f"DX:{i}" for i in range(70)] + ["CPT:x", "CPT:y"]
    rules = [(i, sorted(pick.sample(items, pick.choice([1, 2, 3, 4, 5]))), ["NO_READMIT"], "NO_READMIT", 0.1, round(pick.random(), 2), 1 + round(pick.random(), 1), 1.0, pick.choice([5, 9]), baskets.EFFECTIVENESS) for i in range(150)]
    rules.append((999, ["NO_READMIT"], ["DX:1"], "DX:1", 0.1, 0.9, 1.5, 1.0, 50, baskets.EFFECTIVENESS))
    frame = spark.createDataFrame(rules, "rule_id long, antecedents array<string>, consequents array<string>, consequent string, support double, confidence double, lift double, conviction double, evidence_count long, rule_type string")
    entities = [(i, pick.sample(items, pick.choice([0, 1, 4, 9]))) for i in range(60)]
    found = recommend.match_rules(spark.createDataFrame(entities, "id int, items array<string>"), frame, "id", n=None)
    best = {}
    for entity, own in entities:
        for _, needed, _, _, _, confidence, lift, _, n, _ in rules[:-1]:
            share = len(set(needed) & set(own)) / len(needed)
            if share >= 0.5:
                action = [x for x in needed if x.startswith("CPT:")]
                key = entity, f"Apply intervention bundle: {', '.join(action)}" if action else "Continue current care protocols"
                best[key] = max(best.get(key, 0), lift * confidence * math.log1p(n) * share)
    got = {(r.id, r.action): r.priority_score for r in found.collect()}
    assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k]) for k in best)
    long_rule = spark.createDataFrame([(1, items[:20], ["NO_READMIT"], "x", 0.1, 0.5, 1.5, 1.0, 5, baskets.EFFECTIVENESS)], frame.schema)
    with pytest.raises(ValueError):
        recommend.match_rules(spark.createDataFrame(entities, "id int, items array<string>"), long_rule, "id")


def test_neighbours_exact_and_by_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    random_numbers = np.random.default_rng(5)
    points = np.concatenate([random_numbers.normal(m, 1, (150, 6)) for m in (0, 4, 9)] + [np.zeros((120, 6))])  # a hot spot of equal points
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(None, [0.0] * 6), (9999, None)], "id long, v array<double>")
    asked = [i for i in range(len(points)) if i % 5 == 0]
    want = {}
    for i in asked:
        far = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        want[i] = [j for j in np.lexsort((np.arange(len(points)), far)) if j != i][:7]
    queries = rows.filter("id % 5 = 0 AND v IS NOT NULL")
    got = {}
    for r in neighbours.nearest_rows(rows, queries, "id", "v", 7).collect():
        got.setdefault(r.query_id, {})[r.position] = r.id
    assert {q: [f[p] for p in sorted(f)] for q, f in got.items()} == want
    near = neighbours.nearest_rows(rows, queries, "id", "v", 7, exact=False, first=3).collect()
    hits = sum(r.id in want[r.query_id] for r in near if r.query_id < 450)
    assert hits / (7 * sum(i < 450 for i in asked)) >= 0.9
    assert neighbours.nearest_rows(rows.limit(0), queries, "id", "v", 3).count() == 0


def test_nearest_pairs_equal_brute_force(monkeypatch):
    """Tiles, chunks and blocks smaller than the data; equal rows, far-off rows, unwanted cells, bounds and a cell of fewer rows than asked for."""
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    monkeypatch.setattr(neighbours, "PAIRS", 7)
    pick = np.random.default_rng(3)
    vectors = np.concatenate([pick.normal(size=(120, 12)), np.ones((40, 12)), 1e6 + pick.normal(size=(50, 12))])
    ids, cells = np.arange(210), np.concatenate([pick.integers(0, 3, 120), np.full(40, 3), np.full(45, 4), np.full(5, 5)])
    wanted, bounds = pick.random((210, 6)) < 0.7, np.where(pick.random(210) < 0.5, np.inf, 5.0)
    found = {}
    for q, r, far in zip(*neighbours.nearest_pairs(ids, vectors, cells, ids, vectors, wanted, bounds, 6)):
        found.setdefault(q, []).append((far, r))
    for q in range(210):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        want = sorted((far[r], r) for r in range(210) if r != q and wanted[q, cells[r]] and far[r] <= bounds[q])[:6]
        got = sorted(found.get(q, []))
        assert [x for x in got if x[0] <= bounds[q]] == want


def test_a_query_is_sent_once_to_a_block(spark, monkeypatch):
    """Where no cell can be passed over, rows sent grow with the blocks, not with the cells; of equal vectors few are stored."""
    pick = np.random.default_rng(8)
    points = np.concatenate([pick.normal(size=(250, 24)), np.zeros((150, 24))])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    sent, real = [], neighbours._nearest_in_blocks

    def counted(stored, visits, *others):
        sent.append((stored.count(), visits.count(), visits.groupBy("query_id", "block").count().filter("count > 1").count()))
        return real(stored, visits, *others)

    monkeypatch.setattr(neighbours, "_nearest_in_blocks", counted)
    found = neighbours.nearest_rows(rows, rows, "id", "v", 5, cells=20)
    assert found.groupBy("query_id").count().filter("count = 5").count() == 400
    assert all(stored == 250 + 6 and again == 0 for stored, _, again in sent) and sum(visits for _, visits, _ in sent) <= 400 * 2 * 4


def test_layout_separates_two_rings(spark):
    turn = np.linspace(0, 2 * np.pi, 30, endpoint=False)
    rings = np.concatenate([np.stack([r * np.cos(turn), r * np.sin(turn)], axis=1) for r in (1, 6)])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rings)], "id long, v array<double>")
    placed = {r.id: (r.x, r.y) for r in spectral_layout(rows, "id", "v", n=6, rounds=40).collect()}
    inner, outer = ([placed[i] for i in part] for part in (range(30), range(30, 60)))
    separated = any(max(p[a] for p in x) < min(p[a] for p in y) for a in (0, 1) for x, y in ((inner, outer), (outer, inner)))
    assert len(placed) == 60 and separated


def test_contributions_equal_all_orders(spark):
    """Against the definition: the mean, over all orders of the features, of what each adds to the expected log odds."""
    pick = np.random.default_rng(7)
    values = pick.normal(size=(300, 4))
    chance = 1 / (1 + np.exp(-(values[:, 0] * 2 + values[:, 1] * values[:, 2])))
    rows = spark.createDataFrame([(i, *map(float, v), int(pick.random() < p)) for i, (v, p) in enumerate(zip(values, chance))], "id long, a double, b double, c double, d double, y int")
    names = ["a", "b", "c", "d"]
    fitted = model.train(rows, names, "y", trees=6, depth=3)
    nodes = explain.node_table(fitted).toPandas()
    leaves = explain.leaves_of(nodes)
    scored = fitted.transform(rows.withColumns({n: F.col(n).cast("double") for n in names})).select("id", F.col("features"), F.col("rawPrediction"), F.col("probability"))
    got = {r.id: r for r in scored.withColumn("parts", model.contribution_array(fitted)).collect()}

    def expected(x, known):
        """The log odds with features outside ``known`` followed both ways by training weight."""
        total = 0.0
        for _, tree in nodes.groupby("tree"):
            by_id = {n.id: n for n in tree.itertuples()}

            def walk(at):
                n = by_id[at]
                if n.left < 0:
                    return n.value
                if n.feature in known:
                    return walk(n.left if x[int(n.feature)] <= n.threshold else n.right)
                return sum(walk(c) * by_id[c].cover for c in (n.left, n.right)) / n.cover

            total += 2 * tree["weight"].iloc[0] * walk(0)
        return total

    for i in range(0, 300, 37):
        x, parts = got[i].features.toArray(), got[i].parts
        want = np.zeros(4)
        for order in itertools.permutations(range(4)):
            for k, feature in enumerate(order):
                want[feature] += expected(x, set(order[: k + 1])) - expected(x, set(order[:k]))
        assert np.allclose(parts, want / 24, atol=1e-6)
        odds = math.log(got[i].probability[1] / got[i].probability[0])
        assert sum(parts) + explain.base_value(leaves) == pytest.approx(odds, abs=1e-6)


def test_spikes_equal_the_batch_rule_with_rows_out_of_order(spark):
    pick = random.Random(4)
    times = sorted(pick.sample(range(0, 40 * 24 * 60), 300))
    data = [(f"p{pick.choice([0, 0, 0, 1, 2])}", t, round(pick.random(), 2)) for t in times]
    data.append(("end", 60 * 24 * 60, 0.1))
    batches = sorted(((t + pick.choice([0, 0, 300, 1200]), e, t, s) for e, t, s in data))  # up to 20 hours late
    folder = shared_folder(spark, "test-spikes")
    frame = spark.createDataFrame([(i // 60, e, t, s) for i, (_, e, t, s) in enumerate(batches)], "n int, patient_id string, m long, risk_score double")
    frame = frame.withColumn("predicted_at", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz"))
    for n in range(6):
        frame.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(folder)
    found = streams.run_to_end(streams.score_spike_stream(streams.read_stream(spark, folder, frame, files_per_batch=1)), "test-spikes").collect()
    want, last = [], {}
    for e, t, s in sorted(data, key=lambda r: (r[1], r[2])):
        if e in last and t - last[e][0] <= 360 and s - last[e][1] >= 0.25 - 1e-12:
            want.append((e, last[e][1], s))
        last[e] = (t, s)
    near = lambda rows: sorted(rows)
    assert near((x.entity, x.previous, x.score) for x in found) == near(w for w in want if w[2] - w[1] >= 0.25)


def test_silent_windows_appear_with_zero(spark):
    folder = shared_folder(spark, "test-beats")
    rows = [(0, "a", "2024-01-01 00:10:00"), (0, "a", "2024-01-01 00:50:00"), (1, "b", "2024-01-01 01:10:00"), (1, "a", "2024-01-01 00:55:00"), (2, "a", "2024-01-01 05:10:00"), (3, "c", "2024-01-01 09:30:00")]
    frame = spark.createDataFrame(rows, "n int, kind string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    for n in range(4):
        frame.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(folder)
    found = streams.run_to_end(streams.heartbeat_counts(streams.read_stream(spark, folder, frame, files_per_batch=1), "kind", "at"), "test-beats").collect()
    got = {(r.kind, r.window_start.hour): r.n for r in found}
    assert got == {**{("a", h): {0: 3, 5: 1}.get(h, 0) for h in range(8)}, **{("b", h): int(h == 1) for h in range(1, 8)}}

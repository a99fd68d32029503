import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import baskets
from tidemark.operators import recommend as r
from tidemark.session import shared_folder
from tidemark.sources.versions import Tables
from tidemark.streaming import streams

RULES = "rule_id long, antecedents array<string>, consequents array<string>, confidence double, lift double, evidence_count long, rule_type string"


def rule_table(spark, pick, items, many=40):
    rows = [(i, sorted(pick.sample(items, pick.choice([1, 2, 3]))), ["NO_READMIT"], round(pick.random(), 2), 1 + round(pick.random(), 1), pick.choice([5, 9]), baskets.EFFECTIVENESS) for i in range(many)]
    return spark.createDataFrame(rows, RULES)


def test_compact_plans_equal_ranked_candidates(spark):
    """Repeated and missing keys, an action that the library names twice, and one that it shares with the mined ones."""
    pick = random.Random(8)
    kinds = ["discharge_planning", "social_support", "patient_education"]
    library = {
        f"k{i}": {
            "action": f"action {i % 11}" if i else "Continue current care protocols", "category": kinds[i % 3], "evidence_grade": "ABC"[i % 3], "reduces_readmission_by_pct": 5 + i * 7 % 13,
            "time_sensitivity": ["ongoing", "within_48h"][i % 2], "rationale_template": "at {a} of {missing}" if i % 5 == 0 else "at {a} and {b}", "triggers": {"a__gte": i % 6}, "icd10_trigger": ["X"] if i % 4 == 0 else [],
        } for i in range(14)
    }
    rows = [(f"e{i % 50}", pick.choice([None, 0, 2, 5]), i % 3, pick.choice([[], ["X"]])) for i in range(60)]
    features = spark.createDataFrame(rows, "id string, a int, b int, codes array<string>")
    items = [f"DX:{i}" for i in range(9)] + ["CPT:x", "CPT:y", "CPT:z"]
    entities = [(f"e{i}", pick.sample(items, pick.choice([0, 2, 5]))) for i in range(40)] + [(None, ["DX:1", "CPT:x"]), ("own", ["DX:2", "DX:3"])]
    people, rules = spark.createDataFrame(entities, "id string, items array<string>"), rule_table(spark, pick, items)
    mined = r.mined_candidates(r.match_rules(people, rules, "id"), "id")
    want = r.ranked_plan(r.library_candidates(features, library, "id", "codes", 9).unionByName(mined), "id")
    plans = r.compact_plans(features, library, "id", "codes", *r.matched_sets(people, rules, "id"), n=9)
    fields = [c for c in want.columns if c not in ("id", "_stream", "_order")]
    values = plans.schema["rows"].dataType.elementType["values"].dataType.names
    got = plans.select("id", F.inline(r.plan_texts(library, fields, values)))
    fixed = [c for c in fields if c != "rationale"]  # rows of a repeated key may name other values
    plain = lambda df, cs: sorted(map(repr, (tuple(x) for x in df.select("id", *cs).collect())))
    assert plain(got, fixed) == plain(want, fixed) and got.count() > 100
    single = [f"e{i}" for i in range(10, 50)] + ["own"]
    assert plain(got.filter(F.col("id").isin(single)), fields) == plain(want.filter(F.col("id").isin(single)), fields)
    assert plans.count() == want.select("id").distinct().count()
    assert "rationale" not in plans.schema["plan"].dataType.elementType.names  # only mined texts are kept


def test_entities_are_read_once_to_match_rules(spark):
    pick = random.Random(2)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(items):
        seen.add(1)
        return items

    items = [f"DX:{i}" for i in range(8)]
    people = spark.createDataFrame([(i, pick.sample(items, 3)) for i in range(50)], "id int, items array<string>").select("id", counted("items").alias("items"))
    assert r.match_rules(people, rule_table(spark, pick, items), "id").count() > 0
    assert seen.value == 50


def test_a_spike_entity_waits_on_one_timer():
    class Held:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return list(self.rows)

        def appendList(self, rows):
            self.rows += rows

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Last(Held):
        def get(self):
            return self.rows[0]

        def update(self, row):
            self.rows = [row]

    class Handle:
        def __init__(self):
            self.timers = set()
            self.calls = 0

        def getListState(self, *_):
            return Held()

        def getValueState(self, *_):
            return Last()

        def registerTimer(self, ms):
            self.calls += 1
            self.timers.add(ms)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    one, handle = streams._Spikes(6, 0.25), Handle()
    one.init(handle)
    hours = range(60)
    frame = pd.DataFrame({"at": pd.to_datetime([h * 3600 + 60 for h in hours], unit="s"), "score": [0.1 if h % 2 else 0.9 for h in hours]})
    assert list(one.handleInputRows(("p",), iter([frame]), At(0))) == [] and handle.calls <= 2
    assert handle.timers == {3_600_000}
    found = pd.concat(one.handleExpiredTimer(("p",), At(50 * 3_600_000), None))
    assert len(found) == 24 and 51 * 3_600_000 in handle.timers and handle.calls <= 4


def test_tagged_baskets_take_more_tasks_for_more_keys(spark, monkeypatch):
    monkeypatch.setattr(baskets, "KEYS_A_TASK", 10, raising=False)
    out = spark.range(200).select(F.col("id").alias("admission_id"), (F.col("id") % 3 == 0).alias("readmit_30day_flag"))
    items = spark.range(400).select((F.col("id") % 250).alias("admission_id"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("icd10_code"))
    nothing = spark.createDataFrame([(None, "z")], "admission_id long, icd10_code string")
    found = baskets.tagged_baskets(out, items.unionByName(nothing), items.withColumnRenamed("icd10_code", "cpt_code"))
    assert found.rdd.getNumPartitions() >= 20
    rows = {x.admission_id: x["items"] for x in found.collect()}
    assert set(rows) == set(range(200)) and rows[1] == ["CPT:c1", "CPT:c6", "DX:c1", "DX:c6", "NO_READMIT"] and "NO_READMIT" not in rows[3]


def test_parts_are_not_written_by_every_task(spark):
    tables = Tables(spark, shared_folder(spark, "few-files"))
    rows = spark.range(0, 4000, 1, 16).withColumn("part", (F.col("id") % 50).cast("string"))
    found = tables.put_parts("t", rows, "part", ())
    assert found.count() == 4000 and len(found.inputFiles()) <= 100

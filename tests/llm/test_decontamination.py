"""Decontamination against a search for every window in every text."""

import hashlib
import random
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, window=10):
    """(doc_id, words, hits, ids, spans) of every document, by comparing all places with all windows."""
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(item)
    found = []
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (named := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= named
        spans = [i for i in sorted(hit) if i - 1 not in hit]
        stops = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        found.append((doc_id, len(words), len(hit), tuple(sorted(str(i) for i in ids if i is not None)), tuple(zip(spans, stops))))
    return sorted(found, key=repr)


def given(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    return docs, spark.createDataFrame(items, "item_id long, text string")


def same(found, want):
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.stop) for s in r.spans)) for r in found.collect()]
    assert sorted(got, key=repr) == want


def test_odd_rows_and_items(spark):
    docs = cases.documents(spark)
    items = [(1, cases.PROSE), (1, cases.PROSE), (2, cases.PROSE.upper() + "!"), (10, None), (11, ""), (12, "---"), (None, "a b c d e"), (3, "one two"), (4, "far-id"), (5, "é ü"), (6, "x" * 50_000)]
    docs, bench = given(spark, docs, items)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items)
    extra = docs.select("*", *[F.lit("z").alias(c) for c in ("n_words", "stretches", "start", "words", "at", "items", "n_hit", "spans", "item_id", "salt")])
    same(decontamination.contamination(extra, bench.withColumn("n", F.lit(1))), want)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    same(decontamination.contamination(docs, bench.limit(0)), plain([(r.doc_id, r.text) for r in docs.collect()], []))


def test_shared_passages_and_near_misses(spark):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    run = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(run(pick.choice([1, 3, 4, 5, 7, 9, 10, 11, 25])))) for i in range(40) if i % 7] + [(100, " ".join(["again"] * 12)), (101, " ".join(["again"] * 11 + ["stop"]))]
    docs = []
    for i in range(150):
        words = run(pick.choice([0, 5, 30]))
        for _ in range(pick.choice([0, 1, 3])):
            own = pick.choice(items)[1].split()
            cut = own[pick.choice([0, 0, 1, 2]) :][: pick.choice([9, 10, 30])]
            if pick.random() < 0.3 and cut:
                cut[pick.randrange(len(cut))] = "other"
            words += cut + run(pick.choice([0, 0, 4]))
        docs.append((i % 140, pick.choice([" ", "-", ", "]).join(words)))
    docs += [(200 + i, " ".join(["again"] * 40)) for i in range(60)]
    frame, bench = given(spark, docs, items)
    for window in (10, 6):
        same(decontamination.contamination(frame, bench, window), plain(docs, items, window))
    with pytest.raises(ValueError):
        decontamination.contamination(frame, bench, 4)


def test_a_full_filter_loses_nothing(spark):
    each = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    every = np.full(1 << (decontamination.FILTER_BITS - 6), 2**64 - 1, dtype=np.uint64)
    assert decontamination.stretches_of(each, every, {5: 6}) == [(0, 40)]
    assert decontamination.stretches_of(each, every * np.uint64(0), {5: 6}) == []
    assert decontamination.stretches_of(each[:9], every, {5: 6}) == []


def test_digest_of_items(spark):
    found = decontamination.contamination(*given(spark, [(1, cases.PROSE), (2, "clean")], [(9, cases.PROSE), (10, cases.PROSE)]))
    row = found.where("doc_id = 1").select(F.sha2(F.array_join("items", ","), 256)).first()
    assert row[0] == hashlib.sha256(b"10,9").hexdigest()

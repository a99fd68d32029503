"""Phrase mining against counting every phrase of every piece."""

import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrase_mining

MARKS, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain(docs, least, longest, inside, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in MARKS.split((text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = WORD.findall(piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        kept, candidates = [], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                dropped |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= inside * f[p[i : i + k]]}
        for p, a in candidates.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(found)


def same(frame, want):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, frame.collect())) == want


def test_odd_rows(spark):
    docs = cases.documents(spark)
    odd = docs.select("*", *[F.lit("z").alias(c) for c in ("length", "n", "key", "shard", "words", "phrase", "a", "rank")])
    want = plain([(r.lang, r.text) for r in docs.collect()], 3, 3, 50, 40)
    assert {w[0] for w in want} == {"en", "und"}
    same(phrase_mining.collocations(odd, least=3, top=40), want)
    assert phrase_mining.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shards,longest", [(1, 3), (4, 3), (2, 4)])
def test_late_phrases_complete_their_cycle(spark, shards, longest):
    """Phrases become frequent in different shards, some in the last one only."""
    pick = random.Random(shards)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = []
    for i in range(400):
        text = pick.choices(vocabulary, weights, k=pick.choice([1, 8, 30]))
        if i > 300 and i % 2:
            text += ["late", "words", "come", "here"] * 2
        if i % 9 == 0:
            text += ["un", "ique"] + ["a\tb", "É", "\x1c"]
        docs.append((None if i % 5 == 0 else "xx" if i % 3 else "und", pick.choice([" ", "  ", " . ", "\t"]).join(text)))
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    same(phrase_mining.collocations(frame, least=10, longest=longest, inside=70, top=50, shards=shards), plain(docs, 10, longest, 70, 50))


def test_passing_filters_by_mistake_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "passing", lambda keys, bits: np.ones(len(keys), dtype=bool))
    docs = [("en", "a b c d e f g " * (1 + i % 4)) for i in range(12)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    same(phrase_mining.collocations(frame, least=10, top=9), plain(docs, 10, 3, 50, 9))


def test_words_named_like_languages(spark):
    docs = [("en", "es en es de " * 3), ("es", "en es en de " * 3), ("de", "en de es en " * 4), (None, "und en es " * 4)]
    same(phrase_mining.collocations(spark.createDataFrame(docs, "lang string, text string"), least=2), plain(docs, 2, 3, 50, 2000))


def test_scores_beyond_64_bits(spark):
    a, l, r = 10**12 + 7, 3 * 10**12, 2 * 10**12 + 1
    counts = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, length int, phrase string, n long")
    assert phrase_mining.scored(counts).first().score == 1_000_000 * a * a // (l * r)

"""The pipeline against plain loops over the smallest tables."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import WORD, near_components
from pyspark.sql import functions as F

import cases
import corpus_pipeline
from tidemark.llm import byte_bpe, quality_classifier
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def mixed(docs):
    """doc_id -> how many times the mix takes it, by the rule as it is told."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    by_source = defaultdict(list)
    for d, _, source in docs:
        by_source[source].append(d)
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    words = {s: sum(size[d] for d in by_source[s]) for s in names}
    free, target = {s: 1 + i % 3 for i, s in enumerate(names)}, {}
    while free:
        level = (sum(words.values()) - sum(target.values())) / sum(free.values())
        full = [s for s, w in free.items() if level * w > 3 * words[s]] or list(free)
        target |= {s: min(3 * words[s], level * free[s]) for s in full}
        free = {s: w for s, w in free.items() if s not in full}
    taken = Counter()
    for s in names:
        budget = int(target[s] + 0.5)
        left = budget % words[s] if words[s] else 0
        for d in sorted(by_source[s], key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            if size[d]:
                taken[d] = budget // words[s] + (left > 0)
                left -= size[d]
    return taken


def test_pipeline_equals_plain_loops(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_classifier.fit(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in quality_classifier.scored(docs, model).collect() if r.predicted == 1}
    newest = {}
    for d in sorted(kept):
        newest[rows[d].text] = d
    kept = sorted(newest.values())
    links = near_components([(d, rows[d].text) for d in kept])
    kept = [d for d in kept if links[d][1] == d]
    copies = mixed([(d, rows[d].text, rows[d].source) for d in kept])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = byte_bpe.ByteBpe(file.read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, n in copies.items():
        ids = np.array(library.encode_ordinary(rows[d].text or ""), "<u4").tobytes()
        want[d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((rows[d].text or "").encode()).hexdigest()] += n
    want = +want
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in found)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]


def test_every_stage_takes_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns named like those that the stages work with, nulls, repeated ids and rows: columns and kept texts stay as they are."""
    clashing = ["score", "predicted", "row", "held_out", "kept", "component_id", "keep_id", "taken", "target", "size", "key", "words", "digest", "copies"]
    docs = cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in clashing])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (16, 0, 0), (17, 0, 0), (14, None, 0), (None, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    given = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        assert {(r.doc_id, r.text) for r in found} <= given and all(r.score == "score" and r.size == "size" for r in found), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_a_repeated_id_is_learned_the_same_way_each_time(spark):
    texts = [(i, f"word{i % 7} and more of it " * 5) for i in range(60)] + [(3, "$$$ ### other text"), (3, "a third one")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    models = [quality_classifier.fit(docs.repartition(n), labels) for n in (1, 5)]
    assert np.array_equal(models[0].by_bucket, models[1].by_bucket) and models[0].bias == models[1].bias

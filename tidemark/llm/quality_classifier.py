"""Quality classifier (operator 4): supervised subword embeddings, trained by stochastic gradient descent in numpy.

Each word gives a hashed feature for itself and for its character n-grams, the word's ends marked, and one more where it
repeats the word before. A document is the mean of its features' learned vectors; a linear layer and a softmax over the two labels give the score. Only the text is an input.

Training takes a bounded sample: at most ``max_rows`` labelled documents that aren't held out, chosen by hash of the id. Their
feature counts (at most ``BUCKETS`` entries a document) are made by tasks and meet in one task, which descends; the driver
gets the model, which has a fixed size. Scoring
covers all rows: a linear layer over a mean is a mean of numbers, so the model is sent as one number per bucket, in one
broadcast of fixed size, and the numbers of words are kept in a bounded cache. No shuffle of texts, so hot sources and copies
don't matter.

Defined results: null and empty texts have no features and get the score of the bias alone; a null id isn't held out;
several labels of one id count as 1 if half or more are 1; null labels are ignored; without labels every score is 0.5, and
with labels of one value only it leans to that value; equal documents get equal scores; other columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, table, whole_text

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
CACHED_WORDS = 300_000
#: A word that repeats the one before adds this many of one feature; a document's mean counts so many features of no effect,
#: so that a few words don't decide strongly.
REPEATS, REPEAT_BUCKET, PADDING = 5, zlib.crc32(b"\\0=") % BUCKETS, 100
MAX_ROWS, EPOCHS, DIMENSIONS, RATE, SEED = 4000, 12, 16, 0.5, 7


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word.decode()}>"
    found = [zlib.crc32(b"\\0" + word) % BUCKETS]
    for size in GRAMS:
        found += [zlib.crc32(marked[i : i + size].encode()) % BUCKETS for i in range(len(marked) - size + 1)]
    return found


def repeats(words: list[bytes]) -> int:
    return REPEATS * sum(map(operator.eq, words, words[1:]))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class QualityModel:
    """What a feature adds to label 1's logit less label 0's, before the mean is taken, and the bias between the two."""

    by_bucket: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, dimensions: int = DIMENSIONS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Learns vectors, weights and biases, document by document over (buckets, counts, label); the rate falls in a line to
    nothing. As nothing but the difference of the two logits is used, the model is folded to that."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    weights, bias = np.zeros((dimensions, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    rows = [(buckets, (counts / (counts.sum() + PADDING)).astype(np.float32), label) for buckets, counts, label in rows if len(buckets)]
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            buckets, shares, label = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = shares @ vectors[buckets]
            logits = hidden @ weights + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = weights @ wrong
            weights -= now * np.outer(hidden, wrong)
            bias -= now * wrong
            vectors[buckets] -= now * len(buckets) ** 0.5 * shares[:, None] * back
    return QualityModel((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> QualityModel:
    """A model from the labelled rows of ``docs`` that aren't held out, ``max_rows`` of them at most."""
    marked = labels.where(F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("__share"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = marked.withColumn("__order", order).orderBy("__order").limit(max_rows).select("doc_id", "__order", (F.col("__share") >= 0.5).cast("int").alias("__label"))
    texts = docs.select("doc_id", whole_text().alias("__text")).join(F.broadcast(chosen), "doc_id")
    first = F.struct(F.md5("__text"), "__text")  # of a repeated id, the text whose hash is least
    texts = texts.groupBy("doc_id", "__order", "__label").agg(F.min(first)["__text"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = BoundedCache(word_features, 50_000)
        for batch in batches:
            buckets, counts = [], []
            for text in batch.column(2):
                total = np.zeros(BUCKETS, dtype=np.int64)
                words = text.as_py().encode().split()
                for word in words:
                    np.add.at(total, cache[word], 1)
                total[REPEAT_BUCKET] += repeats(words)
                found = np.flatnonzero(total)
                buckets.append(found.astype("<u4").tobytes())
                counts.append(total[found].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["o", "label", "buckets", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, buckets, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                rows.append((np.frombuffer(buckets, "<u4"), np.frombuffer(counts, "<u4"), label))
        model = train(rows, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.by_bucket.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["by_bucket", "bias"])

    counted = texts.select("__order", "__label", "__text").mapInArrow(run, "o string, label int, buckets binary, counts binary")
    learned = counted.repartition(1).sortWithinPartitions("o").mapInArrow(learn, "by_bucket binary, bias double").first()
    if learned is None:
        return train([], **settings)
    return QualityModel(np.frombuffer(learned.by_bucket, dtype=np.float64), learned.bias)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("__text"))
    return _with_scores(given, model, "doc_id long, held_out boolean")


def _scorer(by_bucket: np.ndarray, bias: float) -> Callable[[str], float]:
    """The score of a text; values of frequent words are kept."""
    repeat_value = float(by_bucket[REPEAT_BUCKET])

    def value(word: bytes) -> tuple[float, int]:
        found = word_features(word)
        return float(by_bucket[found].sum()), len(found)

    cache = BoundedCache(value, CACHED_WORDS)

    def score(text: str) -> float:
        words = text.encode().split()
        count = repeats(words)
        total = count * repeat_value
        for word in words:
            v, n = cache[word]
            total += v
            count += n
        logit = bias + total / (count + PADDING)
        return 1 / (1 + np.exp(-max(-500.0, min(500.0, logit))))

    return score


def _with_scores(given: DataFrame, model: QualityModel, kept: str) -> DataFrame:
    """All columns of ``given`` but the last, its text, with score and predicted."""
    sent = given.sparkSession.sparkContext.broadcast((model.by_bucket, model.bias))
    names = [*given.columns[:-1], "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(*sent.value)
        for batch in batches:
            scores = [score(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), predicted], names=names)

    return given.mapInArrow(run, f"{kept}, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, columns as given, that the model trained on ``labels`` does not reject."""
    model = fit(docs, labels, **settings)
    given = docs.select(F.struct("*").alias("row"))  # names of columns can't clash, and a text goes to Python once
    sent = docs.sparkSession.sparkContext.broadcast((model.by_bucket, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(*sent.value)
        for batch in batches:
            rows = batch.column(0)
            kept = pa.array([score(text.as_py() or "") >= 0.5 for text in rows.field("text")], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.filter(kept)], names=["row"])

    return given.mapInArrow(run, given.schema).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))

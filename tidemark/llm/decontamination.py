"""Benchmark decontamination (operator 11): a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` words; an item of fewer words is one window. A window is the set of its
``SHINGLE``-word shingles (of a shorter window: itself), and a document holds it where all of them lie in a row.

1. The shingles of all windows set bits in a filter of fixed size, the only thing that is broadcast. Each document gives the
   stretches whose shingles all pass, where they are as many in a row as the shortest window needs: no occurrence is lost,
   and most documents give none. Equal stretches are folded, so a passage that many documents share is joined once.
2. Shingles are ordered by rarity in the stretches. All shingles of a window must occur, so its necessary prefix is the
   rarest one; a window with a shingle that doesn't occur at all is dropped. Prefixes are equijoined with the stretches'
   shingles.
3. The place of the shingle in the window and in the stretch bounds where the window would start and end; words are then
   compared exactly over a piece of text as long as the window, which each joined row carries.
4. Hits are merged to spans for each distinct stretch, and given to its documents.

Hot groups: a common stretch is one row until the last join, which is salted; a common shingle is a prefix only where a
window has no rarer one. Benchmarks of any size work: a full filter only lets more stretches pass to the join.

Defined results: null and empty texts have no words and no hits; items without words have no windows; items of equal text
are all listed, repeated items once; windows of an item without an id hit, but the item is neither listed nor counted;
repeated rows and null ids are rows of their own; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, table, whole_text
from tidemark.session import written

WINDOW, SHINGLE = 10, 5
#: Logarithm of the filter's bits.
FILTER_BITS = 24
CACHED_WORDS, SALTS = 400_000, 16

#: A-Z lower-cased, other ASCII signs than letters and digits as spaces; bytes from 128 on belong to words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_PLACES = np.random.default_rng(11).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def shingle_hashes(each: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words, of hashes of the words."""
    n = len(each) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    mixed = sum((each[k : k + n] * _PLACES[k] for k in range(1, size)), each[:n] * _PLACES[0]) + np.uint64(size)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


class _Hasher:
    """Hashes of words, of which frequent ones are kept."""

    def __init__(self):
        self.one = BoundedCache(xxhash.xxh64_intdigest, CACHED_WORDS).__getitem__

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.one, words), dtype=np.uint64, count=len(words))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id`` (text), ``words`` (of the window, joined), ``n`` and ``shingles`` of every window of ``items`` (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hasher()
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                n = min(window, len(words))
                size = min(SHINGLE, n)
                each = shingle_hashes(hashes(words), size).view(np.int64).tolist()
                item = item.as_py()
                found += [(item, b" ".join(words[i : i + n]).decode(), n, each[i : i + n - size + 1]) for i in range(len(words) - n + 1)]
            columns = list(zip(*found)) if found else [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "words", "n", "shingles"])

    given = items.select(F.col("item_id").cast("string").alias("item_id"), whole_text().cast("binary").alias("text"))
    return given.mapInArrow(run, "item_id string, words string, n int, shingles array<long>")


def sent_filter(windows: DataFrame) -> tuple[Broadcast, dict[int, int]]:
    """The bits of all shingles, 2 MB at any number of windows, and how many in a row are needed by shingle size."""
    spark, shift = windows.sparkSession, 64 - FILTER_BITS
    place = F.shiftrightunsigned("shingle", shift)
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    shingles = windows.select(F.explode("shingles").alias("shingle")).select(place.alias("place"))
    cells = shingles.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    needed: dict[int, int] = {}
    for row in windows.select("n").distinct().collect():  # at most ``window`` lengths
        size = min(SHINGLE, row.n)
        needed[size] = min(needed.get(size, row.n), row.n - size + 1)
    return spark.sparkContext.broadcast(bits.view(np.uint64)), needed


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def stretches_of(each: np.ndarray, bits: np.ndarray, needed: dict[int, int]) -> list[tuple[int, int]]:
    """First and last-but-one word of the stretches of a document that may hold windows; they neither overlap nor touch."""
    found = []
    for size, least in needed.items():
        ok = np.concatenate(([False], passing(shingle_hashes(each, size), bits), [False]))
        if ok.any():
            edges = np.flatnonzero(ok[1:] != ok[:-1]).reshape(-1, 2)
            found += [(a, b + size - 1) for a, b in edges.tolist() if b - a >= least]
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def document_stretches(docs: DataFrame, bits: Broadcast, needed: dict[int, int]) -> DataFrame:
    """``row, doc_id, n_words, stretches`` (of start, key, words) for every row of ``docs``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("key", pa.binary()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filter_bits = _Hasher(), bits.value
        for batch in batches:
            counts, found = [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                counts.append(len(words))
                mine = []
                for start, stop in stretches_of(hashes(words), filter_bits, needed):
                    joined = b" ".join(words[start:stop])
                    mine.append({"start": start, "key": hashlib.blake2b(joined, digest_size=16).digest(), "words": joined.decode()})
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["row", "doc_id", "n_words", "stretches"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return given.mapInArrow(run, "row long, doc_id long, n_words long, stretches array<struct<start: long, key: binary, words: string>>")


def _shingles_of(stretches: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """``key, at, shingle, lead, piece`` of every shingle of ``stretches`` (key, words): the piece of text has ``lead`` words before
    the shingle and reaches as far as a window could."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hasher()
        for batch in batches:
            for key, joined in zip(batch.column(0), batch.column(1)):
                words = joined.as_py().split(" ")
                each = hashes([w.encode() for w in words])
                for size in sizes:
                    shingles = shingle_hashes(each, size)
                    n, lead = len(shingles), 0 if size < SHINGLE else window - size
                    if n:
                        pieces = [" ".join(words[max(0, i - lead) : i + max(window, size)]) for i in range(n)]
                        at = np.arange(n, dtype=np.int64)
                        arrays = [pa.array([key.as_py()] * n, pa.binary()), pa.array(at), pa.array(shingles.view(np.int64)), pa.array(np.minimum(at, lead)), pa.array(pieces, pa.string())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["key", "at", "shingle", "lead", "piece"])

    return stretches.select("key", "words").mapInArrow(run, "key binary, at long, shingle long, lead long, piece string")


def occurrences(stretches: DataFrame, windows: DataFrame, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """``key, start, n, words``: where the distinct ``windows`` (words, n, shingles) occur in distinct ``stretches`` (key, words)."""
    posted = _shingles_of(stretches, sizes, window)
    often = posted.groupBy("shingle").agg(F.count("*").alias("often"))
    placed = windows.select("words", "n", F.size("shingles").alias("size"), F.posexplode("shingles").alias("p", "shingle")).join(often, "shingle")
    rarest = placed.groupBy("words", "n", "size").agg(F.count("*").alias("known"), F.min(F.struct("often", "shingle", "p")).alias("first")).where("known = size")
    prefixes = rarest.select("words", "n", "first.shingle", "first.p")
    inside = F.array_join(F.slice(F.split("piece", " "), F.greatest(F.col("lead") - F.col("p") + 1, F.lit(1)).cast("int"), F.col("n")), " ")
    joined = posted.join(prefixes, "shingle").where((F.col("lead") >= F.col("p")) & (inside == F.col("words")))
    return joined.select("key", (F.col("at") - F.col("p")).alias("start"), "n", "words")


def spans_of(hits: DataFrame) -> DataFrame:
    """``key, n_hit, spans``: the hits (key, start, n) of each key merged where they meet, as (start, stop) in ascending order."""
    of_key = Window.partitionBy("key").orderBy("start", "stop")  # no more rows than a document has words, times window lengths
    rows = hits.select("key", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    reach = F.max("stop").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    merged = begun.withColumn("span", F.sum("new").over(of_key)).groupBy("key", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (ids as text, ascending) and ``spans`` (of word numbers from 0, the stop excluded) of every row
    of ``docs`` (doc_id, text)."""
    if window < SHINGLE:
        raise ValueError(f"windows have {SHINGLE} words at least")
    named = written(item_windows(items, window), "item-windows")
    windows = written(named.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "windows")
    bits, needed = sent_filter(windows)
    rows = written(document_stretches(docs, bits, needed), "stretches")
    parts = rows.select("row", F.inline("stretches"))
    distinct = written(parts.groupBy("key").agg(F.min("words").alias("words")), "distinct-stretches")
    found = written(occurrences(distinct, windows, sorted(needed), window), "occurrences")
    listed = found.select("key", "words").distinct().join(named.select("words", "item_id").distinct(), "words").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    known = spans_of(found).join(listed, "key")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("begin")).alias("start"), (s["stop"] + F.col("begin")).alias("stop")))
    met = parts.select("row", F.col("start").alias("begin"), "key", F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"])
    total = met.groupBy("row").agg(
        F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(shifted))).alias("spans"),
    )
    some = rows.where(F.size("stretches") > 0).select("row", "doc_id", "n_words").join(total, "row", "left")
    others = rows.where(F.size("stretches") == 0).select("doc_id", "n_words")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start: long, stop: long>>")}
    clean = others.withColumns(none)
    return some.select("doc_id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()]).unionByName(clean)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS words
  FROM items WHERE len(w) > 0),
places AS (
  SELECT row, n, unnest(range(0, len(w) - n + 1)) AS start, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS words
  FROM worded, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT p.row, p.start, p.n, w.item_id FROM places p JOIN windows w USING (n, words)),
counts AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(start, start + n)) AS spot FROM hits) GROUP BY row),
listed AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN counts USING (row) LEFT JOIN listed USING (row)
"""

"""Phrase collocation mining (operator 12): dynamic itemset counting over cyclic shard scans.

Texts are cut into pieces at marks, pieces into words. Documents are dealt into shards; step t scans shard t modulo their
number, and each length is counted in the same scans as the others. Words are counted from the first step on. A longer phrase becomes active once both
phrases of one word less inside it have reached the threshold, and is counted from the next step until every shard has been
scanned once; scans end when no phrase is within its cycle.

Counters are kept by 64-bit fingerprints of language and words, one count for each shard, in packed blocks that every step
merges, bucket by bucket, with what the scan has counted: a shard's count is the same whenever it's scanned, so counting
again does no harm. What is active, and what has become so within the last cycle, is sent to the tasks as filters of fixed
size. Wrong passes of a filter and shared fingerprints only count too much. At the end one scan counts the texts of the
phrases that reached the threshold, so the results don't depend on these fingerprints.

Scale: words are stored once as 32-bit fingerprints, so scans are array work; counts are summed within about ``FLUSH`` words
before any shuffle, so a common phrase is a few entries of a block; buckets are equal ranges of fingerprints and grow in
number with the words, so a task merges a bounded block; steps are bounded by shards times the greatest length. Two filters
for each length under the greatest go to the driver and the tasks: 2 MB each.

Defined results: null and empty texts have no words; a null language is ``und``, together with the language of that name;
repeated rows count each; ties are ordered by phrase; a language without candidates has no rows, nor has an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, table, whole_text
from tidemark.session import discard, shared_folder, written

LEAST, LONGEST, INSIDE, TOP, SHARDS = 10, 3, 50, 2000, 3
#: Logarithm of a filter's bits.
FILTER_BITS = 24
#: Words counted together; words of which hashes are kept.
FLUSH, CACHED_WORDS = 1_500_000, 300_000
#: Words of the input for each bucket of counters.
BUCKET_WORDS = 2_000_000

#: A-Z lower-cased, ``.,;:!?`` and line ends as full stops, tabs as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = b"."
_FACTOR, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes) -> list[bytes]:
    """Words, and a full stop at the end of each piece."""
    tokens = text.translate(_PLAIN).replace(_END, b" . ").split()
    tokens.append(_END)
    return tokens


class _Marker:
    """Fingerprints of words within a language, of 64 and of 32 bits; 0 ends a piece."""

    def __init__(self):
        self.one = BoundedCache(lambda word: 0 if word == _END else xxhash.xxh64_intdigest(word) or 1, CACHED_WORDS).__getitem__

    def __call__(self, lang: bytes, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = np.fromiter(map(self.one, tokens), dtype=np.uint64, count=len(tokens))
        wide = (each ^ np.uint64(xxhash.xxh64_intdigest(lang, seed=1))) * _FACTOR
        marks = (wide >> np.uint64(32)).astype(np.uint32)
        marks[marks == 0] = 1
        marks[each == 0] = 0
        return wide, marks


def word_keys(marks: np.ndarray) -> np.ndarray:
    keys = (marks.astype(np.uint64) + np.uint64(1)) * _FACTOR
    return (keys ^ (keys >> np.uint64(29))) * _OTHER


def longer_keys(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the phrases with one more word, given the keys of phrases and of the words after them."""
    mixed = (keys ^ (words >> np.uint64(17))) * _FACTOR + words
    return mixed ^ (mixed >> np.uint64(32))


def passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def phrase_keys(marks: np.ndarray, active: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each length: ``length, keys, whole, parts`` by starting place. ``whole``: the place starts a phrase of that length within a piece, of which
    both shorter phrases pass ``active``; ``parts``: which phrases of one word less pass (of words: none)."""
    words = word_keys(marks)
    keys, whole, parts = words, marks != 0, None
    for length in range(1, longest + 1):
        if length > 1:
            parts = np.zeros(len(whole), dtype=bool)
            parts[whole] = passing(keys[whole], active[length - 1])
            whole = parts[:-1] & parts[1:]
            keys = longer_keys(keys[:-1], words[length - 1 :])
        yield length, keys, whole, parts


def shards_of(docs: DataFrame, shards: int) -> str:
    """Writes the words of ``docs`` (lang, text) as fingerprints, in one folder for each shard; gives the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = _Marker()
        for batch in batches:
            marks = [marker(lang.as_py(), tokens_of(text.as_py()))[1].tobytes() for lang, text in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["shard", "words"])

    path = shared_folder(docs.sparkSession, "phrase-shards")
    shard = (F.monotonically_increasing_id() % shards).cast("int")
    given = docs.select(shard.alias("shard"), _lang().cast("binary").alias("lang"), whole_text().cast("binary").alias("text"))
    given.mapInArrow(run, "shard int, words binary").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _packed(buckets: int, length: int, shard: int | None, keys: np.ndarray, planes: np.ndarray, reached: np.ndarray | None, first: int = 0) -> list[dict]:
    """Ascending ``keys`` as rows of a bucket (an equal range of the key space, from ``first`` on) and a length. Most counts are small, so those
    below 256 are packed as bytes, apart from the others."""
    rows, small = [], planes.max(axis=0, initial=0) < 256
    for kind in (np.uint8, np.uint64):
        chosen = np.flatnonzero(small if kind is np.uint8 else ~small)
        own, counts = keys[chosen], planes[:, chosen].astype(kind)
        cuts = np.searchsorted(own, np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**64 // buckets)) if buckets > 1 else []
        for bucket, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(own)])):
            if b > a:
                steps = None if reached is None else reached[chosen[a:b]].tobytes()
                rows.append({"bucket": first + bucket, "length": length, "shard": shard, "width": np.dtype(kind).itemsize,
                             "keys": own[a:b].tobytes(), "counts": counts[:, a:b].tobytes(), "reached": steps})
    return rows


_PACKED = pa.schema([("bucket", pa.int32()), ("length", pa.int32()), ("shard", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("reached", pa.binary())])
_PACKED_SQL = "bucket int, length int, shard int, width int, keys binary, counts binary, reached binary"


def _counts(row: dict, planes: int) -> np.ndarray:
    return np.frombuffer(row["counts"], dtype=np.uint8 if row["width"] == 1 else np.uint64).reshape(planes, -1)


def scanned(shard: DataFrame, number: int, filters: Broadcast, longest: int, with_words: bool, buckets: int) -> DataFrame:
    """Counts of the phrases of a shard that are within their cycle, summed in part: rows of a bucket of the key space and a length with
    ascending ``keys`` and their ``counts``, both packed.

    ``filters``: by length, the bits of all phrases that reached the threshold and of those that did within the last cycle.
    """

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        active = {length: bits for length, (bits, _) in filters.value.items()}
        before = None
        for length, keys, whole, parts in phrase_keys(np.concatenate(held), active, longest):
            if length > 1:
                recent = np.zeros(len(parts), dtype=bool)
                recent[parts] = passing(before[parts], filters.value[length - 1][1])
                chosen = keys[whole & (recent[:-1] | recent[1:])]
            else:
                chosen = keys[whole] if with_words else keys[:0]
            before = keys
            found, often = np.unique(chosen, return_counts=True)
            if rows := _packed(buckets, length, number, found, often[None, :], None):
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for words in batch.column(0):
                held.append(np.frombuffer(words.as_py(), dtype=np.uint32))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    return shard.select("words").mapInArrow(run, _PACKED_SQL)


def merged_block(rows: list[dict], step: int, shards: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts by shard and the step that met the threshold (255: none yet) of the packed ``rows`` of a bucket and length.

    Rows with a shard are parts of this step's scan and add up; the others are the counters so far. A shard that is scanned
    again gives the same count again.
    """
    parts, known = [r for r in rows if r["shard"] is not None], [r for r in rows if r["shard"] is None]
    given = [np.frombuffer(r["keys"], dtype=np.uint64) for r in (*known, *parts)]
    keys, place = np.unique(np.concatenate(given), return_inverse=True)
    planes, reached, now = np.zeros((shards, len(keys)), dtype=np.uint64), np.full(len(keys), 255, dtype=np.uint8), np.zeros(len(keys), dtype=np.uint64)
    start = 0
    for row, own in zip((*known, *parts), given):
        mine = place[start : start + len(own)]
        start += len(own)
        if row["shard"] is None:
            planes[:, mine] = _counts(row, shards)
            reached[mine] = np.frombuffer(row["reached"], dtype=np.uint8)
        else:
            now[mine] += _counts(row, 1)[0]  # the keys of a row differ
    planes[step % shards] = np.maximum(planes[step % shards], now)
    reached[(reached == 255) & (planes.sum(axis=0) >= least)] = step
    return keys, planes, reached


def merged(state: DataFrame | None, new: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """Counters after a step, packed as in ``scanned``, by shard. Those below the threshold go when all phrases of their length have
    had their cycle, by step length * shards - 1."""

    def run(table: pa.Table) -> pa.Table:
        by_length = defaultdict(list)
        for row in table.to_pylist():
            by_length[row["length"]].append(row)
        out = []
        for length, rows in by_length.items():
            keys, planes, reached = merged_block(rows, step, shards, least)
            kept = (reached != 255) | (length * shards > step + 1)
            out += _packed(1, length, None, keys[kept], planes[:, kept], reached[kept], rows[0]["bucket"])
        return pa.Table.from_pylist(out, schema=_PACKED)

    rows = new if state is None else new.unionByName(state)
    return rows.groupBy("bucket").applyInArrow(run, _PACKED_SQL)


def sent_filters(state: DataFrame, step: int, shards: int, longest: int) -> tuple[Broadcast, bool]:
    """Filters by length for the step after ``step``, and whether any phrase is within its cycle then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reached = np.frombuffer(row["reached"], dtype=np.uint8)
                keys, reached = np.frombuffer(row["keys"], dtype=np.uint64)[reached != 255], reached[reached != 255]
                place = keys >> np.uint64(64 - FILTER_BITS)
                bits = np.uint64(1) << (place & np.uint64(63))
                cells, at = np.unique((place >> np.uint64(6)).astype(np.int64), return_inverse=True)
                both = np.zeros((2, len(cells)), dtype=np.uint64)
                np.bitwise_or.at(both[0], at, bits)
                np.bitwise_or.at(both[1], at, np.where(reached.astype(np.int64) > step - shards, bits, np.uint64(0)))
                arrays = [pa.array(np.full(len(cells), row["length"], dtype=np.int32)), *map(pa.array, (cells, both[0].view(np.int64), both[1].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["length", "cell", "bits", "recent"])

    rows = state.where(F.col("length") <= longest).select("length", "keys", "reached").mapInArrow(run, "length int, cell long, bits long, recent long")
    cells = rows.groupBy("length", "cell").agg(F.bit_or("bits").alias("bits"), F.bit_or("recent").alias("recent")).toArrow()
    found, any_recent = {}, False
    lengths = cells["length"].to_numpy()
    for length in range(1, longest + 1):
        mine, pair = lengths == length, []
        for name in ("bits", "recent"):
            bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
            bits[cells["cell"].to_numpy()[mine]] = cells[name].to_numpy()[mine]
            pair.append(bits.view(np.uint64))
        any_recent |= bool(pair[1].any())
        found[length] = tuple(pair)
    return state.sparkSession.sparkContext.broadcast(found), any_recent


def frequent_keys(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """Counters (as ``merged`` gives them) of all phrases that reach the threshold, counted over their whole cycles."""
    if not 1 <= longest * shards < 255:
        raise ValueError("lengths times shards must be less than 255")
    spark = docs.sparkSession
    path = shards_of(docs, shards)
    dealt = spark.read.schema("words binary, shard int").parquet(path)
    words = dealt.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // (4 * BUCKET_WORDS)))
    state, step = None, 0
    filters, recent = spark.sparkContext.broadcast({k: (np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64),) * 2 for k in range(1, longest)}), False
    while step < shards or recent:
        number = step % shards
        new = scanned(dealt.where(F.col("shard") == number), number, filters, longest, step < shards, buckets)
        earlier, state = state, written(merged(state, new, step, shards, least), "phrase-counters")
        if earlier is not None:
            discard(earlier)
        filters, recent = sent_filters(state, step, shards, longest - 1)
        step += 1
    return state


_TEXTS = pa.schema([("bucket", pa.int32()), ("lang", pa.binary()), ("length", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _equal_runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of numbers, the place of one of each distinct pair and how often it is there."""
    joint = first ^ (second * _OTHER)
    order = np.argsort(joint)
    a, b = first[order], second[order]
    new, changed = np.ones(len(order), dtype=bool), joint[order][1:] != joint[order][:-1]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if (new[1:] & ~changed).any():  # different pairs share a joint number: order by both
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))


def counted_texts(tokens: list[bytes], langs: list[bytes], sizes: list[int], wide: np.ndarray, marks: np.ndarray, bits: dict[int, np.ndarray], longest: int, buckets: int) -> list[dict]:
    """Texts and counts of the phrases in ``tokens`` that pass ``bits``, packed by bucket, language and length; of the ``sizes`` tokens of each document,
    the language is given. Equal phrases are told by 128 bits."""
    names = sorted(set(langs))
    lang_of = np.repeat(np.array([names.index(x) for x in langs], dtype=np.int32), sizes)
    words = np.bincount(lang_of[marks != 0], minlength=len(names))
    rows = [{"bucket": 0, "lang": x, "length": 0, "phrases": b"", "counts": np.uint64(n).tobytes()} for x, n in zip(names, words) if n]
    own = wide
    for length, keys, whole, _ in phrase_keys(marks, bits, longest):
        if length > 1:
            own = longer_keys(own[:-1], wide[length - 1 :])
        at = np.flatnonzero(whole)
        at = at[passing(keys[at], bits[length])]
        place, often = _equal_runs(keys[at], own[at])
        place = at[place]
        bucket = (keys[place] >> np.uint64(32)) % np.uint64(buckets)
        group = bucket.astype(np.int64) * len(names) + lang_of[place]
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            phrases = [b" ".join(tokens[i : i + length]) for i in place[part].tolist()]
            rows.append({"bucket": int(bucket[part[0]]), "lang": names[lang_of[place[part[0]]]], "length": length, "phrases": b"\n".join(phrases), "counts": often[part].astype(np.uint64).tobytes()})
    return rows


def phrase_counts(docs: DataFrame, state: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, length, phrase, n`` of all phrases of ``docs`` (lang, text) that occur ``least`` times, among those of ``state``; length 0 counts
    all words."""
    filters, _ = sent_filters(state, 0, 0, longest)
    buckets = (state.agg(F.max("bucket")).first()[0] or 0) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker, bits = _Marker(), {length: bits for length, (bits, _) in filters.value.items()}
        tokens, langs, sizes, wides, marks = [], [], [], [], []

        def packed() -> pa.RecordBatch:
            rows = counted_texts(tokens, langs, sizes, np.concatenate(wides), np.concatenate(marks), bits, longest, buckets)
            return pa.RecordBatch.from_pylist(rows, schema=_TEXTS)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = tokens_of(text.as_py())
                wide, mark = marker(lang.as_py(), own)
                tokens += own
                langs.append(lang.as_py())
                sizes.append(len(own))
                wides.append(wide)
                marks.append(mark)
                if len(tokens) >= FLUSH:
                    yield packed()
                    tokens, langs, sizes, wides, marks = [], [], [], [], []
        if tokens:
            yield packed()

    def summed(table: pa.Table) -> pa.Table:
        totals: dict[tuple[bytes, int], Counter] = defaultdict(Counter)
        for row in table.to_pylist():
            of_lang = totals[row["lang"], row["length"]]
            for phrase, n in zip(row["phrases"].split(b"\n"), np.frombuffer(row["counts"], dtype=np.uint64).tolist()):
                of_lang[phrase] += n
        rows = [(lang.decode(), length, phrase.decode(), n) for (lang, length), f in totals.items() for phrase, n in f.items() if n >= least or not length]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)], schema=_COUNTS) if rows else _COUNTS.empty_table()

    given = docs.select(_lang().cast("binary").alias("lang"), whole_text().cast("binary").alias("text"))
    packed_rows = given.mapInArrow(scan, "bucket int, lang binary, length int, phrases binary, counts binary")
    return packed_rows.groupBy("bucket").applyInArrow(summed, "lang string, length int, phrase string, n long")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, length, a, l, r, score`` of the phrases of two and more words in ``counts``, at the cut that scores least."""
    exact = lambda name: F.col(name).cast("decimal(15,0)")
    phrases = counts.where("length > 1").select("lang", "phrase", "length", F.col("n").alias("a"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda phrase, n: counts.where("length > 0").select("lang", F.col("phrase").alias(phrase), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cut = cut.withColumns({"over": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
    least = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r"))
    return cut.groupBy("lang", "phrase", "length", "a").agg(least.alias("cut")).select("lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.score")


def outermost(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """``phrases`` without those whose words lie inside a longer one that has ``inside`` percent of their occurrences at least."""
    words = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("length") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = phrases.where("length > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.expr(f"coalesce(100 * longer < {inside} * a, true)")).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (lang, text): ``lang, rank, phrase, a, l, r, n, score``."""
    counts = written(phrase_counts(docs, frequent_keys(docs, least, longest, shards), least, longest), "phrase-counts")
    best = outermost(scored(counts), inside)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # Spark keeps ``top`` rows of each task
    words = counts.where("length = 0").select("lang", "n")
    ranked = best.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
runs AS (
  SELECT lang, length, array_to_string(w[i:i + length - 1], ' ') AS phrase
  FROM (SELECT lang, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS length))),
counts AS (SELECT lang, length, phrase, count(*) AS n FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE length = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.length, c.n AS a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS rest
  FROM counts c, (SELECT unnest([1, 2]) AS k) WHERE c.length > k AND c.n >= 10),
scores AS (
  SELECT c.lang, c.phrase, c.length, c.a, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n), c.k) AS place
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM scores WHERE place = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS part FROM best WHERE length = 3
    UNION ALL SELECT lang, a, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM best WHERE length = 3) GROUP BY lang, part),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.part = b.phrase WHERE coalesce(100 * x.most < 50 * b.a, true))
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM ranked r JOIN totals t USING (lang) WHERE rank <= 2000
"""

"""Quality rules (operator 3): base counts, and the distance of a document's histograms from its language's.

The method compares two histograms of a document with the reference of its language by Jensen-Shannon distance: classes of
characters, and common words against all others. The references are learned from the rows in two steps, both over all
documents of the language (``lang``; each value is a language, null too): sums over those that pass the base rules, then
sums over those of them that lie near the first sums. A histogram is compared only where the document is long enough for it to mean something; a shorter one passes.

Only DataFrame functions; one pass over the texts writes a small table of counts, which the references and the verdicts are
made from. Nothing is grouped but by language, in partial sums, so a hot language or source costs nothing more.

Repeated windows: the five-word windows of a text are hashed to 64 bits in place. Only in texts where a hash repeats are
hashes sorted with their positions; the words covered are the sum of the gaps between covered positions, five at most.

Defined results: null and empty texts have zero counts and fail the base rules; repeated rows are judged each; ties don't
occur; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, whole_text
from tidemark.session import written

SYMBOLS = "#*$%&|<>"
#: Frequent words by language: fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "for", "it", "with", "as", "be", "on", "by", "this", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
}
#: Classes of characters; all others are the last class.
CLASSES = ["a-z0-9", "A-Z", ".,;:@'\"()+-", "!?", "#*$%&~^=", "|<>_/{}", "\\x20\\x09-\\x0D"]
MIN_CHARS, MIN_WORDS = 100, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.16, 0.4


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` names it often or in loops."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(sorted_: Column) -> Column:
            same = lambda x, i, step: F.coalesce(F.get(sorted_, i + step)["h"] == x["h"], F.lit(False))
            marked = F.transform(sorted_, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"]))
            places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
            gaps = lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(window)), F.lit(window))), F.lit(0), lambda a, g: a + g
            )
            return _let(places, gaps)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, again))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(_let(hashes, covered)).cast("long")


def _counts_of(words: Column, common: list[str]) -> Column:
    """How often each of ``common`` stands in the array, and the count of all other words."""

    def counts(found: Column) -> Column:
        each = [(F.size(found) - F.size(F.array_remove(found, F.lit(w)))).cast("long") for w in common]
        return F.array(*each, (F.size(words) - F.size(found)).cast("long"))

    return _let(F.filter(words, lambda w: w.isin(common)), counts)


def _common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words and of all others; null for a language without a list."""
    counts = F.lit(None).cast("array<long>")
    for name, common in COMMON.items():
        counts = F.when(lang == name, _counts_of(words, common)).otherwise(counts)
    return counts


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, lang``, the base counts and both histograms of every row of ``docs`` (doc_id, text, lang)."""
    text = whole_text()
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    blank = F.length(text) - F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""))
    of_words = _let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words")),
    )
    of_lower = _let(F.regexp_extract_all(lower, F.lit("([^\\x00-\\x60\\x7B-\\x7F]+)"), F.lit(1)), lambda words: _common_counts(words, F.col("lang")))
    of_class = [F.length(F.regexp_replace(text, f"[^{c}]+", "")).cast("long") for c in CLASSES]
    chars = _let(F.array(*of_class, F.length(text).cast("long")), lambda n: F.concat(F.slice(n, 1, len(CLASSES)), F.array(F.get(n, F.lit(len(CLASSES))) - _total(F.slice(n, 1, len(CLASSES)), "long"))))
    return docs.select(
        "doc_id", "lang", (F.length(text) - blank).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        of_words.alias("of_words"), chars.alias("chars"), of_lower.alias("common"),
    ).select("doc_id", "lang", "word_chars", "n_symbols", "n_dup_lines", "of_words.*", "chars", "common")


def _total(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two arrays of counts; null where either is null
    or sums to nothing."""
    p_log = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    p, q = F.transform(counts, lambda x: x / _total(counts)), F.transform(reference, lambda x: x / _total(reference))
    parts = F.zip_with(p, q, lambda a, b: p_log(a, (a + b) / 2) + p_log(b, (a + b) / 2))
    return F.when((_total(counts) > 0) & (_total(reference) > 0), F.sqrt(F.greatest(F.lit(0.0), _total(parts) / 2)))


def references(counts: DataFrame) -> DataFrame:
    """The histograms of each language, summed over its documents in ``counts``."""
    n_common = max(len(words) for words in COMMON.values()) + 1
    sums = counts.groupBy("__lang").agg(
        F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("ref_chars"),
        F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(n_common)]).alias("ref_common"),
    )
    return sums.withColumn("ref_common", F.filter("ref_common", lambda x: x.isNotNull()))


def _measured(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds both distances, null where a document is too short or its language has no reference."""
    return counts.join(refs, "__lang", "left").select(
        counts["*"],
        F.when(_total(F.col("chars")) >= MIN_CHARS, jensen_shannon(F.col("chars"), F.col("ref_chars"))).alias("char_distance"),
        F.when(_total(F.col("common")) >= MIN_WORDS, jensen_shannon(F.col("common"), F.col("ref_common"))).alias("word_distance"),
    )


def _near() -> Column:
    return (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words``, the base counts, ``base_failed``, both distances and ``kept`` of every row of ``docs``."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = written(
        counted(docs).withColumns({"base_failed": base_failed, "__lang": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))}).drop("lang"),
        "quality-counts",
    )
    sound = counts.where(~F.col("base_failed"))
    rough = written(references(sound), "quality-references")
    refs = written(references(_measured(sound, rough).where(_near())), "quality-references")
    return _measured(counts, refs).withColumn("kept", ~F.col("base_failed") & _near()).drop("__lang", "chars", "common")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _sql_histograms() -> tuple[str, str]:
    """SQL for both histograms of the twin: counts by class, and of common words by language."""
    chars = ", ".join(f"length(regexp_replace(text, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in CLASSES)
    common = " ".join(
        f"WHEN lang = '{name}' THEN [{', '.join(f'len(list_filter(lw, lambda x: x = {chr(39)}{w}{chr(39)}))' for w in words)}, "
        f"len(list_filter(lw, lambda x: x NOT IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in words)})))]"
        for name, words in COMMON.items()
    )
    return f"[{chars}]", f"CASE {common} END"


def _sql_distance(counts: str, reference: str) -> str:
    p, q = f"list_transform({counts}, lambda x: x / list_sum({counts}))", f"list_transform({reference}, lambda x: x / list_sum({reference}))"
    parts = f"list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)"
    return f"CASE WHEN list_sum({counts}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(0, list_sum({parts}) / 2)) END"


def _sql() -> str:
    chars, common = _sql_histograms()
    sums = lambda c, n: f"list_filter([{', '.join(f'CAST(sum({c}[{i + 1}]) AS DOUBLE)' for i in range(n))}], lambda x: x IS NOT NULL)"
    refs = f"{sums('chars', len(CLASSES) + 1)} AS ref_chars, {sums('common', max(map(len, COMMON.values())) + 1)} AS ref_common"
    measured = f"""CASE WHEN list_sum(chars) >= {MIN_CHARS} THEN {_sql_distance('chars', 'ref_chars')} END AS char_distance,
    CASE WHEN list_sum(common) >= {MIN_WORDS} THEN {_sql_distance('common', 'ref_common')} END AS word_distance"""
    near = f"coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE}"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS lw,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM texts)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, sum(least(5, coalesce(next - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM again) GROUP BY r),
counted AS (
  SELECT doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, list_append({chars}, length(text) - list_sum({chars})) AS chars, {common} AS common
  FROM texts LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
rough AS (SELECT lang, {refs} FROM based WHERE NOT base_failed GROUP BY lang),
refs AS (
  SELECT lang, {refs} FROM (SELECT b.*, {measured} FROM based b JOIN rough r ON b.lang IS NOT DISTINCT FROM r.lang WHERE NOT base_failed) WHERE {near} GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {near} AS kept
FROM (SELECT b.*, {measured} FROM based b LEFT JOIN refs r ON b.lang IS NOT DISTINCT FROM r.lang)
"""


SQL = _sql()

"""Mixing sources to target weights (operator 2).

Each source gets a share of all words by weight; a source is repeated at most ``cap`` times, and what it can't give is
shared among the others by weight. Which documents are taken is decided by a random order within each source: a hash of
the id is the key, the key space of a source is cut into equal ranges, words are summed within each range and over the
ranges before it, and the source is cut where its budget ends. Whole epochs come first, the rest is cut from the next one.

Only DataFrame functions. Hot sources: the ranges of a source number the square root of its rows, so that neither the
rows of a range nor the ranges of a source ever meet in one task in more than about that number.

Defined results: null text has no words and takes none; a null source is a source of its own, ordered last; null ids are
ordered as an empty id; repeated rows count each; documents of equal key are ordered by id and size; empty tables give
empty results; other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text, word_count
from tidemark.session import written


def _source_key(source: Column) -> Column:
    """Text that differs for null and for every source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def rotating_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``weight`` per source: the given numbers in turn, by code point of the source, null last. One row per source, so a
    single ordered pass; pass your own weights to ``source_targets`` where sources are many."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(w) for w in weights])
    return sources.withColumn("weight", F.element_at(turn, (place % len(weights) + 1).cast("int")).cast("long"))


def source_targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight).

    Targets are ``level * weight``, at most ``cap * source_size``, and add up to all words. Sources that meet their cap
    first (least ``cap * size / weight``) leave the level of the others higher; the level that holds is the first one that
    the next source in that order can take.
    """
    ordered = Window.orderBy("__full_at", F.col("source").asc_nulls_last())
    rows_before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows_from = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        sources.withColumn("__full_at", cap * F.col("source_size") / F.col("weight"))
        .withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(rows_before), F.lit(0)))
        .withColumn("__level", F.col("__left") / F.sum("weight").over(rows_from))
        .withColumn("__place", F.row_number().over(ordered))
    )
    holds = F.when(F.col("__level") <= F.col("__full_at"), F.struct("__place", "__level"))
    level = F.min(holds).over(everything)["__level"]
    return levels.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))).drop(
        "__full_at", "__left", "__level", "__place"
    )


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _piece(order: Column, pieces: Column) -> Column:
    """Which of ``pieces`` equal ranges of the key space a key falls into."""
    return F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * pieces, 32)


def mix(docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, seed: str = "mix", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source, any others; of these ``carry``) as the struct ``row``, with ``size``, ``source_size``,
    ``target`` and ``taken`` (words that the mix takes of it, all epochs together).

    ``weights``: rows of (source, weight); sources without a row weigh nothing. Without it, weights rotate.
    """
    sizes = written(docs.select("doc_id", "source", word_count(whole_text()).alias("size")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    if weights is None:
        weighted = rotating_weights(sources)
    else:
        given = weights.select(_source_key(F.col("source")).alias("__key"), F.col("weight").cast("long").alias("weight")).dropDuplicates(["__key"])
        weighted = sources.withColumn("__key", _source_key(F.col("source"))).join(given, "__key").drop("__key")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = written(
        source_targets(weighted, cap).select(
            _source_key(F.col("source")).alias("__key"), F.col("source_size"), F.col("target"),
            F.ceil(F.sqrt("__rows")).cast("long").alias("__pieces"),
            F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) div source_size")).otherwise(0).alias("__epochs"),
            F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("__rest"),
        ),
        "mix-plan",
    )
    keyed = (
        docs.select(
            F.struct(*carry).alias("row"), F.col("doc_id").alias("__id"), word_count(whole_text()).alias("size"),
            _source_key(F.col("source")).alias("__key"), _order(F.col("doc_id"), seed).alias("__order"),
        )
        .join(plan, "__key")
        .withColumn("__piece", _piece(F.col("__order"), F.col("__pieces")))
    )
    pieces = (
        sizes.select("size", _source_key(F.col("source")).alias("__key"), _order(F.col("doc_id"), seed).alias("__order"))
        .join(plan.select("__key", "__pieces"), "__key")
        .groupBy("__key", _piece(F.col("__order"), F.col("__pieces")).alias("__piece"))
        .agg(F.sum("size").alias("__words"))
    )
    earlier = Window.partitionBy("__key").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("__key", "__piece", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__key", "__piece").orderBy("__order", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["__key", "__piece"])
    left = F.col("__rest") - F.col("__offset") - F.col("__before")
    taken = F.col("__epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), left))
    return placed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix, columns as given, one row for each epoch that takes of a document.

    Documents stay whole: the one that a budget cuts is given in full, so that a source exceeds its target by less than a
    document. Documents without words can't be taken.
    """
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    chosen = mix(docs, weights, cap, seed).where(F.col("taken") > 0).select("row", copies.alias("__copies"))
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=("doc_id",)).select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER o AS place, 3 * source_size / weight AS full_at,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, place) FROM levels WHERE level <= full_at) * weight) AS target FROM levels),
budgets AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

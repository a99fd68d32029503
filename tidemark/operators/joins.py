"""Join shapes used by the star schema and the enrichment steps.

No join here carries a broadcast hint: Spark broadcasts a side only when its own size estimate, or the measured size
at run time, is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles and splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import latest_per_key, ties_at_top


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Join a fact to dimensions given as (dimension, fact key, dimension key, how)."""
    for dimension, fact_key, dim_key, how in dimensions:
        fact = fact.join(dimension, fact[fact_key] == dimension[dim_key], how).drop(dimension[dim_key])
    return fact


def in_role(dimension: DataFrame, prefix: str) -> DataFrame:
    """The same dimension under other column names, so that one fact can use it twice."""
    return dimension.select(*[F.col(c).alias(prefix + c) for c in dimension.columns])


def lookup_key(df: DataFrame, dimension: DataFrame, text: str, label: str, key: str, ignore_case: bool = False) -> DataFrame:
    """Add the surrogate key whose label equals the text; unmatched rows get NULL."""
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    labels = dimension.select(norm(F.col(label)).alias("_label"), key)
    return df.join(labels, norm(df[text]) == labels["_label"], "left").drop("_label")


def enrich(df: DataFrame, reference: DataFrame, code: Column, reference_code: str, fields: Sequence[str]) -> DataFrame:
    """Left join of reference fields on a normalised code."""
    side = reference.select(F.col(reference_code).alias("_code"), *fields)
    return df.withColumn("_wanted", code).join(side, F.col("_wanted") == F.col("_code"), "left").drop("_wanted", "_code")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent; a NULL key is an orphan."""
    keys = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return children.join(keys, children[child_key] == keys["_parent"], "left_anti")


def with_default(df: DataFrame, reference: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """Left join one reference value with a default where it is missing."""
    return df.join(reference.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), default))


def latest_with_ties(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows whose time is the greatest of their key; ties are kept."""
    return ties_at_top(df, [key], [F.col(ts).desc()])


def align_counts(baseline: DataFrame, current: DataFrame, category: str) -> DataFrame:
    """Counts of a category on both sides, 0 where a side lacks it, NULL as a category of its own."""
    both = baseline.select(category, F.lit(1).alias("_b"), F.lit(0).alias("_c")).unionByName(
        current.select(category, F.lit(0).alias("_b"), F.lit(1).alias("_c"))
    )
    return both.groupBy(category).agg(F.sum("_b").alias("baseline_count"), F.sum("_c").alias("current_count"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def union_newest(frames: Mapping[int, DataFrame], key: str, newest: str) -> DataFrame:
    """Union of frames by source priority (lower wins), one row per key, newest first."""
    tagged = [df.withColumn("_source", F.lit(priority)) for priority, df in frames.items()]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    kept = latest_per_key(merged, [key], [F.col("_source"), F.col(newest).desc_nulls_last()])
    return kept.drop("_source").orderBy(F.col(newest).desc_nulls_last(), key)

"""Group summaries: rates, volumes, spreads, pivots and shares.

Quantiles here use ``percentile`` because the measures have small whole-number or four-decimal domains (days of stay,
scores), so its value-to-count state stays bounded. Open domains use ``ranks.exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col


def exact(c: Column | str) -> Column:
    """A measure as decimal, so that sums and means do not depend on the order of addition."""
    return col(c).cast("decimal(18,4)")


def rounded_mean(c: Column | str, places: int) -> Column:
    return F.round(F.avg(exact(c)), places)


def share(flag: Column | str, places: int = 4, scale: int = 1) -> Column:
    return F.round(F.avg(exact(col(flag).cast("int"))) * scale, places)


def flag_sum(flag: Column | str) -> Column:
    return F.sum(col(flag).cast("int"))


def month_trend(df: DataFrame, date: str, flag: str) -> DataFrame:
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(
        share(flag).alias("readmission_rate"), F.count(F.lit(1)).alias("total_admissions")
    )


def leaderboard(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Rate and volume per group, highest rate first."""
    return (
        df.groupBy(group)
        .agg(share(flag).alias("readmission_rate"), F.count(F.lit(1)).alias("total_admissions"))
        .orderBy(F.desc("readmission_rate"), group)
    )


def rate_and_volume(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Percent rate (one decimal) and row count per category, highest first."""
    return (
        df.groupBy(group)
        .agg(share(flag, 1, 100).alias("rate_pct"), F.count(F.lit(1)).alias("volume"))
        .orderBy(F.desc("rate_pct"), group)
    )


def mean_by(df: DataFrame, group: str, value: str, name: str = "mean_value") -> DataFrame:
    return df.groupBy(group).agg(F.avg(exact(value)).alias(name)).orderBy(F.desc(name), group)


def rollup_series(df: DataFrame, period: str, rate: str, volume: str) -> DataFrame:
    """All groups together per period: plain mean of the rates, volume-weighted rate, total volume."""
    return df.groupBy(period).agg(
        F.avg(exact(rate)).alias("mean_rate"),
        (F.sum(exact(rate) * col(volume)) / F.sum(volume)).alias("weighted_rate"),
        F.sum(volume).alias("total_volume"),
    )


def counts_in_order(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Row count per label in a fixed order; listed labels without rows count 0."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"{label} string, position int")
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, label, "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("position")


def conditional_counts(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """One row: count per listed value and in total."""
    return df.agg(
        *[F.count_if(F.col(label) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total")
    )


def group_profile(df: DataFrame, keys: Sequence[str], means: dict[str, tuple[Column | str, int]]) -> DataFrame:
    """Size, share of all rows and rounded means per group; the total is a one-row count used as a scalar."""
    sized = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), *[rounded_mean(c, p).alias(name) for name, (c, p) in means.items()]
    )
    whole = df.agg(F.count(F.lit(1)).alias("whole")).scalar()
    return sized.withColumn(
        "size_pct", F.round(F.col("size").cast("decimal(20,0)") / whole.cast("decimal(20,0)"), 4)
    )


def mode_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per group and column, the smallest one on ties."""
    return df.groupBy(group).agg(*[F.mode(F.col(c), True).alias(f"dominant_{c}") for c in columns])


def pivot_series(df: DataFrame, period: str, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Periods as rows and the given groups as columns."""
    return df.groupBy(period).pivot(group, list(groups)).agg(F.first(value, ignorenulls=True))


def measure_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str], score: str | None = None) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each measure, and mean and maximum of a score, per key."""
    aggregates = []
    for m in measures:
        aggregates += [
            F.avg(exact(m)).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    if score:
        aggregates += [F.avg(exact(score)).alias(f"{score}_mean"), F.max(score).alias(f"{score}_max")]
    return df.groupBy(*keys).agg(*aggregates)


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def label_correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with a 0/1 label over rows complete in all of them, ascending."""
    complete = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias(label)).dropna()
    one = complete.agg(*[F.corr(f, label).alias(f) for f in features])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features]))
    ).orderBy("correlation")


def score_buckets(df: DataFrame, score: str, bands: Sequence[tuple[float, str]], lowest: str) -> DataFrame:
    """Row count per severity bucket of a score."""
    label = F
    for edge, name in bands:
        label = label.when(F.col(score) >= edge, name)
    return df.groupBy(label.otherwise(lowest).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def report_summary(df: DataFrame, score: str, tier: str, group: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("patients"),
        F.count_if(F.col(tier) == "critical").alias("critical"),
        F.count_if(F.col(tier) == "high").alias("high"),
        F.round(F.avg(exact(score)) * 100, 1).alias("mean_score_pct"),
        F.countDistinct(group).alias("departments"),
    )

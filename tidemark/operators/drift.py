"""Population stability of scores and features between two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import exact_quantiles, join_on

# Floors and limits.
EMPTY_SHARE = 1e-6
PSI_WARN, PSI_CRITICAL = 0.10, 0.20
LEAST_VALUES = 10


def population_stability(
    baseline: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 10, pieces: int | None = None
) -> DataFrame:
    """PSI per key over the baseline's quantile bins.

    A value falls into the bin numbered by the inner edges at or below it, so repeated edges of a skewed baseline give
    empty bins, as a histogram does. Both periods are counted together: one row per key and bin, then one per key.
    """
    keys = list(keys)
    both = baseline.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_b")).unionByName(
        current.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_b"))
    ).filter(F.col("_v").isNotNull())
    base = baseline.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    inner = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(base, "_v", inner, keys, pieces, name="_edges")
    if keys:
        placed = join_on(both, edges.drop("n"), keys)
    else:
        placed = both.withColumn("_edges", edges.select("_edges").scalar())
    bin_ = F.size(F.filter("_edges", lambda e: e <= F.col("_v")))
    is_base = F.col("_b") == 1
    counted = placed.groupBy(*keys, bin_.alias("_bin")).agg(
        F.count_if(is_base).alias("_nb"), F.count_if(~is_base).alias("_nc"),
        F.sum(F.when(is_base, F.col("_v"))).alias("_sb"), F.sum(F.when(~is_base, F.col("_v"))).alias("_sc"),
    )
    table = counted.groupBy(*keys).agg(
        F.sum("_nb").alias("baseline_rows"), F.sum("_nc").alias("current_rows"),
        F.sum("_sb").alias("_sb"), F.sum("_sc").alias("_sc"), F.collect_list(F.struct("_nb", "_nc")).alias("_bins"),
    )
    share = lambda n, total: F.when(n == 0, F.lit(EMPTY_SHARE)).otherwise(n / F.greatest(total, F.lit(1)))
    parts = F.transform(
        "_bins",
        lambda x: (share(x["_nc"], F.col("current_rows")) - share(x["_nb"], F.col("baseline_rows")))
        * F.ln(share(x["_nc"], F.col("current_rows")) / share(x["_nb"], F.col("baseline_rows"))),
    )
    psi = F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, x: a + x)
    return table.select(
        *keys, psi.alias("psi"), (F.col("_sb") / F.col("baseline_rows")).alias("baseline_mean"),
        (F.col("_sc") / F.nullif(F.col("current_rows"), F.lit(0))).alias("current_mean"), "baseline_rows", "current_rows",
    )


def _severity(psi):
    return F.when(psi > PSI_CRITICAL, "critical").when(psi > PSI_WARN, "warning").otherwise("ok")


def prediction_drift(baseline: DataFrame, current: DataFrame, score: str, pieces: int | None = None) -> DataFrame:
    found = population_stability(baseline, current, score, pieces=pieces)
    return found.select(
        F.lit("prediction_psi").alias("check_name"), F.round("psi", 4).alias("psi"), F.round("baseline_mean", 4).alias("baseline_mean_risk"),
        F.round("current_mean", 4).alias("current_mean_risk"), _severity(F.col("psi")).alias("status"),
    )


def feature_drift(baseline: DataFrame, current: DataFrame, features: Sequence[str], least: int = LEAST_VALUES, pieces: int | None = None) -> DataFrame:
    """PSI of every feature present on both sides with enough values, all in one pass over the two periods."""
    shared = [f for f in features if f in baseline.columns and f in current.columns]

    def tall(df: DataFrame) -> DataFrame:
        items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in shared]
        return df.select(F.inline(F.array(*items)))

    found = population_stability(tall(baseline), tall(current), "value", ["feature"], pieces=pieces)
    return found.filter((F.col("baseline_rows") >= least) & (F.col("current_rows") >= least)).select(
        F.lit("feature_psi").alias("check_name"), "feature", F.round("psi", 4).alias("psi"), F.round("baseline_mean", 3).alias("baseline_mean"),
        F.round("current_mean", 3).alias("current_mean"), _severity(F.col("psi")).alias("status"),
    )


def week_slices(df: DataFrame, date: str, week_start: str, weeks: int = 12) -> tuple[DataFrame, DataFrame]:
    """Baseline of the weeks up to one week before the start, and the current week, whole."""
    day, start = F.to_date(date), F.lit(week_start).cast("date")
    end = F.date_sub(start, 7)
    baseline = df.filter((day >= F.date_sub(end, 7 * weeks)) & (day <= end))
    return baseline, df.filter((day >= start) & (day <= F.date_add(start, 6)))

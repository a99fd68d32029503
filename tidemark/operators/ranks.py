"""Ordered computations that must not pull one key, or the whole table, into a single task.

The common trick: first fold rows to one row per distinct value (or per time chunk), then order only those, in
pieces, and carry the totals of the earlier pieces forward through a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col
from tidemark.session import written

def join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-NULL keys, keeping the left key columns only."""
    other = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(other, condition, how).drop(*[f"_right_{n}" for n in names])


def _cut_into_pieces(level: DataFrame, df: DataFrame, order: str, keys: Sequence[str], pieces: int) -> DataFrame:
    """Number the value range of every key. The split points are approximate quantiles; they are written once, as a small
    table with one row per key, so that recomputed tasks agree on them."""
    shares = [i / pieces for i in range(1, pieces)]
    number = df.select(*keys, F.col(order).cast("double").alias("_value"))
    edges = written(number.groupBy(*keys).agg(F.percentile_approx("_value", shares, max(1000, 10 * pieces)).alias("_edges")), "split-points")
    cut = join_on(level, edges, keys, "left") if keys else level.withColumn("_edges", edges.scalar())
    piece = F.size(F.array_distinct(F.filter("_edges", lambda e: e <= F.col(order).cast("double"))))
    return cut.withColumn("_piece", F.coalesce(piece, F.lit(0))).drop("_edges")


def running_totals(
    df: DataFrame, order: str, sums: Mapping[str, Column], keys: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """One row per key and distinct ``order`` value with each sum and its running total ``<name>_upto``.

    ``pieces`` split points (from one summary pass; as many as the session has shuffle partitions, 32 at least, unless
    given) cut the value range so that the ordered step runs in many tasks. ``pieces=1`` skips that for value domains known
    to be small.
    """
    keys = list(keys)
    pieces = pieces or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.filter(F.col(order).isNotNull())
    level = df.groupBy(*keys, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if pieces <= 1:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return level.withColumns({f"{n}_upto": F.sum(n).over(upto) for n in sums})
    cut = _cut_into_pieces(level, df, order, keys, pieces)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_piece")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(*keys, "_piece", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_carried_{n}") for n in sums])
    )
    within = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_local_{n}": F.sum(n).over(within) for n in sums})
    return join_on(local, carried, [*keys, "_piece"]).select(
        *keys,
        order,
        *sums,
        *[(F.col(f"_local_{n}") + F.col(f"_carried_{n}")).alias(f"{n}_upto") for n in sums],
    )


def exact_quantiles(
    df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), pieces: int | None = None,
    name: str = "quantiles",
) -> DataFrame:
    """Interpolated quantiles per key as an array, exact on an open value domain, without gathering a group."""
    keys = list(keys)
    ranked = running_totals(df, value, {"n": F.lit(1)}, keys, pieces)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(value).alias("_total"))
        sized = join_on(ranked, sizes, keys)
    else:
        sized = ranked.withColumn("_total", df.agg(F.count(value).alias("m")).scalar())
    picks = []
    for i, share in enumerate(shares):
        position = F.lit(float(share)) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("n_upto") > F.floor(position), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("n_upto") > F.ceil(position), F.col(value))).alias(f"_hi{i}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_w{i}"))
    picked = sized.groupBy(*keys).agg(F.max("_total").alias("_size"), *picks)
    parts = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).cast("double")
        for i in range(len(shares))
    ]
    return picked.select(*keys, F.col("_size").alias("n"), F.array(*parts).alias(name))


def chunked_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Column,
    prefix: str = "previous_",
) -> DataFrame:
    """The previous row's values within a key, ordering only within time chunks of a key.

    The last row of every chunk is carried to the next chunk that exists, so a key that holds a large share of all
    rows is spread over as many tasks as it has chunks.
    """
    keys, order = list(keys), list(order)
    rank, payload = F.struct(*order), F.struct(*values)
    cut = df.withColumn("_chunk", chunk)
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(payload, rank).alias("_end"))
    carried = ends.select(
        *keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = cut.withColumns({"_local": F.lag(payload).over(within), "_first": F.row_number().over(within) == 1})
    previous = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_local"))
    return join_on(local, carried, [*keys, "_chunk"], "left").select(
        *df.columns, *[previous[v].alias(prefix + v) for v in values]
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order; the plan limits each key before the shuffle."""
    return top_per_group(df, keys, order, 1).drop("position")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key with their ``position``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)


def ties_at_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that share the first place of their key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.rank().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def best_row(df: DataFrame, keys: Sequence[str], by: Column | str, values: Sequence[str]) -> DataFrame:
    """Values of the row with the greatest ``by`` per key, as one partial aggregate."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), col(by)).alias("_best")).select(
        *keys, *[F.col(f"_best.{v}").alias(v) for v in values]
    )

"""A two-dimensional layout that keeps neighbours together, where no linear projection can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.neighbours import nearest_rows
from tidemark.session import discard, written

NEIGHBOURS, ROUNDS = 10, 30


def neighbour_graph(rows: DataFrame, key: str, vector: str, n: int = NEIGHBOURS) -> DataFrame:
    """``a, b`` in both directions: each row and its nearest ``n`` others."""
    found = nearest_rows(rows, rows.select(key, vector), key, vector, n).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _settled(state: DataFrame) -> DataFrame:
    """Both coordinates with mean 0, the second without its share of the first, both of length 1, rows weighted by degree."""
    w = F.col("degree")
    mean = state.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xy"]).first()
    centred = state.withColumns({c: F.col(c) - F.lit(mean[c] or 0.0) for c in "xy"})
    sums = centred.agg(F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("x") * F.col("y")).alias("xy"), F.sum(w * F.col("y") * F.col("y")).alias("yy")).first()
    xx, xy, yy = (sums[c] or 0.0 for c in ("xx", "xy", "yy"))
    share = xy / xx if xx else 0.0
    left = max(yy - share * xy, 0.0)
    x = F.col("x") / F.lit(xx**0.5 if xx else 1.0)
    return centred.withColumns({"x": x, "y": (F.col("y") - F.lit(share) * F.col("x")) / F.lit(left**0.5 if left else 1.0)})


def spectral_layout(rows: DataFrame, key: str, vector: str, n: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """``key, x, y`` for every row with a key and vector: the slowest two movements of a walk over the neighbour graph.

    Power iteration: a row moves to the mean of its neighbours and itself, then the trivial movement and, for ``y``, the first
    one are taken out. Starts are hashes of the key, so a layout is the same on every run. Each round is one join and one
    aggregation, written so that lost executors cost a round; seven numbers a round go to the driver.
    """
    edges = written(neighbour_graph(rows, key, vector, n), "neighbour-graph")
    degrees = edges.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("degree"))  # a row counts among its neighbours
    start = lambda seed: F.xxhash64(F.col("a").cast("string"), F.lit(seed)) / F.lit(2.0**63)
    state = written(degrees.select("a", "degree", start(1).alias("x"), start(2).alias("y")), "layout")
    for _ in range(rounds):
        settled = _settled(state)
        means = edges.join(settled.select(F.col("a").alias("b"), "x", "y"), "b").groupBy("a").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        moved = settled.join(means, "a").select("a", "degree", *[((F.col(c) + F.col(f"s{c}")) / F.col("degree")).alias(c) for c in "xy"])
        earlier, state = state, written(moved, "layout")
        discard(earlier)
    placed = written(_settled(state).select(F.col("a").alias(key), "x", "y"), "layout")
    discard(state)
    return placed

"""Connected components of a graph given by its edges, as repeated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def _least_neighbour(edges: DataFrame, small: bool) -> DataFrame:
    """Edges from the neighbours of each node to the least of them: the greater neighbours (``small``: the others and the
    node itself). A hub's neighbours never meet in one task: the least one is a partial minimum, joined back."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.where("b < a") if small else both
    least = seen.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    moved = (seen if small else both.where("b > a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if small:
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the root is the least node of its component, itself included.

    Alternates two steps, each a star around the least neighbour, until nothing changes; every round is written, so that
    the plan stays short and lost executors cost one round. Loops and repeated edges do no harm; without edges there are no
    rows.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now.n, now.x) == state:
            break
        state = (now.n, now.x)
        edges = written(_least_neighbour(_least_neighbour(edges, small=False), small=True), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

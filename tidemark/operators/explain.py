"""Contributions of features to the scores of boosted trees: exact Shapley values along the paths of the trees.

A fitted model is read as a node table. Every leaf asks, for each feature on its path, whether a row lies within the
feature's interval; with ``z`` the share of training weight that follows the path at the feature's splits, the leaf gives each
feature the average, over all orders of the path's features, of what is gained when the feature's answer becomes known.
Leaves under one node share their path down to it, so their sums are looked up together: the answers of that path and the
sides taken at the few nodes below make a bit pattern, which a row's bins give.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Levels of splits below a node whose leaves are looked up together, leaves whose gains are found at a time, rows explained at a time.
LEVELS, LOT, CHUNK = 2, 256, 4000

#: A tree: arrays by node of feature (-1: a leaf), threshold, value in log odds, cover, left and right child; node 0 is the root.
Tree = dict[str, np.ndarray]


@dataclass
class Leaf:
    """``value`` in log odds; for each feature of the path its interval (above ``low``, up to ``high``) and share ``z``; the nodes of the path
    with the side taken (1: right)."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    z: list[float]
    path: list[tuple[int, int]]


def gains(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """What each feature (last axis) adds at each leaf (first axis) for each pattern of answers, bit j for the j-th feature."""
    d = shares.shape[1]
    known = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    gained = np.zeros((len(values), 1 << d, d))
    for j in range(d):
        sums = np.zeros((len(values), 1 << d, d))  # by number of known other features
        sums[..., 0] = 1
        for k in range(d):
            if k != j:
                more = np.zeros_like(sums)
                more[..., 1:] = sums[..., :-1] * known[:, k : k + 1]
                sums = sums * shares[:, None, k : k + 1] + more
        orders = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
        gained[..., j] = values[:, None] * (known[:, j] - shares[:, j : j + 1]) * (sums @ orders)
    return gained


def node_table(model: PipelineModel) -> DataFrame:
    """One row per node of a fitted boosted classifier: ``tree, weight, id, value, cover, feature, threshold, left, right``; leaves have no
    children. The rows are bounded by the learner's settings: trees times 2 to the depth plus 1."""
    spark = SparkSession.active()
    path = shared_folder(spark, "boosted-model")
    model.stages[-1].write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return nodes.join(weights, "tree").select(
        "tree", "weight", "id", F.col("prediction").alias("value"), F.col("impurityStats")[0].alias("cover"),
        F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).alias("feature"),
        F.when(F.col("leftChild") >= 0, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), (F.col("split.numCategories") >= 0).alias("is_category"),
    )


def trees_of(nodes: pd.DataFrame) -> list[Tree]:
    """The trees of a node table; a value is its share of the log odds, twice the weighted prediction."""
    if (nodes["is_category"] & nodes["left"].ge(0)).any():
        raise ValueError("splits by category have no interval")
    found = []
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("id")  # the root has the least
        at = {-1: -1} | {n: i for i, n in enumerate(tree["id"])}
        left, right = (np.array([at[max(c, -1)] for c in tree[side]]) for side in ("left", "right"))
        feature = np.where(left >= 0, tree["feature"].fillna(-1), -1).astype(int)
        value = (2 * tree["weight"] * tree["value"]).to_numpy(dtype=float)
        found.append({"feature": feature, "threshold": tree["threshold"].to_numpy(dtype=float), "value": value, "cover": tree["cover"].to_numpy(dtype=float), "left": left, "right": right})
    return found


def _leaves(tree: Tree) -> list[Leaf]:
    found, ahead = [], [(0, {}, [])]
    while ahead:
        at, known, path = ahead.pop()
        feature = int(tree["feature"][at])
        if feature < 0:
            low, high, z = map(list, zip(*known.values())) if known else ([], [], [])
            found.append(Leaf(float(tree["value"][at]), list(known), low, high, z, path))
            continue
        low, high, z = known.get(feature, (-np.inf, np.inf, 1.0))
        split = float(tree["threshold"][at])
        left, right = int(tree["left"][at]), int(tree["right"][at])
        share = [tree["cover"][child] / tree["cover"][at] for child in (left, right)]
        ahead.append((left, {**known, feature: (low, min(high, split), z * share[0])}, [*path, (at, 0)]))
        ahead.append((right, {**known, feature: (max(low, split), high, z * share[1])}, [*path, (at, 1)]))
    return found


def leaves_of(nodes: pd.DataFrame) -> list[Leaf]:
    """The leaves of all trees of a node table."""
    return [leaf for tree in trees_of(nodes) for leaf in _leaves(tree)]


def base_value(leaves: Sequence[Leaf]) -> float:
    """Log odds when nothing is known of a row."""
    return float(sum(leaf.value * np.prod(leaf.z) for leaf in leaves))


@dataclass
class Lookup:
    """Of a tree: for each of its features the pattern bits that a bin sets (bins by lookups), and for each lookup the sums by pattern of the
    log odds and of the features' parts (``rows`` of the result)."""

    bits: dict[int, np.ndarray]
    rows: list[int]
    sums: list[np.ndarray]


def split_points(trees: Sequence[Tree], features: int) -> list[np.ndarray]:
    """The thresholds of each feature, ascending; a value's bin is how many of them lie below it."""
    return [np.unique(np.concatenate([t["threshold"][t["feature"] == f] for t in trees])) for f in range(features)]


def lookups_of(trees: Sequence[Tree], points: Sequence[np.ndarray]) -> list[Lookup]:
    """The lookups of all trees; their number and sizes are bounded by the learner's settings."""
    leaves = [_leaves(tree) for tree in trees]
    by_length = defaultdict(list)
    for leaf in (leaf for of_tree in leaves for leaf in of_tree):
        by_length[len(leaf.features)].append(leaf)
    gained = {}
    for some in by_length.values():
        for i in range(0, len(some), LOT):
            lot = some[i : i + LOT]
            found = gains(np.array([leaf.value for leaf in lot]), np.array([leaf.z for leaf in lot]).reshape(len(lot), -1))
            gained.update((id(leaf), g) for leaf, g in zip(lot, found))
    found = []
    for tree, of_tree in zip(trees, leaves):
        height = defaultdict(int)  # levels of splits from a node down
        for leaf in of_tree:
            for up, (node, _) in enumerate(reversed(leaf.path), 1):
                height[node] = max(height[node], up)
        groups = defaultdict(list)
        for leaf in of_tree:
            above = next((i for i, (node, _) in enumerate(leaf.path) if height[node] <= LEVELS), len(leaf.path))
            groups[tuple(leaf.path[:above])].append(leaf)
        features = sorted({f for leaf in of_tree for f in leaf.features})
        parts = [_sums(tree, features, path, some, gained, points) for path, some in groups.items()]
        kind = np.min_scalar_type(max(len(sums) for _, sums in parts) - 1)
        bits = {f: np.stack([of_bins[f] for of_bins, _ in parts], axis=1).astype(kind) for f in features}
        found.append(Lookup(bits, [0, *(1 + f for f in features)], [sums for _, sums in parts]))
    return found


def _sums(
    tree: Tree, features: Sequence[int], above: Sequence[tuple[int, int]], leaves: Sequence[Leaf], gained: dict[int, np.ndarray], points: Sequence[np.ndarray]
) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The bits by bin of each feature of the tree, and the sums (patterns by log odds and features), for the leaves under one node."""
    shared = list(dict.fromkeys(int(tree["feature"][node]) for node, _ in above))
    below = list(dict.fromkeys(node for leaf in leaves for node, _ in leaf.path[len(above) :]))
    bits = {f: np.zeros(len(points[f]) + 1, dtype=np.int64) for f in features}

    def right(node: int) -> np.ndarray:
        f = int(tree["feature"][node])
        return np.arange(len(bits[f])) > np.searchsorted(points[f], tree["threshold"][node])

    for j, f in enumerate(shared):
        bits[f] |= np.all([right(node) == side for node, side in above if tree["feature"][node] == f], axis=0).astype(np.int64) << j
    for j, node in enumerate(below, len(shared)):
        bits[int(tree["feature"][node])] |= right(node).astype(np.int64) << j
    pattern = np.arange(1 << (len(shared) + len(below)))
    bit = lambda j: (pattern >> j) & 1
    sums = np.zeros((len(pattern), 1 + len(features)))
    for leaf in leaves:
        answers = {f: bit(shared.index(f)) if f in shared else np.ones_like(pattern) for f in leaf.features}
        for node, side in leaf.path[len(above) :]:
            f = int(tree["feature"][node])
            answers[f] = answers[f] & (bit(len(shared) + below.index(node)) == side)
        known = sum((answers[f] << j for j, f in enumerate(leaf.features)), np.zeros_like(pattern))
        sums[:, 0] += np.where(known == (1 << len(leaf.features)) - 1, leaf.value, 0.0)
        sums[:, [1 + features.index(f) for f in leaf.features]] += gained[id(leaf)][known]
    return bits, sums


def odds_and_parts(values: np.ndarray, lookups: Sequence[Lookup], points: Sequence[np.ndarray]) -> np.ndarray:
    """Of rows of feature values (rows by features): log odds, then the contribution of each feature."""
    if np.isnan(values).any():
        raise ValueError("a feature is not a number")
    bins = [np.searchsorted(p, column, side="left") for p, column in zip(points, values.T)]
    total = np.zeros((len(values), 1 + len(points)))
    for lookup in lookups:
        of_tree, taken = np.zeros((2, len(values), len(lookup.rows)))
        patterns = np.zeros((len(values), len(lookup.sums)), dtype=np.uint8)
        for f, bits in lookup.bits.items():
            patterns = patterns + bits.take(bins[f], axis=0)
        for pattern, sums in zip(np.ascontiguousarray(patterns.T), lookup.sums):
            of_tree += sums.take(pattern, axis=0, out=taken, mode="clip")
        total[:, lookup.rows] += of_tree
    return total


def broadcast_lookups(trees: Sequence[Tree], features: int) -> Broadcast:
    """What ``contributions`` reads; made once."""
    points = split_points(trees, features)
    return SparkSession.active().sparkContext.broadcast((lookups_of(trees, points), points))


def contributions(sent: Broadcast, values: Column) -> Column:
    """An array with the log odds of an array of feature values, then the contribution of each; with the base value these add up to
    the log odds."""

    @F.pandas_udf("array<double>")
    def given(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookups, points = sent.value
        for part in vectors:
            some = [part.iloc[i : i + CHUNK].to_list() for i in range(0, len(part), CHUNK)]
            yield pd.Series([found for rows in some for found in odds_and_parts(np.stack(rows), lookups, points)], dtype=object)

    return given(values)

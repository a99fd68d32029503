"""Merkle dataset manifest (operator 13): a hash tree over the rows of each source, and one over the sources.

A row's leaf is the digest of its columns, each as ``-`` for null or as byte count, ``:`` and value. The leaves of a source
are numbered by key; ``arity`` consecutive nodes become one node of the next level, until one is left, the subroot.
Subroots, ordered by source, make a tree in the same way, up to the root. A node's digest is that of its children's digests
in hex, joined.

1. Numbering: rows are sorted by ranges of (source, key, digest, stored place), so every row's place in its range is known
   when the ranges are written; a small table, one row for each range and source, adds the rows of earlier ranges.
2. Every level is one job of sibling-shift self-joins: a node's index gives the indices of its siblings (XOR 1 in a binary
   tree, else the other slots of its run), the level is equijoined with itself under each of them, and slot-zero rows emit
   the parents. The joined level is written: nodes with the siblings before and after them.
3. Proofs: the levels are joined from the top down, child to parent, so that each path is extended once for each node and
   not once for each row and level. A row's root is folded again from its leaf and its path.

A hot source: its index is part of every join key and ranges split it, so no task holds a source. A level has a third (one
``arity``-th) of the rows of the one below; a path grows by the logarithm of the rows. The driver gets one number, the size of the largest
source.

Defined results: nulls in any column are leaves as said; a null source is a tree of its own, the first; null keys come
first; rows of equal key are ordered by digest; of wholly equal rows each has a place and a proof of its own; empty and very
long texts are hashed as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.session import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3


def digest_of(joined: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(joined, 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_digest(digests: Column) -> Column:
    """The digest of one or more digests, taken as hex text."""
    return digest_of(as_hex(digests))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row's values: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    told = [v.cast("string") for v in values]
    return digest_of(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]))


def tree_key(source: Column) -> Column:
    """Text that is ordered as the source is, null first, and differs for null and for every source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``i``, the place from 0 within the tree in ``order``, and ``n``, the rows of the tree.

    ``order`` must decide every place, so that a recomputed task sorts as the lost one did.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    stored = written(ordered.select("*", F.spark_partition_id().alias("piece"), place.alias("place")), "merkle-order")
    runs = stored.groupBy("tree", "piece").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")  # as many rows as a tree has ranges
    earlier = F.sum("rows").over(of_tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "piece", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    return stored.join(runs, ["tree", "piece"]).withColumn("i", F.col("place") + F.col("shift")).drop("piece", "place", "shift")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, n, i, digest, ...) with the digests of the siblings ``before`` and ``after`` each, joined."""
    slot = F.col("i") % arity
    wanted = {}
    for shift in range(1, arity):
        other = F.col("i").bitwiseXOR(1) if arity == 2 else F.col("i") - slot + (slot + shift) % arity
        wanted[f"at{shift}"] = other
    found = nodes.withColumns(wanted)
    for shift in range(1, arity):
        other = nodes.select(F.col("tree").alias("tree_"), F.col("i").alias("i_"), F.col("digest").alias(f"sibling{shift}"))
        found = found.join(other, (F.col("tree") == F.col("tree_")) & (F.col(f"at{shift}") == F.col("i_")), "left").drop("tree_", "i_", f"at{shift}")
    nothing = F.lit(b"")
    part = lambda shift, taken: F.when(taken, F.coalesce(F.col(f"sibling{shift}"), nothing)).otherwise(nothing)
    return found.withColumns({
        "before": F.concat(nothing, *[part(s, slot + s >= arity) for s in range(1, arity)]),
        "after": F.concat(nothing, *[part(s, slot + s < arity) for s in range(1, arity)]),
    }).drop(*[f"sibling{s}" for s in range(1, arity)])


def grown(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels and tops of the trees over ``nodes`` (tree, n, i, digest; others stay on the lowest level).

    ``levels[k]`` has the nodes of level k with their siblings, ``tops[k]`` those that are alone on level k.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, size = [], [], largest
    while size > 1:
        tops.append(nodes.where("n = 1"))
        levels.append(written(with_siblings(nodes.where("n > 1"), arity), "merkle-level"))
        parents = levels[-1].where(F.col("i") % arity == 0)
        count = F.floor((F.col("n") + (arity - 1)) / arity).cast("long")
        nodes = parents.select("tree", count.alias("n"), F.floor(F.col("i") / arity).cast("long").alias("i"), node_digest(F.concat("digest", "after")).alias("digest"))
        size = -(-size // arity)
    tops.append(nodes)
    return levels, tops


def tops_of(tops: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the node that is left of every tree."""
    return reduce(DataFrame.unionByName, [t.select("tree", "digest") for t in tops])


def with_paths(levels: list[DataFrame], tops: list[DataFrame], above: DataFrame, arity: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of the lowest level as ``tree``, ``carried`` and ``path``, an array of (before, after) up to the tree's top and on
    along ``above`` (tree, path, ...), whose other columns are added."""
    added = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for k in range(len(tops) - 1, -1, -1):
        own = ["tree", "i", *(carried if k == 0 else ())]
        alone = tops[k].select(*own).join(above, "tree")
        if paths is None:
            paths = alone
            continue
        parent = paths.select(F.col("tree").alias("tree_"), F.col("i").alias("i_"), "path", *added)
        step = F.array(F.struct("before", "after"))
        level = levels[k].join(parent, (F.col("tree") == F.col("tree_")) & (F.floor(F.col("i") / arity).cast("long") == F.col("i_")))
        extended = level.select(*own, F.concat(step, F.col("path")).alias("path"), *added)
        paths = extended.unionByName(alone.select(*own, "path", *added))
    return paths.drop("i")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, step: node_digest(F.concat(step["before"], digest, step["after"])))


def proof_digest(path: Column) -> Column:
    """One digest, in hex, of all siblings of a path, from the leaf's up to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: as_hex(F.concat(step["before"], step["after"]))), ""), 256)


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, source: str = "source", key: str = "doc_id", arity: int = ARITY, told: dict[str, Column] | None = None
) -> DataFrame:
    """One row for each row of ``docs``: the ``key``, ``leaf``, ``subroot``, ``root`` (32 bytes each), the ``path`` of siblings, and ``told``, the leaf
    of what a reader was told: of the row with the columns of ``told`` in place of its own."""
    if arity < 2:
        raise ValueError("a node needs two children at least")
    given = [F.col(c) for c in columns]
    claimed = [(told or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(
        tree_key(F.col(source)).alias("tree"), F.col(key).alias("key"), leaf_digest(given).alias("digest"), leaf_digest(claimed).alias("told"),
        F.monotonically_increasing_id().alias("row"),
    )
    nodes = written(numbered(written(rows, "merkle-leaves"), ["key", "digest", "row"]).drop("row"), "merkle-nodes")
    levels, tops = grown(nodes, arity)
    subroots = written(tops_of(tops).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source")), "merkle-subroots")
    upper = written(numbered(subroots, ["source"]), "merkle-sources")
    upper_levels, upper_tops = grown(upper, arity)
    no_steps = F.array().cast("array<struct<before: binary, after: binary>>")
    root = tops_of(upper_tops).select("tree", no_steps.alias("path"), F.col("digest").alias("root"))
    above = with_paths(upper_levels, upper_tops, root, arity, ("source", "digest"))
    above = written(above.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-above")
    found = with_paths(levels, tops, above, arity, ("key", "digest", "told"))
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", "told")


def tampered_text() -> Column:
    """The text without line feeds in the rows that the check tampers with: those whose id's CRC-32 is even."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest in hex, each leaf proved anew: tampered ones don't lead to the root."""
    rows = manifest(docs, told={"text": tampered_text()}).withColumn("folded", folded(F.col("told"), F.col("path")))
    return rows.select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda sum, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, bit: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(sum, byte)), 4294967295) AS r
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
claims AS (
  SELECT d.*, CASE WHEN xor(r, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claim FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) AS told
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM claims)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
nodes AS (
  SELECT 0 AS level, tree, i, leaf AS digest FROM numbered
  UNION ALL
  SELECT level + 1, tree, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY level, tree, i // 3),
heights AS (SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree),
upper AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS i, subroot AS digest FROM heights
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, i // 3),
siblings AS (
  SELECT a.level, a.tree, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.tree = b.tree AND a.i // 3 = b.i // 3 GROUP BY a.level, a.tree, a.i),
upper_siblings AS (
  SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM upper a JOIN upper b ON a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY a.level, a.i),
walk AS (
  SELECT 0 AS level, tree, i AS row, i, told AS digest, '' AS proof FROM numbered
  UNION ALL
  SELECT w.level + 1, w.tree, w.row, w.i // 3, sha256(s.before || w.digest || s.after), w.proof || s.before || s.after
  FROM walk w JOIN siblings s USING (level, tree, i) JOIN heights h USING (tree) WHERE w.level < h.height),
places AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i FROM heights),
on_top AS (
  SELECT 0 AS level, w.tree, w.row, p.i, w.digest, w.proof FROM walk w JOIN heights h ON w.tree = h.tree AND w.level = h.height JOIN places p ON w.tree = p.tree
  UNION ALL
  SELECT w.level + 1, w.tree, w.row, w.i // 3, sha256(s.before || w.digest || s.after), w.proof || s.before || s.after
  FROM on_top w JOIN upper_siblings s USING (level, i) WHERE w.level < (SELECT max(level) FROM upper))
SELECT n.doc_id, n.leaf, h.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = r.digest AS verified
FROM numbered n JOIN heights h USING (tree) JOIN on_top w ON w.tree = n.tree AND w.row = n.i JOIN upper r ON r.level = w.level AND r.level = (SELECT max(level) FROM upper)
"""

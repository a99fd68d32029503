"""Catalog, row counts, schema history and lineage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    merged = counts[0]
    for c in counts[1:]:
        merged = merged.unionByName(c)
    return merged


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column name, type, null flag and position of every table, with its row count."""
    rows = [
        (name, field.name, field.dataType.simpleString(), field.nullable, position)
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    columns = spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, nullable boolean, position int"
    )
    return columns.join(row_counts(tables), "table_name", "left")


def migration_history(migrations: DataFrame) -> DataFrame:
    """Newest first, with a check that the stored checksum is the SHA-256 of the statement."""
    intact = F.sha2("sql_up", 256) == F.lower("checksum")
    return migrations.withColumn("checksum_ok", intact).orderBy(F.desc("applied_at"))


def version_changes(migrations: DataFrame, after: str, upto: str, affected: str = "tables_affected") -> DataFrame:
    """Migrations with after < version <= upto, one row per affected table in the JSON list."""
    chosen = migrations.filter((F.col("version") > after) & (F.col("version") <= upto))
    return chosen.withColumn(affected, F.explode(F.from_json(affected, "array<string>")))


def lineage_nodes(edges: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every node with its direct upstream and downstream counts and live row count where the table is known."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("target").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("upstream"), F.sum("down").alias("downstream"))
    return nodes.join(row_counts(tables).withColumnRenamed("table_name", "node"), "node", "left")


def lineage_paths(edges: DataFrame) -> DataFrame:
    """All (ancestor, descendant, hops) pairs of the lineage graph with the fewest hops, by repeated joins.

    Each round puts known paths end to end, so the longest path doubles until no pair is new or shorter; cycles end too. A
    lineage graph has as many nodes as a warehouse has tables.
    """
    known = edges.select(F.col("source").alias("ancestor"), F.col("target").alias("descendant"), F.lit(1).alias("hops")).distinct()
    state = None
    while True:
        known = written(known, "lineage")
        now = tuple(known.agg(F.count(F.lit(1)), F.sum("hops")).first())
        if now == state:
            return known
        state = now
        further = known.withColumnsRenamed({"ancestor": "_via", "descendant": "_end", "hops": "_hops"})
        joined = known.join(further, F.col("descendant") == F.col("_via")).select("ancestor", F.col("_end").alias("descendant"), (F.col("hops") + F.col("_hops")).alias("hops"))
        known = known.unionByName(joined).groupBy("ancestor", "descendant").agg(F.min("hops").alias("hops"))

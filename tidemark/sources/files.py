"""Readers and writers for extracts, staging tables, snapshots, rules and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.baskets import rules_for_storage


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV extract with a header, every column as text."""
    return spark.read.csv(path, header=True, schema=text_schema(columns), enforceSchema=False, escape='"', multiLine=False)


def load_staging(df: DataFrame, path: str, loaded_at: Column | None = None) -> DataFrame:
    """Replace a staging table by the rows plus their load time."""
    stamped = df.withColumn("loaded_at", loaded_at if loaded_at is not None else F.current_timestamp())
    stamped.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(stamped.schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a table; every task writes its own rows."""
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, partitions: int = 8, **options: str) -> None:
    """Append to a database table in batches over a bounded number of connections."""
    df.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def read_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Parametrised SQL over named frames; values are bound, never pasted into the text."""
    return spark.sql(text, args=dict(args or {}), **frames)


def write_snapshot(df: DataFrame, root: str, version: str = "latest") -> str:
    """Feature snapshot of one version, snappy-compressed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: str = "latest") -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


def write_rules(rules: DataFrame, path: str) -> DataFrame:
    """Rules in their stored form."""
    stored = rules_for_storage(rules)
    stored.write.mode("overwrite").parquet(path)
    return rules.sparkSession.read.schema(stored.schema).parquet(path)


def write_assignments(assigned: DataFrame, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Positions and cluster numbers per key."""
    kept = assigned.select(key, *columns)
    kept.write.mode("overwrite").parquet(path)
    return assigned.sparkSession.read.schema(kept.schema).parquet(path)


def ranked_list(df: DataFrame, score: str, fields: Sequence[str]) -> DataFrame:
    """Report columns with the score as a percent with one decimal, highest first."""
    percent = F.format_string("%.1f", F.round(F.col(score).cast("decimal(18,6)") * 100, 1).cast("double"))
    return df.orderBy(F.desc(score), *fields[:1]).select(*fields, percent.alias("risk_score_pct"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Check results and their one-row summary as JSON."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def sample_rows(tables: Mapping[str, DataFrame], name: str, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """First rows of an allowed table, in the order of some columns if the same rows are wanted each time."""
    if name not in tables:
        raise ValueError(f"Table '{name}' not found; allowed: {sorted(tables)}")
    return (tables[name].orderBy(*order) if order else tables[name]).limit(n)

"""Tables below one root that change together: rows go to new folders, and one small pointer, written last, names the folders
that count. A run that dies before the pointer leaves every table as it was."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import latest_per_key
from tidemark.session import written

#: Buckets of the table that tells which month holds a key.
INDEX_BUCKETS = 256


class Tables:
    """The tables of a root as the newest pointer names them, with this run's changes, which ``publish`` makes known.

    A table has parts, each a folder; parts are few (days, months, buckets), rows are never read to find them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            pointers = spark.read.schema("tables string, note string, version long").json(f"{self.root}/_versions")
            newest = pointers.agg(F.max_by(F.struct("version", "tables", "note"), "version")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        self.version = newest.version if newest else 0
        self.tables: dict[str, dict] = json.loads(newest.tables) if newest else {}
        self.note: str | None = newest.note if newest else None

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.tables[name]["schema"])

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some parts; parts that don't exist have none."""
        known, schema = self.tables[name]["parts"], self.schema(name)
        folders = [known[p] for p in (known if parts is None else parts) if p in known]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read_or_none_of(self, name: str, like: DataFrame) -> DataFrame:
        return self.read(name) if name in self else like.limit(0)

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def put(self, name: str, rows: DataFrame, part: str | None = None) -> DataFrame:
        """Rows in place of the whole table, or of one of its parts; gives the table as it will be."""
        folder = self._folder(name)
        rows.write.parquet(folder)
        others = self.tables[name]["parts"] if part is not None and name in self else {}
        self.tables[name] = {"schema": rows.schema.jsonValue(), "parts": {**others, part or "all": folder}}
        return self.read(name)

    def put_parts(self, name: str, rows: DataFrame, by: str, replaced: Iterable[str]) -> DataFrame:
        """Rows in place of the parts ``replaced``; ``by`` is the column of the part's name, which isn't stored. Rows of a part are
        brought together first, so that not every task writes a file of every part; large parts stay several tasks."""
        folder, schema = self._folder(name), T.StructType([f for f in rows.schema if f.name != by])
        stored = written(rows, f"{name}-parts")
        stored.hint("rebalance", by).write.partitionBy(by).parquet(folder)
        filled = [r[0] for r in stored.select(by).distinct().collect()]  # months or buckets
        kept = {p: f for p, f in (self.tables[name]["parts"] if name in self else {}).items() if p not in set(replaced)}
        self.tables[name] = {"schema": schema.jsonValue(), "parts": {**kept, **{str(p): f"{folder}/{by}={p}" for p in filled}}}
        return self.read(name)

    def merge(self, name: str, rows: DataFrame, key: str, date: str, lateness_days: int | None = None) -> list[str]:
        """Rows replace or join those of their key; gives the months that changed, which alone are rewritten.

        With ``lateness_days``, rows older than the newest known day less the allowance are passed over. The months of known
        keys come from an index by hash of the key, of which only the buckets of the given keys are read.
        """
        month = F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))
        newest = self.tables.get(name, {}).get("newest")
        if lateness_days is not None and newest is not None:
            rows = rows.filter(F.to_date(date) > F.date_sub(F.lit(newest).cast("date"), lateness_days))
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(INDEX_BUCKETS)).cast("string")
        fresh = latest_per_key(rows, [key], [F.desc(date), F.desc(F.xxhash64(*rows.columns))])
        fresh = written(fresh.withColumns({"_month": month, "_bucket": bucket}), f"{name}-fresh")
        seen = fresh.agg(F.collect_set("_month"), F.collect_set("_bucket"), F.max(F.to_date(date))).first()  # months, buckets, a day
        months, index = set(seen[0]), f"{name}_months"
        own_keys = fresh.select(key)
        placed = fresh.select(key, F.col("_month").alias("month"), "_bucket")
        if name in self:
            known = self.read(index, seen[1])
            months |= {r[0] for r in known.join(own_keys, key, "left_semi").select("month").distinct().collect()}
            others = known.join(own_keys, key, "left_anti").withColumn("_bucket", bucket)
            placed = others.unionByName(placed)
            kept = self.read(name, months).join(own_keys, key, "left_anti").withColumn("_month", month)
            merged = kept.unionByName(fresh.drop("_bucket"), allowMissingColumns=True)
        else:
            merged = fresh.drop("_bucket")
        if not months:
            if name not in self:
                self.put_parts(name, merged, "_month", ())
                self.put_parts(index, placed, "_bucket", ())
            return []
        self.put_parts(index, placed, "_bucket", seen[1])
        self.put_parts(name, merged, "_month", months)
        latest = str(seen[2]) if seen[2] else newest
        self.tables[name]["newest"] = max(latest, newest) if latest and newest else latest or newest
        return sorted(months)

    def publish(self, note: str | None = None) -> None:
        """Make this run's changes known, all at once."""
        pointer = self.spark.createDataFrame([(json.dumps(self.tables), note or self.note, self.version + 1)], "tables string, note string, version long")
        pointer.coalesce(1).write.mode("append").partitionBy("version").json(f"{self.root}/_versions")
        self.version, self.note = self.version + 1, note or self.note

    def forget_older(self) -> None:
        """Delete the folders that the published version doesn't name; readers of older versions must have ended."""
        published = Tables(self.spark, self.root)
        used = {f.split(f"/{name}/")[-1].split("/")[0] for name, t in published.tables.items() for f in t["parts"].values()}
        jvm = self.spark._jvm
        for name in published.tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(path):
                if status.getPath().getName() not in used:
                    files.delete(status.getPath(), True)


def latest_day(day: Column, spark: SparkSession) -> str:
    """A day as text, for the name of a part."""
    return spark.range(1).select(F.date_format(day, "yyyy-MM-dd")).first()[0]

"""Filters, search, order, paging and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col
from tidemark.operators.ranks import top_per_group


def filter_by(df: DataFrame, equals: Mapping[str, Any] | None = None, **options: Any) -> DataFrame:
    """AND of the given equalities; entries whose value is None are left out.

    A name ending in ``__gte`` or ``__lte`` compares, a list value means membership, and ``__known`` tests for NULL.
    """
    for name, value in {**(equals or {}), **options}.items():
        if value is None:
            continue
        if name.endswith("__gte"):
            df = df.filter(F.col(name[:-5]) >= value)
        elif name.endswith("__lte"):
            df = df.filter(F.col(name[:-5]) <= value)
        elif name.endswith("__known"):
            df = df.filter(F.col(name[:-7]).isNotNull() if value else F.col(name[:-7]).isNull())
        elif isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(list(value)))
        else:
            df = df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25, key: str | None = None) -> DataFrame:
    """One ordered page with total rows and total pages; ``key`` counts distinct keys instead of rows."""
    counted = F.countDistinct(key) if key else F.count(F.lit(1))
    total = df.agg(counted.alias("total")).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"total": total, "pages": F.ceil(total / F.lit(size))})


def since_days(df: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(date) >= F.date_sub(as_of, days))


def since_months(df: DataFrame, date: str, as_of: Column, months: int) -> DataFrame:
    """From the first day of the month that lies ``months`` back."""
    return df.filter(F.col(date) >= F.trunc(F.add_months(as_of, -months), "month"))


def since_seconds(df: DataFrame, ts: str, as_of: Column, seconds: int) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def current_period(df: DataFrame, period: str, as_of: Column, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of the given year and/or month; the month of ``as_of`` when neither is given."""
    if year is None and month is None:
        return df.filter(F.col(period) == F.trunc(as_of, "month"))
    return filter_by(df, year=year, month=month)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    needle = text.lower()
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def at_or_above(df: DataFrame, score: str, percent: float, department: str | None = None, column: str = "department") -> DataFrame:
    """Scores of at least ``percent`` out of 100, optionally of one department."""
    df = df.filter(F.col(score) * 100 >= percent)
    return df if department in (None, "", "All", "All Departments") else df.filter(F.col(column) == department)


def top_n(df: DataFrame, sort_key: str, n: int, tiers: Sequence[str] | None = None, tier: str = "risk_tier", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Largest ``n`` rows by a chosen key, after a tier filter."""
    if tiers:
        df = df.filter(F.col(tier).isin(list(tiers)))
    return df.orderBy(F.col(sort_key).desc_nulls_last(), *tiebreak).limit(n)


def with_latest_children(
    parents: DataFrame, children: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], k: int = 20,
    name: str = "latest",
) -> DataFrame:
    """Each parent with an array of its latest ``k`` child rows, newest first; no children gives an empty array."""
    kept = top_per_group(children.select(key, *fields), [key], order, k)
    nested = kept.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", *fields))),
            lambda s: F.struct(*[s[f].alias(f) for f in fields]),
        ).alias(name)
    )
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 3) -> DataFrame:
    """Rows 1, n+1, 2n+1 … of each (already aggregated) series."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter((F.col("_row") - 1) % n == 0).drop("_row")


def five_numbers(df: DataFrame, group: str, value: str, below: float) -> DataFrame:
    """Minimum, quartiles and maximum per group of whole-number values under a cut."""
    kept = df.filter(F.col(value) < below)
    quartiles = F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return kept.groupBy(group).agg(F.count(F.lit(1)).alias("n"), quartiles.alias("_q")).select(
        group, "n", *[F.col("_q")[i].alias(label) for i, label in enumerate(["lowest", "q1", "median", "q3", "highest"])]
    )


def latest_value(df: DataFrame, c: Column | str) -> Column:
    """Greatest value of a column as a scalar, for use as an ``as_of`` in other expressions."""
    return df.agg(F.max(col(c)).alias("latest")).scalar()

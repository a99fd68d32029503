"""Sets of small numbers as arrays of 64-bit words, and the walk through the stored sets that lie inside given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

WORD = 64


def numbered_items(counts: DataFrame, item: str = "item", often: str = "often") -> DataFrame:
    """``item, at``: the items numbered from 0, rarest first. Meant for a vocabulary of frequent items, which a least support
    bounds; it is ordered in one pass."""
    place = F.row_number().over(Window.orderBy(often, item)) - 1
    return counts.select(item, place.cast("int").alias("at"))


def bitmap(positions: Column, words: int) -> Column:
    """The set of the numbers in an array, each given once, in ``words`` words."""
    one = F.lit(1).cast("long")

    def word(w: Column) -> Column:
        mine = F.filter(positions, lambda p: F.floor(p / WORD) == w)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", one, (p % WORD).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def members(bits: Column) -> Column:
    """The numbers in a set, ascending; words without bits cost nothing."""
    inside = F.sequence(F.lit(0), F.lit(WORD - 1))

    def of_word(word: Column, w: Column) -> Column:
        found = F.filter(inside, lambda b: F.call_function("shiftrightunsigned", word, b).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.when(word == 0, F.array().cast("array<int>")).otherwise(F.transform(found, lambda b: (w * WORD + b).cast("int")))

    return F.flatten(F.transform(bits, of_word))


def common(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def count_bits(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, word: n + F.bit_count(word))


def beyond(bits: Column, position: Column) -> Column:
    """The members that are greater than ``position``."""
    above = F.call_function("shiftleft", F.lit(-2).cast("long"), (position % WORD).cast("int"))
    at = F.floor(position / WORD)
    return F.transform(bits, lambda word, w: F.when(w < at, F.lit(0).cast("long")).when(w == at, word.bitwiseAND(above)).otherwise(word))


def profiles(sets: DataFrame, key: str, items: str, vocabulary: DataFrame, words: int) -> DataFrame:
    """``key, bits``: the items of every set that ``vocabulary`` (item, at) has, as a bitmap; sets without any are left out."""
    known = sets.select(key, F.explode(F.array_distinct(items)).alias("item")).join(vocabulary, "item")
    return known.groupBy(key).agg(F.collect_list("at").alias("_at")).select(key, bitmap(F.col("_at"), words).alias("bits"))


def extensions(stored: DataFrame, words: int) -> DataFrame:
    """``members, next`` for the sets ``stored`` (members, ascending): which numbers extend each of their beginnings."""
    start = F.slice("members", 1, F.size("members") - 1)
    tails = stored.select(start.alias("members"), F.element_at("members", -1).alias("last")).distinct()
    return tails.groupBy("members").agg(F.collect_list("last").alias("_next")).select("members", bitmap(F.col("_next"), words).alias("next"))


def extended(held: DataFrame, further: DataFrame, carried: list[str]) -> DataFrame:
    """One number more: rows of ``held`` (members, rest, ``carried``) with each number of ``rest`` that ``further`` (members, next) allows.

    What can't extend the shorter set can't extend the longer one, so the rest shrinks with every step.
    """
    met = held.join(further, "members").select("members", common(F.col("rest"), F.col("next")).alias("rest"), *carried)
    grown = met.select("members", "rest", *carried, F.explode(members(F.col("rest"))).alias("_at"))
    return grown.select(F.array_append("members", F.col("_at")).alias("members"), beyond(F.col("rest"), F.col("_at")).alias("rest"), *carried)


def started(profile: DataFrame, carried: list[str]) -> DataFrame:
    """The empty set within every profile (bits, ``carried``)."""
    return profile.select(F.array().cast("array<int>").alias("members"), F.col("bits").alias("rest"), *carried)


def stored_sets_inside(profile: DataFrame, key: str, stored: DataFrame, words: int, longest: int) -> DataFrame:
    """``key, members``: every set of ``stored`` (members, ascending; no longer than ``longest``) that lies inside a profile (key, bits).

    A profile is walked from beginning to beginning of stored sets, so it costs what it holds of them and never meets the rest.
    What is left after a step is written, as the next step and the result both read it.
    """
    sets = written(stored.select("members").distinct(), "stored-sets")
    beginnings = sets.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("members")), lambda k: F.slice("members", 1, k))).alias("members"))
    beginnings = written(beginnings.distinct(), "beginnings")
    held, found = started(profile, [key]), None
    for length in range(1, longest + 1):
        further = extensions(beginnings.where(F.size("members") == length), words)
        held = written(extended(held, further, [key]), "sets-inside")
        inside = held.select(key, "members").join(sets.where(F.size("members") == length), "members", "left_semi")
        found = inside if found is None else found.unionByName(inside)
    return found

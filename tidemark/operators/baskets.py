"""Item baskets, frequent itemsets and association rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bitmaps import WORD, extended, extensions, numbered_items, profiles, started
from tidemark.session import written

# Mining defaults, tags and labels.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.30, 1.1
OUTCOME_MIN_SUPPORT = 0.005
MAX_ITEMS, OUTCOME_MAX_ITEMS = 4, 5
SUCCESS_ITEM = "NO_READMIT"
CO_OCCURRENCE, EFFECTIVENESS = "diagnosis_association", "intervention_effectiveness"
HIGHEST_CONVICTION = 999.99
#: Keys whose items a task gathers.
KEYS_A_TASK = 250_000


def baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct items per key; the set is built map-side first and cannot outgrow the item vocabulary."""
    known = df.filter(F.col(item).isNotNull())
    return known.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))


def tagged_baskets(
    outcomes: DataFrame, diagnoses: DataFrame, procedures: DataFrame, key: str = "admission_id", failed: str = "readmit_30day_flag",
    code: str = "icd10_code", procedure: str = "cpt_code", successes_only: bool = False,
) -> DataFrame:
    """Diagnosis and procedure items per key, plus the success item where the outcome was good.

    Mining only successes makes every basket hold the success item, so that all its rules have confidence and lift 1;
    the default therefore keeps the failures as baskets without it. Items and outcomes meet in one shuffle, of tasks that grow
    in number with the keys, not in size.
    """
    pieces = -(-outcomes.count() // KEYS_A_TASK)
    items = diagnoses.select(key, F.concat(F.lit("DX:"), code).alias("item")).unionByName(
        procedures.select(key, F.concat(F.lit("CPT:"), procedure).alias("item"))
    )
    good = outcomes.filter(~F.col(failed)).select(key, F.lit(SUCCESS_ITEM).alias("item"))
    kept = good.select(key) if successes_only else outcomes.select(key)
    mark = lambda rows, item, known: rows.select(key, item.alias("item"), F.lit(known).alias("_kept"))
    item = F.col("item")
    rows = mark(items.filter(F.col(key).isNotNull()), item, False).unionByName(mark(kept, F.lit(None).cast("string"), True)).unionByName(mark(good, item, True))
    spread = rows.repartition(max(pieces, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    found = spread.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("_kept").alias("_kept"))
    return found.filter(F.col("_kept") & (F.size("items") >= (2 if successes_only else 1))).drop("_kept")


def frequent_itemsets(sets: DataFrame, min_support: float = MIN_SUPPORT, max_items: int = MAX_ITEMS) -> DataFrame:
    """Sorted itemsets of up to ``max_items`` items with their basket count, total and support, level by level.

    Baskets become bitmaps of frequent items, equal ones are folded to one with a count. A set of a level is a frequent set of
    the level before with a later item, which the prefix join allows only where all sets of one item less are frequent;
    within a basket, only what is left of it beyond the last item can follow. So no set over the limit and none with an
    infrequent part is ever made, and each level is written with what is left, folded again.
    """
    spark = sets.sparkSession
    held = written(sets.select("items", F.monotonically_increasing_id().alias("basket")), "baskets")
    total = held.count()
    least = max(1, math.ceil(min_support * total))
    often = held.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    vocabulary = written(numbered_items(often.where(F.col("often") >= least)), "frequent-items")
    size = vocabulary.count()
    found = spark.createDataFrame([], "members array<int>, freq long")
    if size:
        folded = profiles(held, "basket", "items", vocabulary, -(-size // WORD)).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
        found = _frequent_levels(started(folded, ["n"]), least, max_items, size)
    named = found.withColumn("at", F.explode("members")).join(vocabulary, "at").groupBy("members", "freq").agg(F.array_sort(F.collect_list("item")).alias("items"))
    stored = written(named.select("items", "freq", F.lit(total).cast("long").alias("baskets")), "itemsets")
    return stored.withColumn("support", F.col("freq") / F.col("baskets"))


def _frequent_levels(held: DataFrame, least: int, max_items: int, size: int) -> DataFrame:
    """``members, freq`` of all frequent sets, from ``held`` (members, rest, n) with the empty set."""
    words, spark = -(-size // WORD), held.sparkSession
    every = spark.range(size).select(F.array(F.col("id").cast("int")).alias("members"))
    further, levels = extensions(every, words), []
    for length in range(1, max_items + 1):
        grown = extended(held, further, ["n"])
        rest = [] if length == max_items else ["rest"]  # nothing follows the last level
        held = written(grown.groupBy("members", *rest).agg(F.sum("n").alias("n")), "itemset-level")
        level = held.groupBy("members").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
        levels.append(written(level, "frequent-level"))
        if length < max_items:
            further = written(extensions(_candidates(levels[-1].select("members"), length), words), "extensions")
            if further.isEmpty():
                break
    return reduce(DataFrame.unionByName, levels)


def _candidates(frequent: DataFrame, length: int) -> DataFrame:
    """Sets of one item more, of which all parts of ``length`` items are ``frequent``: two that differ in the last item are
    joined, and the parts that lack an earlier one are looked up."""
    head = F.slice("members", 1, length - 1)
    side = lambda name: frequent.select(head.alias("head"), F.element_at("members", -1).alias(name))
    pairs = side("a").join(side("b"), "head").where("a < b")
    joined = pairs.select(F.concat("head", F.array("a", "b")).alias("members"))
    if length == 1:
        return joined
    lacking = F.transform(F.sequence(F.lit(0), F.lit(length - 2)), lambda i: F.filter("members", lambda x, j: j != i))
    parts = joined.select("members", F.explode(lacking).alias("part")).join(frequent.withColumnRenamed("members", "part"), "part")
    return parts.groupBy("members").agg(F.count(F.lit(1)).alias("known")).where(F.col("known") == length - 1).select("members")


def association_rules(
    itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, rule_type: str = CO_OCCURRENCE
) -> DataFrame:
    """Every split of a frequent itemset into antecedent and consequent with its measures.

    Both halves of a frequent itemset are frequent themselves, so their supports come from the same table by join.
    """
    splits = F.expr(
        "transform(sequence(1, cast(pow(2, size(items)) as int) - 2), m -> struct("
        "filter(items, (x, i) -> (shiftright(m, i) & 1) = 1) as antecedents, filter(items, (x, i) -> (shiftright(m, i) & 1) = 0) as consequents))"
    )
    rules = itemsets.filter(F.size("items") >= 2).select("freq", "baskets", F.inline(splits))
    counts = itemsets.select("items", F.col("freq").alias("part"))
    rules = rules.join(counts.withColumnsRenamed({"items": "antecedents", "part": "antecedent_freq"}), "antecedents")
    rules = rules.join(counts.withColumnsRenamed({"items": "consequents", "part": "consequent_freq"}), "consequents")
    confidence = F.col("freq") / F.col("antecedent_freq")
    expected = F.col("consequent_freq") / F.col("baskets")
    conviction = F.when(F.col("freq") == F.col("antecedent_freq"), F.lit(float("inf"))).otherwise((1 - expected) / (1 - confidence))
    label = F.when(F.size("consequents") == 1, F.col("consequents")[0]).otherwise(
        F.concat(F.lit("['"), F.array_join("consequents", "', '"), F.lit("']"))
    )
    return rules.select(
        F.xxhash64(F.size("antecedents"), "antecedents", "consequents").alias("rule_id"), "antecedents", "consequents", label.alias("consequent"),
        (F.col("freq") / F.col("baskets")).alias("support"), confidence.alias("confidence"), (confidence / expected).alias("lift"),
        conviction.alias("conviction"), F.col("freq").alias("evidence_count"), F.lit(rule_type).alias("rule_type"),
    ).filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def outcome_rules(
    itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = 0.0, outcome: str = SUCCESS_ITEM
) -> DataFrame:
    """Rules whose consequent holds the outcome item."""
    found = association_rules(itemsets, min_confidence, min_lift, EFFECTIVENESS)
    return found.filter(F.array_contains("consequents", outcome)).withColumn("consequent", F.lit(outcome))


def rules_for_storage(rules: DataFrame) -> DataFrame:
    """Rules as stored: antecedents as a JSON array, measures with six places, conviction capped."""
    six = lambda c: F.round(F.col(c), 6).alias(c)
    return rules.select(
        "rule_id", F.to_json("antecedents").alias("antecedent_items"), F.col("consequent").alias("consequent_item"),
        six("support"), six("confidence"), six("lift"), F.round(F.least("conviction", F.lit(HIGHEST_CONVICTION)), 6).alias("conviction"),
        "evidence_count", "rule_type",
    )


def top_rules(rules: DataFrame, n: int = 25, rule_type: str | None = None, min_lift: float = 1.0) -> DataFrame:
    """Strongest rules by lift, optionally of one type."""
    if rule_type:
        rules = rules.filter(F.col("rule_type") == rule_type)
    return rules.filter(F.col("lift") >= min_lift).orderBy(F.desc("lift"), F.desc("evidence_count"), "antecedents", "consequents").limit(n)

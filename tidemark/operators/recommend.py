"""Ranked actions per entity from a rule library and from mined rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from string import Formatter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scoring
from tidemark.functions.cleaning import encode, fill_template
from tidemark.operators.baskets import EFFECTIVENESS, SUCCESS_ITEM
from tidemark.operators.bitmaps import WORD, numbered_items, profiles, stored_sets_inside
from tidemark.operators.ranks import top_per_group
from tidemark.session import written

# Weights, orders, labels and defaults of mined actions.
GRADE_WEIGHTS = {"A": 3, "B": 2, "C": 1}
TIME_ORDER = {"before_discharge": 0, "within_48h": 1, "within_7d": 2, "ongoing": 3}
STRENGTHS = {"A": "high", "B": "medium", "C": "low"}
CATEGORY_LABELS = {
    "medication_management": "Medication Management",
    "discharge_planning": "Discharge Planning",
    "patient_education": "Patient Education",
    "social_support": "Social Support",
    "clinical_monitoring": "Clinical Monitoring",
    "specialist_referral": "Specialist Referral",
}
MINED_CATEGORY = "discharge_planning"
LEAST_OVERLAP, UNKNOWN_RISK = 0.5, 0.5
MOST_ITEMS = 16
CANDIDATE = [
    "key", "action", "category", "rationale", "evidence_grade", "source", "reduces_readmission_by_pct", "responsible_role",
    "time_sensitivity", "evidence_source", "score",
]
NESTED = ["priority", "category", "category_label", "action", "rationale", "evidence_strength", "reduces_readmission_by_pct", "time_sensitivity", "responsible_role"]


def match_rules(
    entities: DataFrame, rules: DataFrame, key: str, items: str = "items", n: int | None = 5, least_overlap: float = LEAST_OVERLAP
) -> DataFrame:
    """Outcome rules that share at least half of their antecedent with an entity's items, best action first."""
    keyed, matched = matched_sets(entities, rules, key, items, n, least_overlap)
    return keyed.join(matched, ["_set", "_set2"]).drop("_set", "_set2")


def matched_sets(
    entities: DataFrame, rules: DataFrame, key: str, items: str = "items", n: int | None = 5, least_overlap: float = LEAST_OVERLAP
) -> tuple[DataFrame, DataFrame]:
    """``key, _set, _set2`` of every entity, two hashes that name its item set, and the matches of each item set that has any.

    Of rules that need the same items only the strongest can be chosen, so the others go first. A rule is stored under every
    set of its items that is large enough to match, with what it is worth there; of each set and action only the best rule
    stays, of equal ones the first by its items' text. Entities with the same items share one result: their items are walked through the stored sets, as bitmaps, and
    the best of each action is a bounded maximum. A smaller part of an overlap is worth less than the overlap itself, which is
    stored too, so the maximum is exact. Texts are made once for an item set and rule that are kept. Rules may have ``MOST_ITEMS`` items.
    """
    needed = F.array_except("antecedents", F.array(F.lit(SUCCESS_ITEM)))
    weight = F.col("lift") * F.col("confidence") * F.log1p("evidence_count")
    bundle = F.array_sort(F.filter("_needed", lambda x: x.startswith("CPT:")))
    action = F.when(F.size(bundle) > 0, F.concat(F.lit("Apply intervention bundle: "), F.array_join(bundle, ", "))).otherwise(
        "Continue current care protocols"
    )
    fields = ["rule_id", "confidence", "lift", "evidence_count", "rule_type"]
    wanted = rules.filter(F.col("rule_type") == EFFECTIVENESS).withColumns({"_needed": needed, "_weight": weight, "_text": F.array_join("antecedents", "|")})
    rest = F.array_join("consequents", "|") if "consequents" in rules.columns else F.lit("")
    best_of_same = F.min_by(F.struct(*fields, "_weight"), F.struct(-F.col("_weight"), "_text", rest, "rule_id"))
    wanted = wanted.groupBy("_needed").agg(best_of_same.alias("_r")).select("_needed", "_r.*")
    wanted = wanted.withColumns({"action": action, "_text": F.array_join("_needed", "|")}).filter(F.size("_needed") > 0)

    profile = F.array_sort(F.array_distinct(items))
    keyed = entities.select(key, profile.alias("_profile")).withColumns(
        {"_set": F.xxhash64("_profile"), "_set2": F.xxhash64(F.lit(1), "_profile")}  # 128 bits name an item set
    )
    keyed = written(keyed, "matched-entities")
    sets = written(keyed.groupBy("_set", "_set2").agg(F.first("_profile").alias("_profile")), "item-sets")
    rule_items = written(wanted.select("_text", "_weight", "action", "_needed"), "wanted-rules")
    most = rule_items.agg(F.max(F.size("_needed"))).first()[0] or 0
    if most > MOST_ITEMS:
        raise ValueError(f"a rule needs {most} items; {MOST_ITEMS} at most can be matched in part")
    often = sets.select(F.explode("_profile").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    used = rule_items.select(F.explode("_needed").alias("item")).distinct()
    vocabulary = written(numbered_items(used.join(often, "item", "left").withColumn("often", F.coalesce("often", F.lit(0)))), "rule-items")
    words = max(1, -(-vocabulary.count() // WORD))
    placed = rule_items.withColumn("item", F.explode("_needed")).join(vocabulary, "item")
    placed = placed.groupBy("_text", "_weight", "action").agg(F.array_sort(F.collect_list("at")).alias("_at"))
    size, needs = F.size("_at"), F.greatest(F.lit(1), F.ceil(F.size("_at") * F.lit(least_overlap) - 1e-9))
    parts = F.transform(
        F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), size) - 1), lambda m: F.filter("_at", lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1)
    )
    worth = placed.withColumn("members", F.explode(F.filter(parts, lambda p: F.size(p) >= needs)))
    worth = worth.select("members", "action", (-(F.col("_weight") * (F.size("members") / size))).alias("_worth"), "_text")
    worth = written(worth.groupBy("members", F.xxhash64("action").alias("_action")).agg(F.min(F.struct("_worth", "_text")).alias("_best")), "rule-parts")
    named = F.struct("_set", "_set2")
    bits = profiles(sets.select(named.alias("_named"), "_profile"), "_named", "_profile", vocabulary, words)
    inside = stored_sets_inside(written(bits, "profiles"), "_named", worth, words, most)
    chosen = inside.join(worth, "members").groupBy("_named", "_action").agg(F.min("_best").alias("_best"))
    unique = chosen.select("_named.*", "_best._text", (-F.col("_best._worth")).alias("priority_score"))
    best = [F.desc("priority_score"), F.asc("_text")]
    if n is not None:
        unique = top_per_group(unique, ["_set", "_set2"], best, n).withColumnRenamed("position", "rank")
    unique = unique.join(wanted.drop("_weight"), "_text").drop("_text")
    matched = F.array_sort(F.array_intersect("_needed", "_profile"))
    shown = F.array_join(F.transform("antecedents_matched", lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("DX:"), F.lit("")), F.lit("'"))), ", ")
    rationale = F.concat(
        F.lit("In "), F.col("evidence_count").cast("string"), F.lit(" similar patients with ["), shown,
        F.lit("], this care path reduced readmission (confidence="), F.format_string("%.0f", F.bround(F.col("confidence") * 100)),
        F.lit("%, lift="), F.format_string("%.2f", F.col("lift")), F.lit("x vs baseline)."),
    )
    four = lambda c: F.round(F.col(c), 4).alias(c)
    found = sets.join(unique, ["_set", "_set2"]).withColumn("antecedents_matched", matched).withColumn("rationale", rationale)
    matches = found.select(
        "_set", "_set2", "rule_id", "action", "rationale", four("confidence"), four("lift"), "evidence_count", "rule_type", "antecedents_matched",
        "priority_score", *(["rank"] if n is not None else []),
    )
    return keyed.select(key, "_set", "_set2"), matches


def mined_candidates(matches: DataFrame, key: str) -> DataFrame:
    """Matched rules in the shape of library actions."""
    source = F.concat(
        F.lit("Association rules (lift="), F.format_string("%.2f", "lift"), F.lit(", n="), F.col("evidence_count").cast("string"), F.lit(")")
    )
    return matches.select(
        key, F.concat(F.lit("rule_"), F.pmod(F.xxhash64("action"), F.lit(100000)).cast("string")).alias("key"), "action",
        F.lit(MINED_CATEGORY).alias("category"), "rationale", F.lit("B").alias("evidence_grade"), source.alias("source"),
        F.bround(F.col("confidence") * 30).cast("int").alias("reduces_readmission_by_pct"), F.lit("care_coordinator").alias("responsible_role"),
        F.lit("before_discharge").alias("time_sensitivity"), F.lit("association_rules").alias("evidence_source"),
        F.round("priority_score", 4).alias("score"), F.lit(1).alias("_stream"), F.lit(0).alias("_order"),
    )


def _trigger(field: str, value: Any, columns: Sequence[str]) -> Column:
    """One trigger: a lower bound, a truth value or an equality; a field the rows lack counts as 0 or as missing."""
    if field.endswith("__gte"):
        name = field.removesuffix("__gte")
        actual = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)
        return actual >= value
    if field not in columns:
        return F.lit(value is False)
    if isinstance(value, bool):
        return F.coalesce(F.col(field).cast("boolean"), F.lit(False)) == value
    return F.coalesce(F.col(field) == value, F.lit(False))


def applies(rule: Mapping[str, Any], columns: Sequence[str], codes: str | None) -> Column:
    """All triggers hold, or a listed code is present; a rule with neither always applies."""
    triggers, listed = rule.get("triggers") or {}, rule.get("icd10_trigger") or []
    if not triggers and not listed:
        return F.lit(True)
    by_code = F.lit(False)
    if listed and codes:
        by_code = F.coalesce(F.arrays_overlap(F.col(codes), F.array(*[F.lit(c) for c in listed])), F.lit(False))
    by_trigger = reduce(lambda a, b: a & b, [_trigger(f, v, columns) for f, v in triggers.items()]) if triggers else F.lit(False)
    return by_code | by_trigger


def library_candidates(
    features: DataFrame, library: Mapping[str, Mapping[str, Any]], key: str, codes: str | None = None, n: int = 20
) -> DataFrame:
    """Library actions of every row, best ``n`` by reduction times grade weight.

    Each rule becomes one predicate over the row; the row's applicable rules are an array that is filtered, cut to the
    best and exploded, so no rule table is joined and no shuffle is needed.
    """
    columns = features.columns
    options = []
    for position, (name, rule) in enumerate(library.items()):
        grade = rule.get("evidence_grade", "C")
        pct = rule.get("reduces_readmission_by_pct", 0)
        template = rule.get("rationale_template", rule.get("action", ""))
        named = [f for _, f, _, _ in Formatter().parse(template) if f]
        rationale = fill_template(F.lit(template), {f: F.col(f) for f in named if f in columns}) if named else F.lit(template)
        option = F.struct(
            F.lit(-pct * GRADE_WEIGHTS.get(grade, 1)).alias("_sort"), F.lit(position).alias("_order"), F.lit(name).alias("key"),
            F.lit(rule["action"]).alias("action"), F.lit(rule["category"]).alias("category"), rationale.alias("rationale"),
            F.lit(grade).alias("evidence_grade"), F.lit(rule.get("source", "")).alias("source"), F.lit(pct).alias("reduces_readmission_by_pct"),
            F.lit(rule.get("responsible_role", "care_coordinator")).alias("responsible_role"),
            F.lit(rule.get("time_sensitivity", "before_discharge")).alias("time_sensitivity"),
            F.lit("clinical_library").alias("evidence_source"), F.lit(float(pct * GRADE_WEIGHTS.get(grade, 1))).alias("score"),
        )
        options.append(F.when(applies(rule, columns, codes), option))
    chosen = F.slice(F.array_sort(F.filter(F.array(*options), lambda x: x.isNotNull())), 1, n)
    return features.select(key, F.inline(chosen)).drop("_sort").withColumn("_stream", F.lit(0)).select(key, *CANDIDATE, "_stream", "_order")


def merge_library(default: Mapping[str, Any], custom: Mapping[str, Any]) -> dict[str, Any]:
    """Custom entries replace default ones of the same key, new ones come last."""
    return {**default, **custom}


def override_by_key(default: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """The same for tables: rows of ``custom`` replace rows of ``default`` with the same key."""
    return default.join(custom.select(key).distinct(), key, "left_anti").unionByName(custom)


def ranked_plan(candidates: DataFrame, key: str, per_category: int = 3, in_total: int = 10) -> DataFrame:
    """Each action once, at most three per category and ten in all, numbered by composite score."""
    grade = F.coalesce(encode("evidence_grade", GRADE_WEIGHTS, 1), F.lit(1))
    bonus = 3 - encode("time_sensitivity", TIME_ORDER, 3)
    composite = grade * F.col("reduces_readmission_by_pct") + bonus * 2 + F.col("score") * 5
    scored = candidates.withColumn("composite_score", composite.cast("double"))
    best = [F.desc("composite_score"), F.asc("_stream"), F.desc("score"), F.asc("_order"), F.asc("action")]
    once = top_per_group(scored, [key, "action"], best, 1).drop("position")
    capped = top_per_group(once, [key, "category"], best, per_category).drop("position")
    final = top_per_group(capped, [key], best, in_total).withColumnRenamed("position", "priority")
    labels = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair])
    strengths = F.create_map(*[F.lit(x) for pair in STRENGTHS.items() for x in pair])
    return final.withColumns(
        {
            "category_label": F.coalesce(F.try_element_at(labels, "category"), F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))),
            "evidence_strength": F.coalesce(F.try_element_at(strengths, "evidence_grade"), F.lit("low")),
        }
    ).drop("_stream", "_order")


def _composite(grade: str, pct: float, time: str, score: float) -> float:
    """What ``ranked_plan`` ranks by, of a library action."""
    return float(GRADE_WEIGHTS.get(grade, 1) * pct + (3 - TIME_ORDER.get(time, 3)) * 2 + score * 5)


def _template_fields(rule: Mapping[str, Any], columns: Sequence[str]) -> list[str]:
    template = rule.get("rationale_template", rule.get("action", ""))
    return [f for f in dict.fromkeys(f for _, f, _, _ in Formatter().parse(template) if f) if f in columns]


def compact_plans(
    features: DataFrame, library: Mapping[str, Mapping[str, Any]], key: str, codes: str | None, keyed: DataFrame, matches: DataFrame,
    n: int = 20, per_category: int = 3, in_total: int = 10,
) -> DataFrame:
    """What ``ranked_plan`` makes of the best ``n`` library actions of ``features`` and of the ``matched_sets`` of entities (one row a
    key): ``key, rows, plan``, one row a key, its actions in order.

    Everything of a library action but its rationale is fixed, so a row carries the numbers of its actions and the values that
    rationales name; ``rows`` has them, one for each choice of actions where a key repeats. An item set's matches join the
    folded keys, and a plan is ranked within its row: at most ``n`` actions of the library for each choice, and the set's.
    Library actions keep no text here; ``plan_texts`` gives them back.
    """
    entries = list(library.items())
    score = [float(x.get("reduces_readmission_by_pct", 0) * GRADE_WEIGHTS.get(x.get("evidence_grade", "C"), 1)) for _, x in entries]
    best = sorted(range(len(entries)), key=lambda i: (-score[i], i))
    named = list(dict.fromkeys(f for _, x in entries for f in _template_fields(x, features.columns)))
    applying = F.array(*[F.when(applies(entries[i][1], features.columns, codes), F.lit(i).cast("smallint")) for i in best])
    positions = F.slice(F.filter(applying, lambda x: x.isNotNull()), 1, n)
    values = F.struct(*[F.col(f).cast("string").alias(f) for f in named]) if named else F.struct(F.lit(None).cast("string").alias("_none"))
    own = features.select(key, positions.alias("_positions"), values.alias("_values"))
    none = keyed.select(key, *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("_positions", "_values")], "_set", "_set2")
    both = own.withColumns({c: F.lit(None).cast("long") for c in ("_set", "_set2")}).unionByName(none)
    chosen = both.groupBy(key, "_positions", "_set", "_set2").agg(F.min("_values").alias("_values"))
    row = F.struct(F.col("_positions").alias("positions"), F.col("_values").alias("values"))
    folded = chosen.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_positions").isNotNull(), row))).alias("rows"), F.max("_set").alias("_set"), F.max("_set2").alias("_set2")
    )

    mined = mined_candidates(matches.withColumn("_named", F.struct("_set", "_set2")), "_named")
    text = F.struct("key", "action", "rationale", "source", "reduces_readmission_by_pct")
    grade, bonus = encode("evidence_grade", GRADE_WEIGHTS, 1), 3 - encode("time_sensitivity", TIME_ORDER, 3)
    worth = (F.coalesce(grade, F.lit(1)) * F.col("reduces_readmission_by_pct") + bonus * 2 + F.col("score") * 5).cast("double")
    option = F.struct((-worth).alias("lost"), (-F.col("score")).alias("less"), "action", text.alias("text"))
    actions, groups = [x["action"] for _, x in entries], sorted({x["category"] for _, x in entries} | {MINED_CATEGORY})
    clash = F.exists("_mined", lambda x: x["action"].isin(actions))
    options = mined.groupBy("_named").agg(F.array_sort(F.collect_list(option)).alias("_mined"))  # no more than a set's matches
    options = options.select("_named.*", clash.alias("_clash"), F.when(clash, F.col("_mined")).otherwise(F.slice("_mined", 1, per_category)).alias("_mined"))
    joined = folded.join(options, ["_set", "_set2"], "left")

    number = lambda x: F.lit(x).cast("int")
    fixed = F.array(*[
        F.struct(
            F.lit(-_composite(x.get("evidence_grade", "C"), x.get("reduces_readmission_by_pct", 0), x.get("time_sensitivity", "before_discharge"), score[i])).alias("lost"),
            number(0).alias("stream"), F.lit(-score[i]).alias("less"), number(i).alias("order"), number(actions.index(x["action"])).alias("action"), number(groups.index(x["category"])).alias("category"),
        ) for i, (_, x) in enumerate(entries)
    ])
    chosen_once = F.when(F.size("rows") == 1, F.col("rows")[0]["positions"]).otherwise(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["positions"]))))
    of_library = F.transform(chosen_once, lambda i: F.element_at(fixed, i + 1))
    known = F.array(*[F.lit(x) for x in actions])
    of_set = F.transform("_mined", lambda x, j: F.struct(
        x["lost"].alias("lost"), number(1).alias("stream"), x["less"].alias("less"), j.alias("order"),
        F.when(F.col("_clash"), F.coalesce(F.nullif(F.array_position(known, x["action"]).cast("int") - 1, number(-1)), -1 - j)).otherwise(-1 - j).alias("action"), number(groups.index(MINED_CATEGORY)).alias("category"),
    ))
    kind = T.DataType.fromDDL("array<struct<lost: double, stream: int, less: double, order: int, action: int, category: int>>")
    every = F.array_sort(F.concat(of_library.cast(kind), F.coalesce(of_set.cast(kind), F.array().cast(kind))))
    first = lambda x, i: ~F.exists(F.slice("_every", F.lit(1), i), lambda y: y["action"] == x["action"])
    repeats = F.lit(len(set(actions)) < len(actions)) | F.coalesce("_clash", F.lit(False))
    once = F.when(repeats, F.filter("_every", first)).otherwise(F.col("_every"))
    fits = lambda kept, x: (F.size(kept) < in_total) & (F.size(F.filter(kept, lambda y: y["category"] == x["category"])) < per_category)
    capped = F.aggregate("_once", F.array().cast(kind), lambda kept, x: F.when(fits(kept, x), F.array_append(kept, x)).otherwise(kept))
    slim = F.transform("_kept", lambda x, i: F.struct(
        (i + 1).alias("priority"), F.when(x["stream"] == 0, x["order"]).alias("position"), (-x["lost"]).alias("composite_score"), (-x["less"]).alias("score"),
        F.when(x["stream"] == 1, F.get("_mined", x["order"])["text"]).alias("mined"),
    ))
    ranked = joined.withColumn("_every", every).withColumn("_once", once).withColumn("_kept", capped)
    return ranked.filter(F.size("_kept") > 0).select(key, "rows", slim.alias("plan"))


def plan_texts(library: Mapping[str, Mapping[str, Any]], fields: Sequence[str], values: Sequence[str], rows: str = "rows", plan: str = "plan") -> Column:
    """The actions of a ``compact_plans`` row with ``fields`` of ``ranked_plan``'s columns; ``values`` are the names in its rows' values."""
    entries = [(name, x, _template_fields(x, values)) for name, x in library.items()]
    labels = lambda c: CATEGORY_LABELS.get(c, c.replace("_", " ").title())
    given = {
        "key": lambda k, x: k, "action": lambda k, x: x["action"], "category": lambda k, x: x["category"],
        "category_label": lambda k, x: labels(x["category"]), "evidence_grade": lambda k, x: x.get("evidence_grade", "C"),
        "evidence_strength": lambda k, x: STRENGTHS.get(x.get("evidence_grade", "C"), "low"), "source": lambda k, x: x.get("source", ""),
        "reduces_readmission_by_pct": lambda k, x: x.get("reduces_readmission_by_pct", 0), "responsible_role": lambda k, x: x.get("responsible_role", "care_coordinator"),
        "time_sensitivity": lambda k, x: x.get("time_sensitivity", "before_discharge"), "evidence_source": lambda k, x: "clinical_library",
    }
    of_mined = {
        "category": MINED_CATEGORY, "category_label": labels(MINED_CATEGORY), "evidence_grade": "B", "evidence_strength": STRENGTHS["B"],
        "responsible_role": "care_coordinator", "time_sensitivity": "before_discharge", "evidence_source": "association_rules",
    }

    def rationale(x: Column) -> Column:
        at = x["position"].cast("smallint")
        own = F.filter(rows, lambda r: F.array_contains(r["positions"], at))[0]["values"]
        found = x["mined"]["rationale"]
        for i, (_, rule, named) in enumerate(entries):
            template = F.lit(rule.get("rationale_template", rule.get("action", "")))
            found = F.when(x["position"] == i, fill_template(template, {f: own[f] for f in named}) if named else template).otherwise(found)
        return found

    def field(name: str, x: Column) -> Column:
        if name in ("priority", "composite_score", "score"):
            return x[name]
        if name == "rationale":
            return rationale(x)
        fixed = F.element_at(F.array(*[F.lit(given[name](k, rule)) for k, rule, _ in entries]), x["position"] + 1)
        return F.when(x["position"].isNull(), F.lit(of_mined[name]) if name in of_mined else x["mined"][name]).otherwise(fixed)

    return F.transform(plan, lambda x: F.struct(*[field(name, x).alias(name) for name in fields]))


def nested_plans(plan: DataFrame, key: str) -> DataFrame:
    """One row per entity with its actions in order; at most ten, so the array is small."""
    return plan.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*NESTED))).alias("recommendations"))


def care_plans(features: DataFrame, plan: DataFrame, cohorts: DataFrame, key: str = "admission_id", entity: str = "patient_id", score: str = "risk_score") -> DataFrame:
    """One row per row of ``features``: score, tier, risk factors, ranked actions, the categories that they cover, and the entity's cohort
    (``cohorts``: entity, cohort_name) with the mean score of its rows. Rows without a cohort have ``Unknown`` and 0.5.
    """
    covered = plan.groupBy(key).agg(F.count(F.lit(1)).alias("_count"), F.array_sort(F.collect_set("category")).alias("_categories"))  # ten actions at most
    return _with_actions(features, nested_plans(plan, key).join(covered, key), cohorts, key, entity, score)


def nested_care_plans(
    features: DataFrame, nested: DataFrame, cohorts: DataFrame, key: str = "admission_id", entity: str = "patient_id", score: str = "risk_score"
) -> DataFrame:
    """``care_plans`` of plans that are one row a key already (``key, recommendations`` with at least their category)."""
    categories = F.array_sort(F.array_distinct(F.transform("recommendations", lambda x: x["category"])))
    return _with_actions(features, nested.select(key, "recommendations", F.size("recommendations").cast("long").alias("_count"), categories.alias("_categories")), cohorts, key, entity, score)


def _with_actions(features: DataFrame, actions: DataFrame, cohorts: DataFrame, key: str, entity: str, score: str) -> DataFrame:
    risk = F.col(score).cast("decimal(10,4)")
    scored = features.select(key, entity, F.round(score, 4).alias("risk_score"), scoring.risk_tier(score).alias("risk_tier"), scoring.threshold_factors().alias("risk_factors"), risk.alias("_risk"))
    placed = scored.join(cohorts.select(entity, "cohort_name"), entity, "left")
    means = placed.where(F.col("cohort_name").isNotNull()).groupBy("cohort_name").agg(F.round(F.sum("_risk").cast("decimal(38,8)") / F.count("_risk"), 4).cast("double").alias("_mean"))
    found = placed.join(means, "cohort_name", "left").join(actions, key, "left")
    return found.select(
        key, entity, "risk_score", "risk_tier", "risk_factors", "recommendations", F.coalesce("_count", F.lit(0)).alias("recommendation_count"),
        F.coalesce("_categories", F.array().cast("array<string>")).alias("categories_covered"), F.coalesce("cohort_name", F.lit("Unknown")).alias("cohort_name"),
        F.coalesce("_mean", F.lit(UNKNOWN_RISK)).alias("cohort_average_risk"),
    )

"""Basket, rule and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.catalog.scoring import ASSIGNED, FACTORS, FEATURE_TABLES, HEURISTIC, features
from tidemark.functions.scoring import heuristic_score
from tidemark.operators import baskets as b
from tidemark.operators import recommend as r
from tidemark.plans import marts
from tidemark.sources.action_library import ACTION_LIBRARY

BASKET_SQL = "b AS MATERIALIZED (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k) AS n FROM b)"
TAGGED_SQL = """b AS MATERIALIZED (SELECT DISTINCT k, i FROM (SELECT l_orderkey AS k, 'DX:' || p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT l_orderkey, 'CPT:' || l_returnflag || l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'NO_READMIT' FROM orders WHERE o_orderstatus <> 'F')), n AS (SELECT count(DISTINCT k) AS n FROM b)"""


def itemset_sql(min_support: float, max_items: int) -> str:
    parts = []
    for size in range(1, max_items + 1):
        names = [f"b{j}" for j in range(size)]
        joins = "".join(f" JOIN b {names[j]} ON {names[j]}.k = b0.k AND {names[j]}.i > {names[j - 1]}.i" for j in range(1, size))
        parts.append(
            f"SELECT [{', '.join(f'{x}.i' for x in names)}] AS items, count(*) AS freq FROM b b0{joins} GROUP BY ALL HAVING count(*) >= ceil({min_support} * (SELECT n FROM n))"
        )
    return "sets AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def rules_sql(min_confidence: float, min_lift: float) -> str:
    """Halves of a set are looked up by their text."""
    return f"""named AS MATERIALIZED (SELECT array_to_string(items, '|') AS name, freq FROM sets),
halves AS MATERIALIZED (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedents, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS consequents, freq FROM (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS m FROM sets WHERE len(items) > 1)),
rules AS MATERIALIZED (SELECT antecedents, consequents, support, confidence, lift, conviction, evidence_count FROM (
 SELECT antecedents, consequents, s.freq / n AS support, s.freq / a.freq AS confidence, (s.freq / a.freq) / (c.freq / n) AS lift, CASE WHEN s.freq = a.freq THEN 'Infinity'::DOUBLE ELSE (1 - c.freq / n) / (1 - s.freq / a.freq) END AS conviction, s.freq AS evidence_count
 FROM halves s JOIN named a ON a.name = array_to_string(antecedents, '|') JOIN named c ON c.name = array_to_string(consequents, '|'), n) WHERE confidence >= {min_confidence} AND lift >= {min_lift})"""


def orders_with_brands(spark, sf):
    part = v.table(spark, sf, "part").select("p_partkey", "p_brand")
    return v.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def brand_baskets(spark, sf):
    return b.baskets(orders_with_brands(spark, sf), "l_orderkey", "p_brand")


def tagged(spark, sf):
    outcomes = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("admission_id"), (F.col("o_orderstatus") == "F").alias("readmit_30day_flag")
    )
    items = orders_with_brands(spark, sf).withColumnRenamed("l_orderkey", "admission_id")
    return b.tagged_baskets(
        outcomes, items.select("admission_id", F.col("p_brand").alias("icd10_code")),
        items.select("admission_id", F.concat("l_returnflag", "l_linestatus").alias("cpt_code")),
    )


def shown(c: str):
    return F.array_join(c, "|").alias(c)


@query("bm01_baskets", v.with_tables(BASKET_SQL, "SELECT k AS l_orderkey, string_agg(i, '|' ORDER BY i) AS items FROM b GROUP BY 1"))
def baskets(spark, sf):
    return brand_baskets(spark, sf).select("l_orderkey", shown("items"))


@query("bm02_tagged_baskets", v.with_tables(TAGGED_SQL, "SELECT k AS admission_id, string_agg(i, '|' ORDER BY i) AS items FROM b GROUP BY 1"))
def tagged_baskets(spark, sf):
    return tagged(spark, sf).select("admission_id", shown("items"))


@query("bm03_frequent_itemsets", v.with_tables(BASKET_SQL, itemset_sql(0.002, 4), "SELECT array_to_string(items, '|') AS items, freq, n AS baskets, freq / n AS support FROM sets, n"))
def itemsets(spark, sf):
    return b.frequent_itemsets(brand_baskets(spark, sf), 0.002, 4).select(shown("items"), "freq", "baskets", "support")


def rules(spark, sf):
    return v.stored(spark, sf, "association-rules", lambda: b.association_rules(b.frequent_itemsets(brand_baskets(spark, sf), 0.002, 4), 0.05, 1.0))


@query("bm04_association_rules", v.with_tables(BASKET_SQL, itemset_sql(0.002, 4), rules_sql(0.05, 1.0), """SELECT array_to_string(antecedents, '|') AS antecedents, CASE WHEN len(consequents) = 1 THEN consequents[1] ELSE '[''' || array_to_string(consequents, ''', ''') || ''']' END AS consequent, support, confidence, lift, conviction, evidence_count FROM rules"""))
def association_rules(spark, sf):
    return rules(spark, sf).select(shown("antecedents"), "consequent", "support", "confidence", "lift", "conviction", "evidence_count")


OUTCOME_SQL = (TAGGED_SQL, itemset_sql(0.005, 5), rules_sql(0.3, 0.0), "outcome AS (SELECT * FROM rules WHERE list_contains(consequents, 'NO_READMIT'))")


def outcome_rules(spark, sf):
    return v.stored(spark, sf, "outcome-rules", lambda: b.outcome_rules(b.frequent_itemsets(tagged(spark, sf), 0.005, 5), 0.3))


@query("bm05_outcome_rules", v.with_tables(*OUTCOME_SQL, "SELECT array_to_string(antecedents, '|') AS antecedents, 'NO_READMIT' AS consequent, support, confidence, lift, conviction, evidence_count FROM outcome"))
def effectiveness(spark, sf):
    return outcome_rules(spark, sf).select(shown("antecedents"), "consequent", "support", "confidence", "lift", "conviction", "evidence_count")


def profiles(spark, sf):
    found = orders_with_brands(spark, sf).select("l_orderkey", F.concat(F.lit("DX:"), "p_brand").alias("item"))
    return b.baskets(found, "l_orderkey", "item")


#: Items as bits of a number: a vocabulary of this size fits into one.
MATCH_SQL = """bits AS (SELECT i, 1::BIGINT << (row_number() OVER (ORDER BY i) - 1) AS bit FROM (SELECT DISTINCT i FROM b)),
wanted AS (SELECT list_filter(antecedents, lambda x: x <> 'NO_READMIT') AS needed, confidence, lift, evidence_count, lift * confidence * ln(1 + evidence_count) AS weight, array_to_string(antecedents, '|') AS own, array_to_string(consequents, '|') AS other FROM outcome),
named_rules AS (SELECT *, array_to_string(needed, '|') AS text, row_number() OVER (PARTITION BY array_to_string(needed, '|') ORDER BY weight DESC, own, other) AS place FROM wanted WHERE len(needed) > 0),
rule_bits AS (SELECT text, CAST(sum(bit) AS BIGINT) AS own_bits FROM (SELECT text, unnest(needed) AS i FROM named_rules WHERE place = 1) JOIN bits USING (i) GROUP BY 1),
r AS MATERIALIZED (SELECT needed, text, confidence, lift, evidence_count, weight, len(needed) AS size, own_bits,
 CASE WHEN len(list_filter(needed, lambda x: x LIKE 'CPT:%')) > 0 THEN 'Apply intervention bundle: ' || array_to_string(list_sort(list_filter(needed, lambda x: x LIKE 'CPT:%')), ', ') ELSE 'Continue current care protocols' END AS action
 FROM named_rules JOIN rule_bits USING (text) WHERE place = 1),
e AS MATERIALIZED (SELECT k, CAST(sum(bit) AS BIGINT) AS item_bits, list(i ORDER BY i) AS own_items FROM b JOIN bits USING (i) WHERE i LIKE 'DX:%' GROUP BY 1),
m AS (SELECT item_bits, text, action, weight * (bit_count(item_bits & own_bits) / size) AS p FROM (SELECT DISTINCT item_bits FROM e), r WHERE 2 * bit_count(item_bits & own_bits) >= size),
best AS MATERIALIZED (SELECT item_bits, action, -min(row(-p, text))[1] AS p, min(row(-p, text))[2] AS text FROM m GROUP BY 1, 2),
top AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p DESC, text) AS rank, action, p, confidence, lift, evidence_count, needed, own_items FROM e JOIN best USING (item_bits) JOIN (SELECT text, confidence, lift, evidence_count, needed FROM r) USING (text))"""
RATIONALE_SQL = """'In ' || evidence_count || ' similar patients with [' || array_to_string(list_transform(list_filter(own_items, lambda x: list_contains(needed, x)), lambda x: '''' || replace(x, 'DX:', '') || ''''), ', ') || '], this care path reduced readmission (confidence=' || printf('%.0f', round_even(confidence * 100, 0)) || '%, lift=' || printf('%.2f', lift) || 'x vs baseline).'"""


@query("bm06_rule_matches", v.with_tables(*OUTCOME_SQL, MATCH_SQL, "SELECT k AS l_orderkey, action, round(p, 4) AS priority_score FROM top"))
def rule_matches(spark, sf):
    found = r.match_rules(profiles(spark, sf), outcome_rules(spark, sf), "l_orderkey", n=None)
    return found.select("l_orderkey", "action", F.round("priority_score", 4).alias("priority_score"))


@query("bm06_top_recommendations_per_order", v.with_tables(*OUTCOME_SQL, MATCH_SQL,
f"SELECT k AS l_orderkey, rank, action, {RATIONALE_SQL} AS rationale, array_to_string(list_filter(own_items, lambda x: list_contains(needed, x)), '|') AS antecedents_matched, round(p, 6) AS priority_score FROM top WHERE rank <= 5"))
def top_recommendations(spark, sf):
    found = r.match_rules(profiles(spark, sf), outcome_rules(spark, sf), "l_orderkey", n=5)
    matched = F.array_join("antecedents_matched", "|").alias("antecedents_matched")
    return found.select("l_orderkey", "rank", "action", "rationale", matched, F.round("priority_score", 6).alias("priority_score"))


@query("bm07_top_rules_by_lift", v.with_tables(BASKET_SQL, itemset_sql(0.002, 4), rules_sql(0.05, 1.0), "SELECT array_to_string(antecedents, '|') AS antecedents, lift, evidence_count FROM rules ORDER BY rules.lift DESC, evidence_count DESC, rules.antecedents, consequents LIMIT 25"))
def top_rules(spark, sf):
    return b.top_rules(rules(spark, sf), 25, b.CO_OCCURRENCE).select(shown("antecedents"), "lift", "evidence_count")


CODES_SQL = "coded AS (SELECT features.*, insurance_category, list_filter([CASE WHEN CAST(admission_id AS BIGINT) % 5 = 0 THEN 'I21.9' END, CASE WHEN CAST(admission_id AS BIGINT) % 7 = 0 THEN 'A41.51' END], lambda x: x IS NOT NULL) AS codes FROM features JOIN stg_patients USING (patient_id))"
TRUE_FALSE = {True: "TRUE", False: "FALSE"}


def predicate_sql(rule) -> str:
    parts = []
    for field, value in rule["triggers"].items():
        if field.endswith("__gte"):
            parts.append(f"coalesce({field[:-5]}, 0) >= {value}")
        elif field == "readmit_30day_flag__history_gte":
            parts.append("FALSE")
        elif isinstance(value, bool):
            parts.append(f"coalesce({field} = 1, FALSE) = {TRUE_FALSE[value]}")
        else:
            parts.append(f"coalesce({field} = '{value}', FALSE)")
    either = []
    if parts:
        either.append("(" + " AND ".join(parts) + ")")
    if rule["icd10_trigger"]:
        either.append("list_has_any(codes, [" + ", ".join(f"'{c}'" for c in rule["icd10_trigger"]) + "])")
    return " OR ".join(either) or "TRUE"


LIBRARY_SQL = "lib(key, position, category, score, pct, grade, bonus) AS (VALUES " + ", ".join(
    f"('{k}', {i}, '{x['category']}', {x['reduces_readmission_by_pct'] * r.GRADE_WEIGHTS[x['evidence_grade']]}, {x['reduces_readmission_by_pct']}, {r.GRADE_WEIGHTS[x['evidence_grade']]}, {3 - r.TIME_ORDER[x['time_sensitivity']]})"
    for i, (k, x) in enumerate(ACTION_LIBRARY.items())
) + """), hits AS (SELECT admission_id, unnest(list_filter([""" + ", ".join(f"CASE WHEN {predicate_sql(x)} THEN '{k}' END" for k, x in ACTION_LIBRARY.items()) + """], lambda x: x IS NOT NULL)) AS key FROM coded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY admission_id ORDER BY score DESC, position) AS r FROM hits JOIN lib USING (key))"""


def coded_features(spark, sf):
    number = F.col("admission_id").cast("bigint")
    payer = v.patients(spark, sf).select("patient_id", "insurance_category")
    codes = F.array(F.when(number % 5 == 0, "I21.9"), F.when(number % 7 == 0, "A41.51"))
    return features(spark, sf).join(payer, "patient_id").withColumn("codes", F.filter(codes, lambda x: x.isNotNull()))


@query("bm08_library_matches", v.with_tables(*FEATURE_TABLES, CODES_SQL, LIBRARY_SQL, "SELECT admission_id, key FROM hits"))
def library_matches(spark, sf):
    return r.library_candidates(coded_features(spark, sf), ACTION_LIBRARY, "admission_id", "codes", n=len(ACTION_LIBRARY)).select("admission_id", "key")


@query("bm09_library_ranking", v.with_tables(*FEATURE_TABLES, CODES_SQL, LIBRARY_SQL, "SELECT admission_id, key, CAST(score AS DOUBLE) AS score FROM ranked WHERE r <= 5"))
def library_ranking(spark, sf):
    return r.library_candidates(coded_features(spark, sf), ACTION_LIBRARY, "admission_id", "codes", n=5).select("admission_id", "key", "score")


@query("bm09_library_rationales")
def library_rationales(spark, sf):
    return r.library_candidates(coded_features(spark, sf), ACTION_LIBRARY, "admission_id", "codes").select("admission_id", "key", "action", "rationale")


@query("bm10_override_by_key", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'custom' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def override(spark, sf):
    default = v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    custom = default.filter("c_nationkey < 10").withColumn("c_mktsegment", F.lit("custom"))
    return r.override_by_key(default, custom, "c_custkey").drop("c_nationkey")


PLAN_SQL = (*FEATURE_TABLES, CODES_SQL, LIBRARY_SQL, *OUTCOME_SQL, MATCH_SQL, """mined AS (SELECT CAST(k AS VARCHAR) AS admission_id, action AS name, 'discharge_planning' AS category, round(p, 4) AS score, 2 * round_even(round(confidence, 4) * 30, 0) + 3 * 2 + round(p, 4) * 5 AS composite FROM top WHERE rank <= 5),
c AS (SELECT admission_id, key AS name, category, CAST(score AS DOUBLE) AS score, CAST(grade * pct + bonus * 2 + score * 5 AS DOUBLE) AS composite, 0 AS stream, position FROM ranked WHERE r <= 20 UNION ALL SELECT admission_id, name, category, score, composite, 1, 0 FROM mined),
t AS (SELECT *, row_number() OVER (PARTITION BY admission_id, category ORDER BY composite DESC, stream, score DESC, position, name) AS rc FROM c),
plan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY admission_id ORDER BY composite DESC, stream, score DESC, position, name) AS priority FROM t WHERE rc <= 3) WHERE priority <= 10)""")


def ranked_actions(spark, sf):
    """Plans of library and mined actions, a row for each admission, without the library's texts."""

    def build():
        orders = profiles(spark, sf).withColumn("admission_id", F.col("l_orderkey").cast("string"))
        return r.compact_plans(coded_features(spark, sf), ACTION_LIBRARY, "admission_id", "codes", *r.matched_sets(orders, outcome_rules(spark, sf), "admission_id"))

    return v.stored(spark, sf, "ranked-plan", build)


def actions_with(spark, sf, *fields):
    """Plans whose actions have some fields; an action's name is the library's key or the mined action."""
    plans = ranked_actions(spark, sf)
    values = plans.schema["rows"].dataType.elementType["values"].dataType.names
    return plans.select("admission_id", r.plan_texts(ACTION_LIBRARY, fields, values).alias("recommendations"))


@query("bm11_ranked_plan", v.with_tables(*PLAN_SQL, "SELECT admission_id, name, composite AS composite_score, priority FROM plan"))
def plan(spark, sf):
    name = F.when(F.col("evidence_source") == "association_rules", F.col("action")).otherwise(F.col("key"))
    found = actions_with(spark, sf, "key", "action", "evidence_source", "composite_score", "priority").select("admission_id", F.inline("recommendations"))
    return found.select("admission_id", name.alias("name"), "composite_score", "priority")


@query("bm11_ranked_plan_of_both_streams", v.with_tables(*PLAN_SQL, "SELECT admission_id, CASE WHEN stream = 0 THEN name END AS key, category, stream = 1 AS is_mined, composite AS composite_score, priority FROM plan"))
def plan_of_both(spark, sf):
    is_mined = F.col("evidence_source") == "association_rules"
    found = actions_with(spark, sf, "key", "category", "evidence_source", "composite_score", "priority").select("admission_id", F.inline("recommendations"))
    return found.select(
        "admission_id", F.when(~is_mined, F.col("key")).alias("key"), "category", is_mined.alias("is_mined"), "composite_score", "priority"
    )


@query("bm12_plans_for_all_admissions")
def plans(spark, sf):
    nested = actions_with(spark, sf, *r.NESTED)
    return nested.withColumn("recommendations", F.to_json("recommendations"))


@query("bm12_care_plans", v.with_tables(*PLAN_SQL, ASSIGNED, f"""scored AS (SELECT admission_id, patient_id, round({HEURISTIC}, 4) AS risk_score, {FACTORS} AS factors, risk_cohort FROM features LEFT JOIN (SELECT patient_id, risk_cohort FROM assigned) USING (patient_id)),
means AS (SELECT risk_cohort, {v.mean_sql('risk_score', 4)} AS cohort_average_risk FROM scored WHERE risk_cohort IS NOT NULL GROUP BY 1),
acts AS (SELECT admission_id, string_agg(name, '|' ORDER BY priority) AS actions, count(*) AS recommendation_count, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM plan GROUP BY 1)""",
"""SELECT admission_id, patient_id, risk_score, CASE WHEN risk_score >= 0.80 THEN 'critical' WHEN risk_score >= 0.65 THEN 'high' WHEN risk_score >= 0.35 THEN 'medium' ELSE 'low' END AS risk_tier, factors, coalesce(actions, '') AS actions,
 coalesce(recommendation_count, 0) AS recommendation_count, coalesce(categories, '') AS categories, coalesce(risk_cohort, 'Unknown') AS cohort_name, coalesce(cohort_average_risk, 0.5::DOUBLE) AS cohort_average_risk
FROM scored LEFT JOIN means USING (risk_cohort) LEFT JOIN acts USING (admission_id)"""))
def care_plans(spark, sf):
    """Whole plans, nested parts as text; a library action is shown by its key."""
    scored = features(spark, sf).withColumn("risk_score", F.round(heuristic_score(), 4))
    cohorts = marts.patient_risk_cohorts(v.admissions(spark, sf), v.patients(spark, sf), v.comorbidity(spark, sf), v.history(spark, sf))
    name = lambda x: F.when(x["evidence_source"] == "association_rules", x["action"]).otherwise(x["key"])
    shown = actions_with(spark, sf, "key", "action", "category", "evidence_source")
    shown = shown.withColumn("recommendations", F.transform("recommendations", lambda x: F.struct(name(x).alias("action"), x["category"].alias("category"))))
    found = r.nested_care_plans(scored, shown, cohorts.select("patient_id", F.col("risk_cohort").alias("cohort_name")))
    return found.select(
        "admission_id", "patient_id", "risk_score", "risk_tier", F.array_join(F.transform("risk_factors", lambda x: x["feature"]), ",").alias("factors"),
        F.coalesce(F.array_join(F.transform("recommendations", lambda x: x["action"]), "|"), F.lit("")).alias("actions"), "recommendation_count",
        F.array_join("categories_covered", ",").alias("categories"), "cohort_name", "cohort_average_risk",
    )

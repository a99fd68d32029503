"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.operators import joins as j
from tidemark.operators.history import lookback_history


@query("jn01_inner_star_join", """SELECT n_name, r_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def inner_star(spark, sf):
    t = lambda name: v.table(spark, sf, name)
    star = j.star_join(t("orders"), [
        (t("customer"), "o_custkey", "c_custkey", "inner"), (t("nation"), "c_nationkey", "n_nationkey", "inner"),
        (t("region"), "n_regionkey", "r_regionkey", "inner"),
    ])
    return star.groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    )


@query("jn02_one_dimension_in_two_roles", """WITH d AS (SELECT DISTINCT CAST(x AS DATE) AS full_date FROM (SELECT o_orderdate AS x FROM orders UNION ALL SELECT l_shipdate FROM lineitem))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, year(a.full_date) AS admit_year, quarter(s.full_date) AS ship_quarter FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN d a ON a.full_date = CAST(o_orderdate AS DATE) LEFT JOIN d s ON s.full_date = CAST(l_shipdate AS DATE)""")
def two_roles(spark, sf):
    orders, items = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    days = orders.select(F.to_date("o_orderdate").alias("full_date")).unionByName(
        items.select(F.to_date("l_shipdate").alias("full_date"))
    ).distinct().withColumns({"year": F.year("full_date"), "quarter": F.quarter("full_date")})
    fact = items.join(orders, items.l_orderkey == orders.o_orderkey, "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.to_date("o_orderdate").alias("admitted"), F.to_date("l_shipdate").alias("shipped")
    )
    star = j.star_join(fact, [
        (j.in_role(days, "admit_"), "admitted", "admit_full_date", "left"), (j.in_role(days, "ship_"), "shipped", "ship_full_date", "left"),
    ])
    return star.select("l_orderkey", "l_linenumber", "l_partkey", "admit_year", "ship_quarter")


@query("jn03_case_insensitive_lookup", v.with_tables(*v.ADMISSION_TABLES, """SELECT admission_id, code AS disposition_code FROM stg_admissions LEFT JOIN (VALUES ('01', 'Home'), ('03', 'Skilled Nursing Facility'), ('20', 'Expired')) AS t(code, label) ON lower(label) = lower(discharge_disposition)"""))
def ignore_case_lookup(spark, sf):
    from tidemark.sources.literals import dispositions

    found = j.lookup_key(
        v.admissions(spark, sf), dispositions(spark), "discharge_disposition", "disposition_name", "disposition_code", ignore_case=True
    )
    return found.select("admission_id", "disposition_code")


@query("jn04_code_enrichment", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, n AS brand_parts, top_type FROM lineitem JOIN part ON l_partkey = p_partkey
 LEFT JOIN (SELECT upper(p_brand) AS code, count(*) AS n, min(p_type) AS top_type FROM part WHERE p_size > 2 GROUP BY 1) r ON r.code = upper(trim(p_brand))""")
def enrichment(spark, sf):
    part = v.table(spark, sf, "part")
    reference = part.filter(F.col("p_size") > 2).groupBy(F.upper("p_brand").alias("code")).agg(
        F.count(F.lit(1)).alias("brand_parts"), F.min("p_type").alias("top_type")
    )
    items = v.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    found = j.enrich(items, reference, F.upper(F.trim("p_brand")), "code", ["brand_parts", "top_type"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "brand_parts", "top_type")


@query("jn05_history_of_entity", """SELECT c.event_id, count(p.event_id) FILTER (WHERE CAST(p.ts AS DATE) >= CAST(c.ts AS DATE) - INTERVAL 12 MONTH) AS prior_admissions_12m, count(p.event_id) FILTER (WHERE CAST(p.ts AS DATE) >= CAST(c.ts AS DATE) - INTERVAL 7 DAY) AS prior_7d,
 strftime(max(CAST(p.ts AS DATE)), '%Y-%m-%d') AS last_seen FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND CAST(p.ts AS DATE) < CAST(c.ts AS DATE) GROUP BY c.event_id""")
def history_of_entity(spark, sf):
    events = v.table(spark, sf, "events").withColumns(
        {"day": F.to_date("ts"), "stay": F.lit(1), "error": F.col("event_type") == "error", "click": F.col("event_type") == "click"}
    )
    past = lookback_history(
        events, "user_id", "event_id", "day", "day", "stay", "error", "click", short_window="7 DAYS"
    )
    return past.select("event_id", "prior_admissions_12m", F.col("prior_admissions_90d").alias("prior_7d"), F.col("last_discharge_date").alias("last_seen"))


@query("jn07_orphans", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, sf):
    return j.orphans(v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("jn08_join_with_default", """SELECT doc_id, CAST(coalesce(quality, -1) AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def with_default(spark, sf):
    return j.with_default(v.table(spark, sf, "documents").select("doc_id"), v.table(spark, sf, "labels"), "doc_id", "quality", F.lit(-1))


@query("jn09_latest_with_ties", """SELECT event_id, user_id FROM events e WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events x WHERE x.user_id = e.user_id)""")
def latest_with_ties(spark, sf):
    events = v.table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return j.latest_with_ties(events, "user_id", "day").select("event_id", "user_id")


@query("jn10_aligned_counts", """SELECT coalesce(b.event_type, c.event_type) AS event_type, CAST(coalesce(b.n, 0) AS BIGINT) AS baseline_count, CAST(coalesce(c.n, 0) AS BIGINT) AS current_count
 FROM (SELECT event_type, count(*) AS n FROM events WHERE ts < '2024-01-20' GROUP BY 1) b FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts >= '2024-01-20' GROUP BY 1) c ON b.event_type IS NOT DISTINCT FROM c.event_type""")
def aligned_counts(spark, sf):
    events = v.table(spark, sf, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return j.align_counts(events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut), "event_type")


@query("so01_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in v.ALL_TABLES))
def row_counts(spark, sf):
    from tidemark.operators.lineage import row_counts as counts

    return counts({t: v.table(spark, sf, t) for t in v.ALL_TABLES})


@query("so02_union_newest_first", """SELECT o_orderkey AS job_id, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY src, o_orderdate DESC) AS r FROM
 (SELECT 0 AS src, o_orderkey, o_orderdate, 'live' AS o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, o_orderkey, o_orderdate, o_orderstatus FROM orders)) WHERE r = 1""")
def union_newest(spark, sf):
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    live = orders.filter(F.col("status") == "O").withColumn("status", F.lit("live"))
    return j.union_newest({0: live, 1: orders}, "job_id", "created_at").select("job_id", "status")


@query("so03_insert_if_absent", """SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def insert_if_absent(spark, sf):
    existing = v.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return j.insert_if_absent(existing, v.table(spark, sf, "lineitem").select("l_orderkey"), ["l_orderkey"])


@query("so04_version_slice", """SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS version, unnest([lang, source]) AS tables_affected FROM documents WHERE doc_id > 100 AND doc_id <= 900""")
def version_slice(spark, sf):
    from tidemark.operators.lineage import version_changes

    migrations = v.table(spark, sf, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("version"), F.to_json(F.array("lang", "source")).alias("tables_affected")
    )
    return version_changes(migrations, "000000100", "000000900")

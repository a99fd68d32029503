"""Masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog import views as v
from tidemark.functions import masking as m
from tidemark.operators.masking import mask_audit, mask_table

KEY = b"0123456789"
_INNER = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0"))
_OUTER = bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0"))


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def _token(c: str) -> str:
    inner = f"sha256({_blob(_INNER)} || encode({c}))"
    return f"'ANON-' || upper(left(sha256({_blob(_OUTER)} || unhex({inner})), 8))"


NAMES_SQL = "CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN 'nan' WHEN c_custkey % 13 <> 0 THEN c_name END"
DIGITS_SQL = "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 THEN NULL ELSE '(' || lpad(CAST(c_custkey AS VARCHAR), 3, '5') || ') ' || substr(c_name, 13, 3) || '-' || substr(c_name, 12, 4) END"
NAMES = NAMES_SQL
DIGITS = DIGITS_SQL.replace("VARCHAR", "STRING")


@query("pm01_pseudonyms", f"SELECT c_custkey, CASE WHEN name IS NULL THEN NULL WHEN trim(name) IN ('', 'nan') THEN 'ANON-UNKNOWN' ELSE {_token('name')} END AS token FROM (SELECT c_custkey, {NAMES_SQL} AS name FROM customer)")
def pseudonyms(spark, sf):
    named = v.table(spark, sf, "customer").select("c_custkey", F.expr(NAMES).alias("name"))
    return named.select("c_custkey", m.pseudonymize("name", KEY).alias("token"))


@query("pm02_ssn_last_four", """SELECT c_custkey, CASE WHEN s IS NULL THEN NULL WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) = 9 THEN '***-**-' || right(regexp_replace(s, '[^0-9]', '', 'g'), 4) ELSE '***-**-****' END AS ssn
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN substr(c_name, 10) || '-' WHEN c_custkey % 6 = 1 THEN NULL ELSE c_name END AS s FROM (SELECT c_custkey, replace(c_name, 'Customer#', 'Customer#') AS c_name FROM customer))""")
def ssn(spark, sf):
    raw = F.expr("CASE WHEN c_custkey % 6 = 0 THEN concat(substr(c_name, 10), '-') WHEN c_custkey % 6 = 1 THEN NULL ELSE c_name END")
    return v.table(spark, sf, "customer").select("c_custkey", m.mask_ssn(raw).alias("ssn"))


@query("pm03_phone_area", f"""SELECT c_custkey, CASE WHEN p IS NULL THEN NULL WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) >= 10 THEN left(regexp_replace(p, '[^0-9]', '', 'g'), 3) || '-***-****' ELSE '***-***-****' END AS phone FROM (SELECT c_custkey, {DIGITS_SQL} AS p FROM customer)""")
def phone(spark, sf):
    return v.table(spark, sf, "customer").select("c_custkey", m.mask_phone(F.expr(DIGITS)).alias("phone"))


@query("pm04_address", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN '[ADDRESS REDACTED]' END AS address FROM pages")
def address(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", m.mask_address(F.when(F.col("page_id") % 4 != 0, F.col("url"))).alias("address"))


@query("pm05_email_domain", """SELECT doc_id, CASE WHEN regexp_extract(text, '@([a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})', 1) <> '' THEN '@' || regexp_extract(text, '@([a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})', 1) ELSE '[EMAIL REDACTED]' END AS email FROM documents""")
def email(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", m.mask_email("text").alias("email"))


@query("pm06_birth_year", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'UNKNOWN' END AS born FROM orders""")
def birth_year(spark, sf):
    date = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(date, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(date, "MM/dd/yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(date, "dd-MM-yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format(date, "yyyy/MM/dd"))
        .otherwise(F.date_format(date, "MMM yyyy"))
    )
    return v.table(spark, sf, "orders").select("o_orderkey", m.generalize_year(text).alias("born"))


def scrub_sql(c: str) -> str:
    for pattern, token in m.SCRUB_PATTERNS:
        c = f"regexp_replace({c}, '{pattern}', '{token}', 'g')"
    return c


@query("pm07_scrubbed_documents", f"SELECT doc_id, md5({scrub_sql('text')}) AS digest FROM documents")
def scrubbed_documents(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.md5(m.scrub_text("text").cast("binary")).alias("digest"))


@query("pm07_scrubbed_conversations", f"SELECT conv_id, turn, {scrub_sql('text')} AS text FROM conversations")
def scrubbed_conversations(spark, sf):
    return v.table(spark, sf, "conversations").select("conv_id", "turn", m.scrub_text("text").alias("text"))


@query("pm08_masked_table", f"SELECT c_custkey, CASE WHEN full_name IS NULL THEN NULL WHEN trim(full_name) IN ('', 'nan') THEN 'ANON-UNKNOWN' ELSE {_token('full_name')} END AS full_name, '[ADDRESS REDACTED]' AS address FROM (SELECT c_custkey, {NAMES_SQL} AS full_name FROM customer)")
def masked_table(spark, sf):
    raw = v.table(spark, sf, "customer").select("c_custkey", F.expr(NAMES).alias("full_name"), F.col("c_mktsegment").alias("address"))
    return mask_table(raw, {"full_name": "pseudonymize", "address": "mask_address", "ssn": "mask_ssn"}, KEY)


@query("pm09_mask_audit", f"""SELECT 'customer' AS table_name, 'full_name' AS column_name, 'pseudonymize' AS strategy, count(n) AS masked FROM (SELECT {NAMES_SQL} AS n FROM customer)
 UNION ALL SELECT 'customer', 'phone', 'mask_phone', count(p) FROM (SELECT {DIGITS_SQL} AS p FROM customer)""")
def audit(spark, sf):
    raw = v.table(spark, sf, "customer").select(F.expr(NAMES).alias("full_name"), F.expr(DIGITS).alias("phone"))
    return mask_audit(raw, "customer", {"full_name": "pseudonymize", "phone": "mask_phone", "ssn": "mask_ssn"})

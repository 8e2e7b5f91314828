"""Scans, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.plans.registry import load, query

#: Longest text that is translated.
MAX_TEXT = 2000


@query("scan_documents", "SELECT doc_id, lang, source, length(text) AS n FROM documents")
def scan_documents(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42 OR o_orderkey = 7")
def point_lookup(spark, d):
    return load(spark, d, "orders").filter(F.col("o_orderkey").isin(42, 7)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("filter_maxlen", f"SELECT count(*) FILTER (length(text) <= {MAX_TEXT}) AS kept, count(*) FILTER (length(text) > {MAX_TEXT}) AS excluded FROM documents")
def filter_maxlen(spark, d):
    n = F.length("text")
    return load(spark, d, "documents").agg(F.count_if(n <= MAX_TEXT).alias("kept"), F.count_if(n > MAX_TEXT).alias("excluded"))


@query("filter_in_set", "SELECT o_orderkey, o_orderpriority FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '3')")
def filter_in_set(spark, d):
    return load(spark, d, "orders").filter(F.substring("o_orderpriority", 1, 1).isin("1", "3")).select("o_orderkey", "o_orderpriority")


@query(
    "pool_anti",
    "SELECT doc_id FROM documents WHERE trim(text) <> '' AND trim(lang) <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)",
)
def pool_anti(spark, d):
    docs = load(spark, d, "documents").filter((F.trim("text") != "") & (F.trim("lang") != "")).select("doc_id")
    return docs.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def dynamic_filter(df, equals=None, any_of=None, not_like_or_null=None):
    """Composable predicates: only those given apply; the last keeps nulls."""
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    for c, v in (any_of or {}).items():
        df = df.filter(F.col(c).isin(list(v)))
    for c, v in (not_like_or_null or {}).items():
        df = df.filter(F.col(c).isNull() | ~F.col(c).like(v))
    return df


@query(
    "filter_dynamic",
    """SELECT o_orderkey, o_orderstatus, m FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS m FROM orders)
    WHERE o_orderstatus = 'F' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND (m IS NULL OR m NOT LIKE '1-%')""",
)
def filter_dynamic(spark, d):
    orders = load(spark, d, "orders").withColumn("m", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    out = dynamic_filter(orders, {"o_orderstatus": "F"}, {"o_custkey": (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)}, {"m": "1-%"})
    return out.select("o_orderkey", "o_orderstatus", "m")


@query(
    "filter_band_ratio",
    """SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 1500
    AND len(regexp_extract_all(text, '[àâäéèêëîïôöùûüßçñáíóú]')) / greatest(length(text), 1) < 0.05""",
)
def filter_band_ratio(spark, d):
    accents = F.regexp_count("text", F.lit("[àâäéèêëîïôöùûüßçñáíóú]")) / F.greatest(F.length("text"), F.lit(1))
    return load(spark, d, "documents").filter(F.length("text").between(200, 1500) & (accents < 0.05)).select("doc_id")


@query(
    "validate_rows",
    """SELECT doc_id, trim(text) <> '' AND length(text) <= 2000 AS text_ok, doc_id >= 0 AS offset_ok, 1 + doc_id % 400 BETWEEN 1 AND 300 AS limit_ok,
    CASE WHEN 1 + doc_id % 400 > 250 THEN 422 ELSE 202 END AS budget_status FROM documents""",
)
def validate_rows(spark, d):
    limit = 1 + F.col("doc_id") % 400
    return load(spark, d, "documents").select(
        "doc_id",
        ((F.trim("text") != "") & (F.length("text") <= MAX_TEXT)).alias("text_ok"),
        (F.col("doc_id") >= 0).alias("offset_ok"),
        limit.between(1, 300).alias("limit_ok"),
        F.when(limit > 250, 422).otherwise(202).alias("budget_status"),
    )


@query("score_threshold", "SELECT event_id, value FROM events WHERE value >= 50 AND event_type <> 'error'")
def score_threshold(spark, d):
    return load(spark, d, "events").filter("value >= 50 AND event_type <> 'error'").select("event_id", "value")


@query("tenant_owned", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_custkey IN (7, 8)")
def tenant_owned(spark, d):
    """A row of another tenant is found as if it weren't there: its content is null."""
    return load(spark, d, "orders").filter(F.col("o_custkey").isin(7, 8)).select("o_orderkey", F.when(F.col("o_custkey") == 7, F.col("o_totalprice")).alias("o_totalprice"))


@query(
    "slice_offset_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100",
)
def slice_offset_limit(spark, d):
    """Rows 100 to 149 in document order; the slice is the feature, and takes a top-k rather than a sort of all."""
    return load(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query(
    "html_span_extract",
    """SELECT page_id, host_path, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS host_path FROM pages) GROUP BY ALL""",
)
def html_span_extract(spark, d):
    spans = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("host_path"))
    return spans.groupBy("page_id", "host_path").count().withColumnRenamed("count", "n")


@query(
    "log_regex_counts",
    """SELECT quota, value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, 'id=(\\w+) v=(\\d+)', 1)) AS quota, unnest(regexp_extract_all(line, 'id=(\\w+) v=(\\d+)', 2)) AS value
    FROM (SELECT 'id=' || event_type || ' v=' || (user_id % 5) || '; id=day v=' || (user_id % 2) AS line FROM events)) GROUP BY ALL""",
)
def log_regex_counts(spark, d):
    line = F.concat(F.lit("id="), "event_type", F.lit(" v="), (F.col("user_id") % 5).cast("string"), F.lit("; id=day v="), (F.col("user_id") % 2).cast("string"))
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(r"(?s)id=(\w+) v=(\d+)"), F.lit(1)).alias("quota"), F.regexp_extract_all(line, F.lit(r"(?s)id=(\w+) v=(\d+)"), F.lit(2)).alias("value"))
    return load(spark, d, "events").select(F.inline(pairs)).toDF("quota", "value").groupBy("quota", "value").count().withColumnRenamed("count", "n")


@query(
    "normalized_hash",
    """SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS hash FROM documents""",
)
def normalized_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", T.normalized_hash(F.col("text")).alias("hash"))

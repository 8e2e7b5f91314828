"""Queries over the ledger's writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.plans.registry import load, query
from loomline.sources import sinks

from .textual import _FAILED_SQL, failures


@query("insert_if_absent", "SELECT l_partkey AS c_custkey, min(l_orderkey) AS first_order FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def insert_if_absent(spark, d):
    new = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("c_custkey")).agg(F.min("l_orderkey").alias("first_order"))
    return sinks.insert_if_absent(load(spark, d, "customer"), new, ["c_custkey"])


@query(
    "upsert_merge",
    """WITH n AS (SELECT s_suppkey + 5 AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS bal FROM supplier), o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer)
    SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n ON o.k = n.k""",
)
def upsert_merge(spark, d):
    new = load(spark, d, "supplier").select((F.col("s_suppkey") + 5).alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("bal"))
    old = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return sinks.upsert(old, new, ["k"])


@query("cas_transition", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus IN ('O', 'P') THEN 'PAUSED' ELSE o_orderstatus END AS o_orderstatus, o_custkey % 2 = 0 AND o_orderstatus IN ('O', 'P') AS applied FROM orders")
def cas_transition(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sinks.compare_and_set(o, F.col("o_custkey") % 2 == 0, "o_orderstatus", ["O", "P"], "PAUSED").drop("o_custkey")


@query("reset_failed", "SELECT o_orderkey, 'PENDING' AS status, NULL AS error_class FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def reset_failed(spark, d):
    """Failed jobs of a batch set back; the rows are what the update returns."""
    return load(spark, d, "orders").filter("o_orderstatus = 'F' AND o_custkey = 7").select("o_orderkey", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_class"))


@query(
    "job_update",
    "SELECT o_orderkey, coalesce(n.total, o_totalprice) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) n ON l_orderkey = o_orderkey",
)
def job_update(spark, d):
    changes = load(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return sinks.update_from(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), changes, "o_orderkey")


@query("dlq_split", f"WITH {_FAILED_SQL} SELECT event_id, class AS error_class, substr(message, 1, 20) AS message FROM c WHERE class IN ('SPEND_CAP', 'AUTH_FAILED', 'MODEL_UNAVAILABLE', 'CONTENT_FILTERED')")
def dlq_split(spark, d):
    dead = ("SPEND_CAP", "AUTH_FAILED", "MODEL_UNAVAILABLE", "CONTENT_FILTERED")
    rows = failures(spark, d).select("event_id", F.when(F.col("class").isin(*dead), F.col("class")).alias("error_class"), "message")
    return sinks.split_dead_letters(rows, most=20)[1]

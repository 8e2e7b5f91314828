"""Windows, sorts, top-k, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.plans.registry import load, query


@query(
    "latest_per_key",
    "SELECT o_custkey, o_orderkey, done FROM (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS done FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY done DESC NULLS FIRST, o_orderkey) = 1",
)
def latest_per_key(spark, d):
    """Latest row per key, rows without a date first. A minimum over a struct is combined before the shuffle, unlike a ranking window."""
    o = load(spark, d, "orders").withColumn("done", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")))
    order = F.struct(F.col("done").isNotNull().alias("has"), (-F.unix_micros(F.col("done").cast("timestamp"))).alias("late"), "o_orderkey", "done")
    return o.groupBy("o_custkey").agg(F.min(order).alias("m")).select("o_custkey", "m.o_orderkey", "m.done")


@query("dedup_last_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_last_wins(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("dedup_best", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dedup_best(spark, d):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("k")))
    return load(spark, d, "events").groupBy("user_id").agg(best.alias("m")).select("user_id", (-F.col("m.k")).alias("event_id"), "m.value")


@query(
    "group_minmax_fill",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END, min(year(o_orderdate)) OVER (PARTITION BY o_custkey)) AS y_from,
    coalesce(CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) END, max(year(o_orderdate)) OVER (PARTITION BY o_custkey)) AS y_to FROM orders""",
)
def group_minmax_fill(spark, d):
    """Missing years filled by the person's first and last: aggregated per person, then joined, so no person's rows meet in a window."""
    o = load(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    span = o.groupBy("o_custkey").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return o.join(span, "o_custkey").select(
        "o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("y")), "lo").cast("long").alias("y_from"), F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, F.col("y")), "hi").cast("long").alias("y_to")
    )


def round_robin(df: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    """n rows, one of each stratum in turn, larger strata first. Only the first n of a stratum can be chosen."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= n).join(F.broadcast(sizes), stratum).orderBy("_turn", F.desc("_size"), stratum).limit(n).drop("_turn", "_size")


@query(
    "stratified_rr",
    """WITH s AS (SELECT doc_id, lang || CASE WHEN n_chars < 500 THEN 'S' ELSE 'L' END AS stratum FROM documents), z AS (SELECT stratum, count(*) AS size FROM s GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR), doc_id) AS turn FROM s) SELECT doc_id, stratum FROM t JOIN z USING (stratum) ORDER BY turn, size DESC, stratum LIMIT 60""",
)
def stratified_rr(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat("lang", F.when(F.col("n_chars") < 500, "S").otherwise("L")).alias("stratum"))
    return round_robin(docs, "stratum", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 60).select("doc_id", "stratum")


@query("sort_nulls_last", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) ORDER BY v ASC NULLS LAST, event_id LIMIT 100")
def sort_nulls_last(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return e.orderBy(F.asc_nulls_last("v"), "event_id").limit(100)


@query("topk_surface", "SELECT p_brand AS surface, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, surface LIMIT 10")
def topk_surface(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_partkey").count()
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("surface"))
    return per.join(part, "l_partkey").groupBy("surface").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "surface").limit(10)


@query("topk_candidates", "SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id DESC LIMIT 500")
def topk_candidates(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label").orderBy(F.desc("label"), F.desc("vec_id")).limit(500)


@query(
    "recent_json_agg",
    """SELECT '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderdate DESC, o_orderkey) || ']' AS js FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200)""",
)
def recent_json_agg(spark, d):
    top = load(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    rows = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("late"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return top.agg(F.to_json(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["status"].alias("status")))).alias("js"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100")
def seeded_sample(spark, d):
    """A sample of 100 by hash of id and seed: the same on any partitioning."""
    return load(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id").limit(100)


@query(
    "weighted_sample",
    """SELECT doc_id FROM (SELECT doc_id, round(-ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / (n_chars + 1), 15) AS k FROM documents) ORDER BY k, doc_id LIMIT 50""",
)
def weighted_sample(spark, d):
    """Without replacement, by weight: the rows whose exponential clocks ring first."""
    u = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(281474976710656.0)
    return load(spark, d, "documents").select("doc_id", F.round(-F.log(u) / (F.col("n_chars") + 1), 15).alias("k")).orderBy("k", "doc_id").limit(50).select("doc_id")


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("union_all", "SELECT 'c' AS side, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def union_all(spark, d):
    c = load(spark, d, "customer").groupBy(F.lit("c").alias("side"), F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return c.unionByName(load(spark, d, "supplier").groupBy(F.lit("s").alias("side"), F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")))


@query("intersect_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def intersect_ids(spark, d):
    l = load(spark, d, "lineitem")  # noqa: E741
    return l.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")).intersect(l.filter("l_returnflag = 'N'").select("l_partkey"))


@query("except_names", "SELECT user_id, event_type FROM events WHERE value > 60 EXCEPT SELECT user_id, event_type FROM events WHERE value < 20")
def except_names(spark, d):
    e = load(spark, d, "events")
    return e.filter("value > 60").select("user_id", "event_type").subtract(e.filter("value < 20").select("user_id", "event_type"))


@query("dedup_pairs", "SELECT DISTINCT l_returnflag AS tag, l_suppkey AS surface FROM lineitem")
def dedup_pairs(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("tag"), F.col("l_suppkey").alias("surface")).distinct()


@query(
    "diversity_metrics",
    """WITH s AS (SELECT doc_id, n_chars::DOUBLE AS n, lang FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 40) SELECT (SELECT round(avg(abs(a.n - b.n)), 6) FROM s a JOIN s b ON a.doc_id < b.doc_id) AS mean_distance,
    count(DISTINCT lang) AS types, round(stddev_pop(n), 6) AS length_sd, round(var_pop(n), 4) AS variance FROM s""",
)
def diversity_metrics(spark, d):
    """Of a selection of 40: mean pairwise distance (from ranks, without forming the pairs), types covered, spread."""
    s = load(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), "lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(40)
    one = s.agg(F.array_sort(F.collect_list("n")).alias("v"), F.count_distinct("lang").alias("types"), F.round(F.stddev_pop("n"), 6).alias("length_sd"), F.round(F.var_pop("n"), 4).alias("variance"))
    k = F.size("v")
    total = F.aggregate(F.transform("v", lambda x, i: x * (2 * i - k + 1)), F.lit(0.0), lambda a, x: a + x)
    return one.select(F.round(total / (k * (k - 1) / 2), 6).alias("mean_distance"), "types", "length_sd", "variance")


@query(
    "fewshot_select",
    """WITH pool AS (SELECT doc_id, lang AS pat, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS len FROM documents), q AS (SELECT doc_id AS q, lang AS qpat, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS qlen FROM documents WHERE doc_id % 50 = 0),
    anchor AS (SELECT q, doc_id, 0 AS step, qpat AS pat FROM q JOIN pool ON pat = qpat QUALIFY row_number() OVER (PARTITION BY q ORDER BY abs(len - qlen), doc_id) = 1),
    other AS (SELECT q, doc_id, 1 AS step, pat FROM q JOIN (SELECT pat, min(doc_id) AS doc_id FROM pool GROUP BY pat) f ON f.pat <> q.qpat) SELECT q, doc_id, step, pat FROM anchor UNION ALL SELECT q, doc_id, step, pat FROM other""",
)
def fewshot_select(spark, d):
    """Per query: the pool's example of the same pattern nearest in length, then the first of each other pattern.

    The pool is cut to one example per pattern and length first, so a query meets a dozen rows, not the pool.
    """
    size = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    docs = load(spark, d, "documents").select("doc_id", F.col("lang").alias("pat"), size.alias("len"))
    firsts = docs.groupBy("pat", "len").agg(F.min("doc_id").alias("doc_id"))
    q = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("q"), F.col("pat").alias("qpat"), F.col("len").alias("qlen"))
    near = F.min(F.struct(F.abs(F.col("len") - F.col("qlen")).alias("far"), "doc_id"))
    anchor = q.join(F.broadcast(firsts), F.col("pat") == F.col("qpat")).groupBy("q", "pat").agg(near.alias("m")).select("q", "m.doc_id", F.lit(0).alias("step"), "pat")
    each = firsts.groupBy("pat").agg(F.min("doc_id").alias("doc_id")).agg(F.collect_list(F.struct("pat", "doc_id")).alias("all"))
    other = q.join(F.broadcast(each)).select("q", "qpat", F.inline("all")).filter("pat <> qpat").select("q", "doc_id", F.lit(1).alias("step"), "pat")
    return anchor.unionByName(other)

"""Jobs, keys, caches and their formats: appends, tenants, key strings, admission, redelivery, retries, files read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import routing
from loomline.functions import text as T
from loomline.plans.registry import load, query
from loomline.sources import readers, sinks

from .aggregates import GRADE_SQL, grade
from .extras import hit_storer_pairs
from .joins import _HASH_SQL
from .replay import _ITEMS_SQL
from .textual import _FAILED_SQL, failures

# --- jobs and tenants


@query(
    "append_jobs",
    """SELECT 'batch:' || o_custkey || ':' || o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status, CAST(NULL AS VARCHAR) AS error_class FROM orders
    UNION ALL SELECT 'batch:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey, 'PENDING', NULL FROM lineitem""",
)
def append_jobs(spark, d):
    """The job table after new rows were appended; a new job is pending and has no error."""
    o, new = load(spark, d, "orders"), load(spark, d, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SUCCEEDED").otherwise("PENDING")
    table = o.select(job_key("o_custkey", "o_orderkey").alias("job"), status.alias("status"), F.lit(None).cast("string").alias("error_class"))
    return sinks.append_pending(table, new.select(job_key("l_orderkey", "l_linenumber", "l_partkey").alias("job")))


def job_key(*parts: str) -> Column:
    return F.concat_ws(":", F.lit("batch"), *parts)


@query("tenant_by_key", "SELECT o_orderkey, c_name AS tenant, sha256('key-' || o_custkey) AS key_hash FROM orders LEFT JOIN customer ON sha256('key-' || c_custkey) = sha256('key-' || o_custkey)")
def tenant_by_key(spark, d):
    """Callers by the SHA-256 of the key they present, as it is; only hashes are stored, and an unknown key has no tenant."""
    hashed = lambda c: F.sha2(F.concat(F.lit("key-"), F.col(c).cast("string")), 256)
    tenants = load(spark, d, "customer").select(hashed("c_custkey").alias("key_hash"), F.col("c_name").alias("tenant"))
    return load(spark, d, "orders").select("o_orderkey", hashed("o_custkey").alias("key_hash")).join(tenants, "key_hash", "left").select("o_orderkey", "tenant", "key_hash")


@query(
    "cache_keys",
    f"SELECT doc_id, 'cache:l1:v1:' || {_HASH_SQL} AS l1_key, 'cache:l2:v1:' || md5(source) AS l2_key FROM documents",
)
def cache_keys(spark, d):
    """A version's cache keys: by the canonical hash of the source, and by that of a template."""
    l1 = F.concat(F.lit("cache:l1:v1:"), T.normalized_hash(F.col("text")))
    return load(spark, d, "documents").select("doc_id", l1.alias("l1_key"), F.concat(F.lit("cache:l2:v1:"), F.md5("source")).alias("l2_key"))


@query(
    "scope_keys",
    """SELECT event_id, 'rate:bucket:' || user_id || ':' || event_type AS bucket, 'budget:daily:' || user_id || ':' || strftime(ts, '%Y%m%d') AS budget, 'quota:daily:' || event_type || ':' || strftime(ts, '%Y%m%d') AS quota FROM events""",
)
def scope_keys(spark, d):
    """Keys of a tenant's rate bucket for a model, of its day's budget, and of the model's day's quota, which no tenant is part of."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    key = lambda *parts: F.concat_ws(":", *parts)
    return load(spark, d, "events").select(
        "event_id", key(F.lit("rate:bucket"), "user_id", "event_type").alias("bucket"), key(F.lit("budget:daily"), "user_id", day).alias("budget"), key(F.lit("quota:daily"), "event_type", day).alias("quota")
    )


@query("minimum_sample", "SELECT o_custkey, count(*) AS n, count(*) >= 10 AS enough, CASE WHEN count(*) >= 10 THEN round(avg(o_totalprice), 4) END AS score FROM orders GROUP BY o_custkey")
def minimum_sample(spark, d):
    """A score needs ten rows; ``require_sample`` makes fewer an error. Prices are summed as decimals, so their order has no part in the mean."""
    enough = F.count("*") >= 10
    mean = F.round((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / F.count("o_totalprice")).cast("decimal(24,8)"), 4).cast("double")
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), enough.alias("enough"), F.when(enough, mean).alias("score"))


def require_sample(rows: DataFrame, least: int = 10) -> DataFrame:
    if (n := rows.limit(least).count()) < least:
        raise ValueError(f"only {n} rows; a score needs {least}")
    return rows


# --- caches


@query(
    "cache_admission",
    f"""WITH g AS (SELECT doc_id, coalesce(trim(text), '') <> '' AS full_text, {GRADE_SQL} AS grade, length(text) % 2 = 0 AS slotted, to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP AS put FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, coalesce(full_text AND grade <> 'REJECTED', false) AS l1, coalesce(full_text AND grade = 'VERIFIED' AND slotted, false) AS l2, epoch(put + INTERVAL 30 DAY)::BIGINT AS expires FROM g""",
)
def cache_admission(spark, d):
    """What a cache takes: any graded output that isn't rejected or blank; as a template only verified ones that have slots. Entries live for 30 days."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").withColumn("grade", grade())
    out = sinks.cache_entries(rows, F.col("text"), F.col("grade"), F.length("text") % 2 == 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    return out.select("doc_id", "l1", "l2", F.unix_seconds("expires").alias("expires"))


@query(
    "hit_storer_aligned",
    f"WITH {_ITEMS_SQL}, bad AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT p AS stored_by, pos FROM o WHERE outcome = 'L2' AND p NOT IN (SELECT doc_id FROM bad) AND pos NOT IN (SELECT doc_id FROM bad)",
)
def hit_storer_aligned(spark, d):
    """Pairs of a hit and its storer of which neither is misaligned; a low quality label marks those here."""
    bad = load(spark, d, "labels").filter("quality = 0").select("doc_id")
    return aligned_pairs(hit_storer_pairs(spark, d), bad.withColumnRenamed("doc_id", "bad"))


def aligned_pairs(pairs: DataFrame, bad: DataFrame) -> DataFrame:
    for end in ("stored_by", "pos"):
        pairs = pairs.join(bad, F.col(end) == F.col("bad"), "left_anti")
    return pairs


# --- redelivery and retries


def claim_stale(pending: DataFrame, group: str, message: str, idle_seconds: Column, delivery: str, idle: int = 30, most: int = 50) -> DataFrame:
    """Of each group's first ``most`` pending messages those idle for longer than ``idle`` seconds, their delivery count raised by one.

    The rank is cut before the shuffle, so a group sends ``most`` rows a task at most.
    """
    ranked = pending.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(message))).filter(F.col("_k") <= most)
    return ranked.filter(idle_seconds > idle).withColumn(delivery, F.col(delivery) + 1).drop("_k")


@query(
    "stale_claim",
    """WITH p AS (SELECT event_id, user_id, value AS idle_s, 1 + event_id % 4 AS delivery, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT event_id, user_id, delivery + 1 AS delivery FROM p WHERE k <= 50 AND idle_s > 30""",
)
def stale_claim(spark, d):
    """Events as messages of their user's group, idle for their value in seconds."""
    pending = load(spark, d, "events").select("event_id", "user_id", "value", (1 + F.col("event_id") % 4).alias("delivery"))
    return claim_stale(pending, "user_id", "event_id", F.col("value"), "delivery").select("event_id", "user_id", "delivery")


@query(
    "retry_plan",
    f"""WITH {_FAILED_SQL}, r AS (SELECT event_id, class, class IN ('RATE_LIMITED', 'SERVER_ERROR', 'TIMEOUT', 'NER_UNAVAILABLE', 'UNKNOWN') AS again FROM c), a AS (SELECT *, unnest([1, 2]) AS attempt FROM r)
    SELECT event_id, attempt, CASE WHEN attempt = 1 AND again THEN 2000 END::BIGINT AS wait_ms, CASE WHEN attempt = 1 AND again THEN 1000 END::BIGINT AS least_ms, CASE WHEN attempt = 1 AND again THEN 3000 END::BIGINT AS most_ms FROM a WHERE attempt = 1 OR again""",
)
def retry_plan(spark, d):
    """The attempts of each failing call, and the wait after each: two attempts where the class is transient and not a parse error."""
    return routing.retry_attempts(failures(spark, d), "class").select("event_id", "attempt", "wait_ms", "least_ms", "most_ms")


@query(
    "reask_plan",
    f"""WITH {_FAILED_SQL}, a AS (SELECT event_id, event_id % 4 AS attempt, class IN ('QUOTA_DAILY', 'RATE_LIMITED', 'SPEND_CAP') AS quota FROM c)
    SELECT event_id, attempt, attempt < 3 AS again, CASE WHEN quota THEN 1000 * 2 ** (attempt + 2) WHEN attempt < 3 THEN 1000 * 2 ** attempt END::BIGINT AS wait_ms, attempt > 0 AS warned FROM a""",
)
def reask_plan(spark, d):
    """After a failed or Han-bearing output of attempt n (from 0, four at most): ask again with the warning, after 2^(n+2) s for quotas and 2^n s else."""
    rows = failures(spark, d).withColumn("attempt", F.col("event_id") % 4)
    quota = F.col("class").isin("QUOTA_DAILY", "RATE_LIMITED", "SPEND_CAP")
    wait = F.when(quota, 1000 * F.pow(F.lit(2), F.col("attempt") + 2)).when(F.col("attempt") < 3, 1000 * F.pow(F.lit(2), F.col("attempt")))
    return rows.select("event_id", "attempt", (F.col("attempt") < 3).alias("again"), wait.cast("long").alias("wait_ms"), (F.col("attempt") > 0).alias("warned"))


# --- numbers


@query(
    "softmax_argmax",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_max(x) AS top FROM e)
    SELECT vec_id, list_position(x, top) - 1 AS label, round(1 / list_sum(list_transform(x, lambda v: exp(v - top))), 6) AS p FROM m""",
)
def softmax_argmax(spark, d):
    """The likeliest of a row's logits (the first of equals) and its probability."""
    x = F.col("x")
    rows = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("top", F.array_max(x))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    return rows.select("vec_id", (F.array_position(x, F.col("top")) - 1).alias("label"), F.round(1 / total, 6).alias("p"))


@query(
    "percent_format",
    """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) FILTER (o_orderstatus <> 'P') AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n = 0 THEN '—' ELSE printf('%.2f%%', 100.0 * k / n) END AS pct, round(k / nullif(n, 0), 4) AS share FROM c""",
)
def percent_format(spark, d):
    c = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("k"), F.count_if(F.expr("o_orderstatus <> 'P'")).alias("n"))
    return c.select("o_custkey", T.percent(F.col("k"), F.col("n")).alias("pct"), F.round(F.col("k") / F.nullif("n", F.lit(0)), 4).alias("share"))


# --- files written and read back


@query("json_map_file", "SELECT n_name AS key, n_nationkey::BIGINT AS value FROM nation")
def json_map_file(spark, d):
    path = sinks.scratch(spark, "map")
    n = load(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("value"))
    n.write.text(path)
    return readers.json_map(spark, path, "bigint")


@query("json_lines_file", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 0")
def json_lines_file(spark, d):
    """Rows without the required field and broken lines are dropped."""
    path = sinks.scratch(spark, "lines")
    s = load(spark, d, "supplier")
    lines = s.select(F.to_json(F.struct("s_suppkey", "s_name", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"))).alias("value"))
    lines.unionByName(s.select(F.concat(F.lit("{broken "), "s_name").alias("value"))).write.text(path)
    return readers.json_lines(spark, path, "s_suppkey long, s_name string, s_acctbal double", required="s_acctbal")


@query("csv_file", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def csv_file(spark, d):
    """Missing numbers come back as nulls."""
    path = sinks.scratch(spark, "csv")
    sinks.write_report(load(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size")), path, sep=",")
    return readers.csv_table(spark, path, "p_partkey long, p_name string, p_size int")


@query("xml_files", "SELECT r_name, count(*) AS articles, count(*) FILTER (n_nationkey % 2 = 0) AS translated FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'broken', 0, 0 WHERE false")
def xml_files(spark, d):
    """A folder of corpora, a file a region, read in sorted file order; a file that is no XML is left out, broken articles too."""
    path = sinks.scratch(spark, "xml")
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<translation>"), "n_name", F.lit("</translation>"))).otherwise("")
    article = F.concat(F.lit("<article><region>"), "r_name", F.lit("</region>"), text, F.lit("</article>"))
    files = n.groupBy("r_regionkey").agg(F.concat(F.lit("<corpus>"), F.array_join(F.collect_list(article), "\n"), F.lit("</corpus>")).alias("value"))
    broken = spark.createDataFrame([(99, "no markup at all")], "r_regionkey int, value string")
    files.unionByName(broken).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    rows = readers.files_in_order(readers.xml_rows(spark, path, "article", "region string, translation string"))
    return rows.groupBy(F.col("region").alias("r_name")).agg(F.count("*").alias("articles"), F.count("translation").alias("translated"))


@query("file_order", "SELECT r_regionkey::BIGINT AS file_no, r_name FROM region")
def file_order(spark, d):
    """Files of a folder numbered by their sorted paths."""
    path = sinks.scratch(spark, "order")
    load(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    rows = readers.files_in_order(spark.read.schema("value string").text(path))
    return rows.select("file_no", F.col("value").alias("r_name"))


@query("resumed_lines", "SELECT s_suppkey, s_name FROM supplier")
def resumed_lines(spark, d):
    """Half of the rows are there when all are appended; no key comes twice."""
    path = sinks.scratch(spark, "resume")
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    sinks.resume_append(path, s.filter(F.col("s_name") < "Supplier#000000005"), "s_suppkey")
    sinks.resume_append(path, s, "s_suppkey")
    return readers.json_lines(spark, path, "s_suppkey long, s_name string")

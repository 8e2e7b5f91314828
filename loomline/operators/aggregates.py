"""Aggregations: filtered, nested, distributions, coverage, descriptive statistics, top-k and pattern counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.plans.registry import load, query

from .joins import _HASH_SQL, MENTIONS_SQL, counted_stages, missed_mentions, paired, staged_mentions
from .quantiles import index, quantiles, share


@query("filtered_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY o_custkey")
def filtered_counts(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("ok"), F.count_if(F.expr("o_orderstatus = 'P'")).alias("bad"))


@query("nested_max_count", "SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)")
def nested_max_count(spark, d):
    return load(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))


GRADE_SQL = "CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 0 THEN 'DEGRADED' WHEN quality = 1 THEN 'VERIFIED' END"


def grade() -> Column:
    return F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 0, "DEGRADED").when(F.col("quality") == 1, "VERIFIED")


@query("group_count", f"SELECT {GRADE_SQL} AS grade, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_count(spark, d):
    """Rows per grade; those without one are a group of their own."""
    rows = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(grade().alias("grade")).agg(F.count("*").alias("n"))


@query("distinct_values", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT source) = 1 AS single FROM documents GROUP BY lang")
def distinct_values(spark, d):
    pairs = load(spark, d, "documents").select("lang", "source").distinct()
    return pairs.groupBy("lang").agg(F.count("source").alias("sources"), (F.count("source") == 1).alias("single"))


@query("group_two_keys", f"SELECT lang, coalesce({GRADE_SQL}, '-') AS grade, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def group_two_keys(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang", F.coalesce(grade(), F.lit("-")).alias("grade")).agg(F.count("*").alias("n"))


# USD per million tokens by model, and won per dollar.
PRICES = {"F": ("0.25", "1.50"), "O": ("1.50", "9.00"), "P": ("0.10", "0.40")}
USD_KRW = 1400


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Won of one call: dollars rounded half up to 10 places, then won to 4. Missing tokens count as none; an unknown model has a null cost."""
    price = lambda k: F.coalesce(*[F.when(model == m, F.lit(p[k]).cast("decimal(12,6)")) for m, p in PRICES.items()])
    part = lambda t, k: F.coalesce(t, F.lit(0)).cast("decimal(12,0)") * price(k)
    usd = F.round((part(tokens_in, 0) + part(tokens_out, 1)).cast("decimal(26,6)") / F.lit(1000000).cast("decimal(7,0)"), 10)
    return F.round(usd.cast("decimal(20,10)") * F.lit(USD_KRW).cast("decimal(6,0)"), 4).cast("decimal(18,4)")


_LEDGER_SQL = """ledger AS (SELECT l_orderkey AS job_id, o_orderstatus AS model, CAST(l_partkey AS INT) AS tin, CAST(l_suppkey AS INT) AS tout, o_custkey AS batch_id,
  CAST(CASE o_orderstatus WHEN 'F' THEN l_partkey * 250000 + l_suppkey * 1500000 WHEN 'O' THEN l_partkey * 1500000 + l_suppkey * 9000000 ELSE l_partkey * 100000 + l_suppkey * 400000 END AS HUGEINT) AS micro
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), priced AS (SELECT *, CAST(round(CAST(micro * 1400 AS DOUBLE) / 1e12 + 1e-12, 4) AS DECIMAL(18, 4)) AS krw FROM ledger)"""


def ledger(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("batch_id"))
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").cast("int").alias("tin"), F.col("l_suppkey").cast("int").alias("tout"))  # noqa: E741
    rows = l.join(o, l["job_id"] == o["o_orderkey"]).drop("o_orderkey")
    return rows.withColumn("krw", call_cost(F.col("model"), F.col("tin"), F.col("tout")))


@query("ledger_cost", f"WITH {_LEDGER_SQL} SELECT job_id, model, tin, tout, CAST(krw AS DOUBLE) AS krw FROM priced")
def ledger_cost(spark, d):
    return ledger(spark, d).select("job_id", "model", "tin", "tout", F.col("krw").cast("double").alias("krw"))


@query("cost_by_model", f"WITH {_LEDGER_SQL} SELECT model, count(*) AS calls, CAST(sum(krw) AS DOUBLE) AS krw FROM priced GROUP BY model")
def cost_by_model(spark, d):
    return ledger(spark, d).groupBy("model").agg(F.count("*").alias("calls"), F.sum("krw").cast("double").alias("krw"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Counts and per cent of all by group; the total is one number over a row a group."""
    return count_shares(rows.groupBy(by).agg(F.count("*").alias("n")))


def count_shares(counts: DataFrame) -> DataFrame:
    """``counts`` with column n and each one's per cent of their sum."""
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("stage_distribution", f"WITH {MENTIONS_SQL} SELECT stage, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM linked GROUP BY stage")
def stage_distribution(spark, d):
    return count_shares(counted_stages(spark, d))


def doc_signals(spark, d) -> DataFrame:
    """Per order: entities, ambiguous, misses and whether its priority counts as formulaic."""
    rows = staged_mentions(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("stage") == "AMBIGUOUS").alias("ambiguous"),
        F.count_if(F.col("stage") == "MISS").alias("missing"),
    )
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").rlike("URGENT|HIGH").alias("formulaic"))
    return o.join(rows, "doc_id", "left").na.fill(0, ["entities", "ambiguous", "missing"])


_SIGNALS_SQL = f"""WITH {MENTIONS_SQL}, s AS (SELECT o_orderkey AS doc_id, regexp_matches(o_orderpriority, 'URGENT|HIGH') AS formulaic, count(line) AS entities,
  count(*) FILTER (stage = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (stage = 'MISS') AS missing FROM orders LEFT JOIN linked ON doc_id = o_orderkey GROUP BY 1, 2)"""


@query(
    "tier_distribution",
    f"{_SIGNALS_SQL} SELECT CASE WHEN ambiguous > 0 THEN 'T2' WHEN entities = 0 AND formulaic THEN 'T0' ELSE 'T1' END AS tier, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM s GROUP BY 1",
)
def tier_distribution(spark, d):
    tier = F.when(F.col("ambiguous") > 0, "T2").when((F.col("entities") == 0) & F.col("formulaic"), "T0").otherwise("T1")
    return shares(doc_signals(spark, d).select(tier.alias("tier")), "tier")


@query(
    "tier_plan",
    f"""{_SIGNALS_SQL} SELECT doc_id, CASE WHEN ambiguous > 0 OR missing > 0 THEN 'T2' WHEN entities = 0 AND formulaic THEN 'T0' WHEN entities > 0 THEN 'T1' ELSE 'UNSPECIFIED' END AS tier FROM s""",
)
def tier_plan(spark, d):
    """The planned rule: misses count as hard too, and plain sentences without entities have no tier."""
    hard = (F.col("ambiguous") > 0) | (F.col("missing") > 0)
    tier = F.when(hard, "T2").when((F.col("entities") == 0) & F.col("formulaic"), "T0").when(F.col("entities") > 0, "T1").otherwise("UNSPECIFIED")
    return doc_signals(spark, d).select("doc_id", tier.alias("tier"))


@query("clipped_hist", "SELECT least(n, 6) AS n_clipped, count(*) AS docs FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def clipped_hist(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.groupBy(F.least("n", F.lit(6)).alias("n_clipped")).agg(F.count("*").alias("docs"))


@query(
    "multi_predicate_counts",
    f"""{_SIGNALS_SQL}, c AS (SELECT count(*) FILTER (entities = 0) AS none, count(*) FILTER (ambiguous > 0) AS ambiguous, count(*) FILTER (missing > 0 AND ambiguous = 0) AS missing_only, count(*) FILTER (formulaic) AS formulaic FROM s)
    UNPIVOT c ON none, ambiguous, missing_only, formulaic INTO NAME signal VALUE n""",
)
def multi_predicate_counts(spark, d):
    one = doc_signals(spark, d).agg(
        F.count_if(F.expr("entities = 0")).alias("none"), F.count_if(F.expr("ambiguous > 0")).alias("ambiguous"), F.count_if(F.expr("missing > 0 AND ambiguous = 0")).alias("missing_only"), F.count_if("formulaic").alias("formulaic")
    )
    return one.unpivot([], ["none", "ambiguous", "missing_only", "formulaic"], "signal", "n")


@query("dup_rate", f"SELECT count(h) AS n, count(h) - count(DISTINCT h) AS dups, round(100 * (count(h) - count(DISTINCT h)) / count(h), 4) AS pct FROM (SELECT {_HASH_SQL} AS h FROM documents)")
def dup_rate(spark, d):
    per = load(spark, d, "documents").select(T.normalized_hash(F.col("text")).alias("h")).filter("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    dups = F.sum("n") - F.count("*")
    return per.agg(F.sum("n").alias("n"), dups.alias("dups"), F.round(100 * dups / F.sum("n"), 4).alias("pct"))


PREFIXES = (100, 200, 500, 1000, 5000)


@query(
    "prefix_dup_curve",
    f"WITH d AS (SELECT doc_id, {_HASH_SQL} AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM d GROUP BY h), s AS (SELECT unnest([100, 200, 500, 1000, 5000]) AS size) "
    "SELECT size, (SELECT count(*) FROM d WHERE doc_id < size) AS n, (SELECT count(*) FROM d WHERE doc_id < size) - (SELECT count(*) FROM f WHERE first_id < size) AS dups FROM s",
)
def prefix_dup_curve(spark, d):
    """Duplicates among the first k documents for each k: a key is new in a prefix if its first position is. One aggregate, no ordered pass."""
    per = load(spark, d, "documents").select("doc_id", T.normalized_hash(F.col("text")).alias("h")).groupBy("h").agg(F.min("doc_id").alias("first_id"), *[F.count_if(F.col("doc_id") < k).alias(f"n{k}") for k in PREFIXES])
    one = per.agg(*[F.struct(F.lit(k).alias("size"), F.sum(f"n{k}").alias("n"), (F.sum(f"n{k}") - F.count_if(F.col("first_id") < k)).alias("dups")).alias(f"k{k}") for k in PREFIXES])
    return one.select(F.inline(F.array(*[f"k{k}" for k in PREFIXES])))


@query(
    "miss_surface_coverage",
    f"""WITH {MENTIONS_SQL}, c AS (SELECT surface, count(*) AS n FROM linked WHERE stage = 'MISS' GROUP BY surface), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, surface) AS k FROM c)
    SELECT sum(n)::BIGINT AS mentions, count(*) AS surfaces, round(100 * coalesce(sum(n) FILTER (n >= 10), 0) / sum(n), 4) AS tail_share, round(100 * sum(n) FILTER (k <= 200) / sum(n), 4) AS top_share FROM r""",
)
def miss_surface_coverage(spark, d):
    per = missed_mentions(spark, d).groupBy("surface").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "surface").limit(200).agg(F.sum("n").alias("top"))
    total = per.agg(F.sum("n").alias("mentions"), F.count("*").alias("surfaces"), F.sum(F.when(F.col("n") >= 10, F.col("n")).otherwise(0)).alias("tail"))
    return total.join(top).select(
        "mentions", "surfaces", F.round(100 * F.col("tail") / F.col("mentions"), 4).alias("tail_share"), F.round(100 * F.col("top") / F.col("mentions"), 4).alias("top_share")
    )


@query(
    "describe_scores",
    """SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
    round(list_sort(list(value))[least(CAST(floor(count(*) * 0.5) AS INT), count(*) - 1) + 1], 6) AS p50, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS INT), count(*) - 1) + 1], 6) AS p95 FROM events""",
)
def describe_scores(spark, d):
    e = load(spark, d, "events")
    base = e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    places = quantiles(e, F.col("value"), {"median": share(0.5), "p50": index(0.5), "p95": index(0.95)})
    return base.join(F.broadcast(places)).select("n", "mean", "sd", *[F.round(c, 6).alias(c) for c in places.columns])


@query(
    "outlier_thresholds",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT round(q1 - 1.5 * (q3 - q1), 6) AS iqr_low, round(q3 + 1.5 * (q3 - q1), 6) AS iqr_high, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_removed,
    count(*) FILTER (abs(value - m) > 2 * s) AS z_removed, count(*) AS n FROM events, q GROUP BY q1, q3, m, s""",
)
def outlier_thresholds(spark, d):
    e = load(spark, d, "events")
    q = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).join(F.broadcast(quantiles(e, F.col("value"), {"q1": share(0.25), "q3": share(0.75)})))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return e.join(F.broadcast(q)).agg(
        F.round(F.first(low), 6).alias("iqr_low"),
        F.round(F.first(high), 6).alias("iqr_high"),
        F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("iqr_removed"),
        F.count_if(F.abs(F.col("value") - F.col("m")) > 2 * F.col("s")).alias("z_removed"),
        F.count("*").alias("n"),
    )


@query("bin_hist", "SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def bin_hist(spark, d):
    return load(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "describe_pop",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
    round(avg(value) - avg(CASE WHEN user_id % 2 = 0 THEN value END), 6) AS diff FROM events GROUP BY event_type""",
)
def describe_pop(spark, d):
    e = load(spark, d, "events")
    per = e.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg("value") - F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 6).alias("diff")
    )
    quarters = quantiles(e, F.col("value"), {"q1": share(0.25), "q3": share(0.75)}, {"type": F.col("event_type")})
    return per.join(F.broadcast(quarters), F.col("event_type").eqNullSafe(F.col("type")), "left").select("event_type", "mean", "sd", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "diff")


@query(
    "latency_by_stage",
    """WITH x AS (SELECT unnest(['ner', 'llm']) AS stage, unnest([value, value * (1 + user_id % 7)]) AS ms FROM events)
    SELECT stage, round(avg(ms), 6) AS mean, round(list_sort(list(ms))[least(CAST(floor(count(*) * 0.95) AS INT), count(*) - 1) + 1], 6) AS p95, round(sum(ms) / sum(sum(ms)) OVER (), 6) AS share FROM x GROUP BY stage""",
)
def latency_by_stage(spark, d):
    e = load(spark, d, "events")
    stages = e.select(F.explode(F.create_map(F.lit("ner"), F.col("value"), F.lit("llm"), F.col("value") * (1 + F.col("user_id") % 7))).alias("stage", "ms"))
    per = stages.groupBy("stage").agg(F.round(F.avg("ms"), 6).alias("mean"), F.sum("ms").alias("total"))
    late = quantiles(stages, F.col("ms"), {"p95": index(0.95)}, {"stage": F.col("stage")})
    return per.join(F.broadcast(late), "stage").select("stage", "mean", F.round("p95", 6).alias("p95"), F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6).alias("share"))


@query(
    "person_master",
    """SELECT o_custkey AS person_id, min(o_orderstatus || '') FILTER (true) AS status, string_agg(DISTINCT o_orderpriority, '') IS NOT NULL AS has_offices, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price,
    (SELECT string_agg(p, '|' ORDER BY k) FROM (SELECT o_orderpriority AS p, min((o_orderdate, o_orderkey)) AS k FROM orders i WHERE i.o_custkey = orders.o_custkey GROUP BY 1)) AS offices FROM orders GROUP BY o_custkey""",
)
def person_master(spark, d):
    """First value by date and the offices in order of first mention, without repeats."""
    mentions = load(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("k"), F.min("o_orderstatus").alias("status"), F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("f")
    )
    return mentions.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min("status").alias("status"),
        F.lit(True).alias("has_offices"),
        F.min("f")["o_totalprice"].alias("first_price"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "|").alias("offices"),
    )


@query(
    "inverted_index",
    """WITH s AS (SELECT unnest([c_mktsegment, substr(c_mktsegment, 2)]) AS surface, c_custkey AS id, unnest([0, 1]) AS k FROM customer)
    SELECT surface, count(*) AS n, min(id) AS first_id, md5(string_agg(id::VARCHAR, ',' ORDER BY id, k)) AS ids FROM s GROUP BY surface""",
)
def inverted_index(spark, d):
    """Surface -> ids in input order, repeats kept; each name is indexed whole and without its first character.

    Lists are built from (id, name part) structs, so their order never depends on partitions.
    """
    names = load(spark, d, "customer").select(F.posexplode(F.array("c_mktsegment", F.substr("c_mktsegment", F.lit(2)))).alias("k", "surface"), F.col("c_custkey").alias("id"))
    lists = names.groupBy("surface").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.array_sort(F.collect_list(F.struct("id", "k"))).alias("l"))
    return lists.select("surface", "n", "first_id", F.md5(F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ",")).alias("ids"))


# Patterns counted over articles in the tests' stand-in corpus.
ARTICLE_PATTERNS = [("password", r"password=\w+"), ("hex", r"\b[0-9a-f]{40}\b"), ("shout", r"[A-Z]{6,}!!"), ("idiot", r"\bidiot\b")]


@query(
    "pattern_index",
    "SELECT name, count(*) AS articles FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name FROM documents WHERE regexp_matches(text, '{p}')" for n, p in ARTICLE_PATTERNS)
    + ") GROUP BY name",
)
def pattern_index(spark, d):
    """Articles a pattern occurs in, each counted once."""
    hits = load(spark, d, "documents").select(F.explode(T.all_matches(F.col("text"), [(p, n) for n, p in ARTICLE_PATTERNS])).alias("name"))
    return hits.groupBy("name").agg(F.count("*").alias("articles"))


def top_k(counts: DataFrame, group: str, item: str, n: str, k: int) -> DataFrame:
    """The k most frequent items of each group, ties by item: (n, item) pairs are kept by a bounded ranking per group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), F.asc(item)))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


@query(
    "regex_topk",
    """WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[a-z]{4,}')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)
    SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rank FROM c QUALIFY rank <= 20""",
)
def regex_topk(spark, d):
    words = load(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    return top_k(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "lang", "w", "n", 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    "regex_count_rules",
    """SELECT rule, sum(n)::BIGINT AS n FROM (SELECT unnest(['the', 'und', 'que']) AS rule, unnest([len(regexp_extract_all(text, ' the ')), len(regexp_extract_all(text, ' und ')), len(regexp_extract_all(text, ' que '))]) AS n FROM documents) GROUP BY rule""",
)
def regex_count_rules(spark, d):
    rules = ["the", "und", "que"]
    one = load(spark, d, "documents").agg(*[F.sum(F.regexp_count("text", F.lit(f" {r} "))).alias(r) for r in rules])
    return one.unpivot([], rules, "rule", "n")


@query(
    "topk_per_group",
    """WITH c AS (SELECT l_returnflag AS tag, p_name AS word, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT tag, word, n, row_number() OVER (PARTITION BY tag ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 20""",
)
def topk_per_group(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("word"))
    counts = per.join(part, "l_partkey").groupBy(F.col("l_returnflag").alias("tag"), "word").agg(F.sum("n").alias("n"))
    return top_k(counts, "tag", "word", "n", 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    "movers",
    """WITH a AS (SELECT user_id, round(avg(value), 6) AS va FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, round(avg(value), 6) AS vb FROM events WHERE event_type = 'click' GROUP BY 1),
    m AS (SELECT user_id, round(vb - va, 6) AS delta FROM a JOIN b USING (user_id)) SELECT round(sum(delta), 4) AS total, round(avg(delta), 4) AS mean, count(*) FILTER (delta < 0) AS worse, count(*) FILTER (delta > 0) AS better, count(*) FILTER (delta = 0) AS same FROM m""",
)
def movers(spark, d):
    m = paired(spark, d).filter("delta is not null")
    return m.agg(F.round(F.sum("delta"), 4).alias("total"), F.round(F.avg("delta"), 4).alias("mean"), F.count_if(F.expr("delta < 0")).alias("worse"), F.count_if(F.expr("delta > 0")).alias("better"), F.count_if(F.expr("delta = 0")).alias("same"))


# The cost model's parameters.
COST_PARAMETERS = {
    "translated": 0.3, "tokens_per_char": 1.3, "prompt_tokens": 600.0, "out_ratio": 1.8, "out_tokens_per_char": 0.7, "usd_in": 1.5, "usd_out": 9.0, "usd_krw": 1400.0, "concurrency": 50.0, "latency_s": 3.2,
}


def cost_totals(texts: DataFrame, text: str, key: Column, calls: DataFrame, retried: Column, p: dict = COST_PARAMETERS) -> DataFrame:
    """One row of nine totals for the share of ``texts`` that isn't translated yet: characters, sentences, calls, tokens, money and days.

    Length of a sentence and cache hits (repeats of ``key``) are those of the texts, the share of retries that of ``calls``.
    """
    per = texts.filter(F.col(text) != "").select(F.length(text).cast("long").alias("chars"), key.alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    seen = per.agg(F.sum("chars").cast("double").alias("all_chars"), F.sum("n").cast("double").alias("all_n"), (F.sum("n") - F.count("*")).cast("double").alias("repeats"))
    tries = calls.agg((F.count_if(retried) / F.count("*")).alias("retries"))
    df = seen.join(F.broadcast(tries)).withColumn("length", F.col("all_chars") / F.col("all_n"))
    df = df.withColumn("chars", F.col("all_chars") * (1 - p["translated"])).withColumn("sentences", F.col("chars") / F.col("length"))
    df = df.withColumn("calls", F.col("sentences") * (1 - F.col("repeats") / F.col("all_n")) * (1 + F.col("retries")))
    df = df.withColumn("tokens_in", F.col("calls") * (F.col("length") * p["tokens_per_char"] + p["prompt_tokens"])).withColumn("tokens_out", F.col("calls") * (F.col("length") * p["out_ratio"] * p["out_tokens_per_char"]))
    df = df.withColumn("usd", F.col("tokens_in") / 1e6 * p["usd_in"] + F.col("tokens_out") / 1e6 * p["usd_out"])
    return df.select(
        F.round("chars", 2).alias("chars"), F.round("sentences", 2).alias("sentences"), F.round("calls", 2).alias("calls"), F.round("tokens_in", 2).alias("tokens_in"), F.round("tokens_out", 2).alias("tokens_out"),
        F.round("usd", 4).alias("usd"), F.round(F.col("usd") * p["usd_krw"], 2).alias("krw"), F.round(F.col("usd") * p["usd_krw"] / F.col("sentences"), 6).alias("krw_per_sentence"),
        F.round(F.col("calls") * p["latency_s"] / p["concurrency"] / 86400, 6).alias("days"),
    )


@query(
    "cost_model",
    """WITH k AS (SELECT md5(text) AS k, count(*) AS n, sum(length(text)) AS c FROM documents WHERE text <> '' GROUP BY 1), a AS (SELECT sum(c)::DOUBLE AS all_chars, sum(n)::DOUBLE AS all_n, (sum(n) - count(*))::DOUBLE AS repeats FROM k),
    e AS (SELECT count(*) FILTER (event_type = 'error') / count(*) AS retries FROM events), p AS (SELECT *, all_chars / all_n AS len, all_chars * (1 - 0.3::DOUBLE) AS chars FROM a, e), s AS (SELECT *, chars / len AS sentences FROM p),
    c AS (SELECT *, sentences * (1 - repeats / all_n) * (1 + retries) AS calls FROM s), t AS (SELECT *, calls * (len * 1.3::DOUBLE + 600) AS tin, calls * (len * 1.8::DOUBLE * 0.7::DOUBLE) AS tout FROM c), u AS (SELECT *, tin / 1e6 * 1.5::DOUBLE + tout / 1e6 * 9 AS usd FROM t)
    SELECT round(chars, 2) AS chars, round(sentences, 2) AS sentences, round(calls, 2) AS calls, round(tin, 2) AS tokens_in, round(tout, 2) AS tokens_out, round(usd, 4) AS usd, round(usd * 1400, 2) AS krw,
    round(usd * 1400 / sentences, 6) AS krw_per_sentence, round(calls * 3.2::DOUBLE / 50 / 86400, 6) AS days FROM u""",
)
def cost_model(spark, d):
    """Characters, sentence length and repeats from the documents, retries from the events that fail."""
    return cost_totals(load(spark, d, "documents"), "text", F.md5("text"), load(spark, d, "events"), F.col("event_type") == "error")


@query(
    "status_error_counts",
    "SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error, count(*) AS n, round(60 * count(*) / (epoch(max(o_orderdate)) - epoch(min(o_orderdate)) + 60), 6) AS per_minute FROM orders GROUP BY ALL",
)
def status_error_counts(spark, d):
    seconds = F.unix_timestamp(F.max("o_orderdate")) - F.unix_timestamp(F.min("o_orderdate")) + 60
    error = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), error.alias("error")).agg(F.count("*").alias("n"), F.round(60 * F.count("*") / seconds, 6).alias("per_minute"))


@query(
    "set_agreement",
    """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 30))) AS a, list_sort(list_distinct(list(event_type) FILTER (value > 35))) AS b FROM events GROUP BY user_id)
    SELECT count(*) AS n, round(avg(CASE WHEN coalesce(a, []) = coalesce(b, []) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM s""",
)
def set_agreement(spark, d):
    e = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 30, F.col("event_type")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("value") > 35, F.col("event_type")))).alias("b"))
    return e.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"))


@query(
    "feature_corr",
    """WITH f AS (SELECT least(length(text) / 350.0, 1.0)::DOUBLE AS len, len(regexp_extract_all(text, '\\.')) / length(text) AS dots, n_chars::DOUBLE AS n FROM documents)
    SELECT round(corr(len, dots), 6) AS len_dots, round(corr(len, n), 6) AS len_n, round(corr(dots, n), 6) AS dots_n FROM f""",
)
def feature_corr(spark, d):
    f = load(spark, d, "documents").select(
        F.least(F.length("text") / F.lit(350.0), F.lit(1.0)).alias("len"), (F.regexp_count("text", F.lit(r"\.")) / F.length("text")).alias("dots"), F.col("n_chars").cast("double").alias("n")
    )
    return f.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in (("len", "dots"), ("len", "n"), ("dots", "n"))])


@query(
    "feature_entropy",
    """WITH v AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), b AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 10) AS INT), 9) AS bin, count(*) AS c, any_value(n) AS n FROM events, v GROUP BY 1)
    SELECT round(-sum(c / n * ln(c / n)), 6) AS entropy FROM b""",
)
def feature_entropy(spark, d):
    """Entropy over ten equal bins: a feature's importance without labels."""
    e = load(spark, d, "events")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    bins = e.join(F.broadcast(span)).groupBy(F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).alias("bin"), "n").agg(F.count("*").alias("c"))
    return bins.agg(F.round(-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n"))), 6).alias("entropy"))


@query("metric_counters", "SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def metric_counters(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("token_ratio", "SELECT round(avg(length(text) / n_chars), 6) AS mean, round(median(length(text) / n_chars), 6) AS median FROM documents")
def token_ratio(spark, d):
    r = F.length("text") / F.col("n_chars")
    docs = load(spark, d, "documents")
    return docs.agg(F.round(F.avg(r), 6).alias("mean")).join(F.broadcast(quantiles(docs, r, {"median": share(0.5)}))).select("mean", F.round("median", 6).alias("median"))

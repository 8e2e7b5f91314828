"""Smaller operators: feature scaling, sample representativeness, index dumps, replay pairs, name repair, ports."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions.shipping import ship
from loomline.plans.registry import load, query

from .replay import _ITEMS_SQL, cache_items, replay


@query("feature_minmax", "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 1e-8), 6) AS scaled FROM events")
def feature_minmax(spark, d):
    """Scaled to 0..1 by a one-row aggregate that is broadcast, not a window over all rows."""
    e = load(spark, d, "events")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(F.broadcast(span)).select("event_id", F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8), 6).alias("scaled"))


@query(
    "token_features",
    """WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, round(least(len(w) / 40.0, 1.0), 6)::DOUBLE AS length_norm,
    round(len(list_distinct(list_transform(w, lambda x: lower(rtrim(ltrim(x, '.,!?;:'), '.,!?;:'))))) / greatest(len(w), 1), 6) AS richness FROM t""",
)
def token_features(spark, d):
    """Length and variety of words."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    bare = F.transform(words, lambda x: F.lower(F.rtrim(F.ltrim(x, F.lit(".,!?;:")), F.lit(".,!?;:"))))
    rows = load(spark, d, "documents")
    return rows.select("doc_id", F.round(F.least(F.size(words) / F.lit(40.0), F.lit(1.0)), 6).alias("length_norm"), F.round(F.size(F.array_distinct(bare)) / F.greatest(F.size(words), F.lit(1)), 6).alias("richness"))


@query(
    "stratum_kl",
    """WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS k FROM documents GROUP BY lang), p AS (SELECT n / sum(n) OVER () AS pop, k / sum(k) OVER () AS sam FROM s) SELECT round(sum(sam * ln(sam / pop)) FILTER (sam > 0), 6) AS kl FROM p""",
)
def stratum_kl(spark, d):
    """Kullback-Leibler divergence of a sample's strata from the population's."""
    per = load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 7 == 0).alias("k"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    p, s = F.col("n") / F.col("all_n"), F.col("k") / F.col("all_k")
    return per.join(F.broadcast(total)).agg(F.round(F.sum(F.when(F.col("k") > 0, s * F.log(s / p))), 6).alias("kl"))


@query("index_json", "SELECT n_regionkey AS region, '{\"' || string_agg(n_name || '\":' || n_nationkey, ',\"' ORDER BY n_nationkey) || '}' AS js FROM nation GROUP BY 1")
def index_json(spark, d):
    """Map-shaped JSON of each region's nations, in key order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))))
    return load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.map_from_entries(F.transform(rows, lambda r: F.struct(r["name"], r["k"])))).alias("js"))


@query("hit_storer_pairs", f"WITH {_ITEMS_SQL} SELECT p AS stored_by, pos FROM o WHERE outcome = 'L2'")
def hit_storer_pairs(spark, d):
    """Each second-level hit with the row that stored its template."""
    out = replay(cache_items(spark, d))
    hits = out.filter("outcome = 'L2'").select("template_hash", "pos")
    first = out.filter("outcome = 'LLM' AND grade = 'VERIFIED' AND stores").groupBy("template_hash").agg(F.min("pos").alias("stored_by"))
    return hits.join(first, "template_hash").select("stored_by", "pos")


@query("parse_errors", "SELECT count(*) FILTER (event_id % 9 = 0) AS parse_errors, count(*) AS calls, sum(user_id)::BIGINT AS tokens FROM events")
def parse_errors(spark, d):
    """Outputs that don't parse are errors, but their usage counts."""
    raw = F.when(F.col("event_id") % 9 == 0, "{oops").otherwise(F.col("props"))
    return load(spark, d, "events").agg(F.count_if(F.from_json(raw, "k int")["k"].isNull()).alias("parse_errors"), F.count("*").alias("calls"), F.sum("user_id").alias("tokens"))


def _repair(text: str, name: str, reading: str | None) -> str:
    if name in text or len(name) < 2:
        return text
    found = [(i, text[i : i + len(name)]) for i, c in enumerate(text) if c == name[0]]
    found = [(i, x) for i, x in found if len(x) == len(name) and all("가" <= c <= "힣" for c in x)]
    at = found[0][0] if len(found) == 1 else next((i for i, x in found if reading and x == reading), None)
    return text if at is None else text[:at] + name + text[at + len(name) :]


@F.arrow_udf(StringType())
def repair_name(texts: pa.Array, names: pa.Array, readings: pa.Array) -> pa.Array:
    """A name read wrongly is put right: one run of Hangul with its first syllable and length, or the one that equals a reading."""
    rows = zip(texts.to_pylist(), names.to_pylist(), readings.to_pylist(), strict=True)
    return pa.array([None if t is None or n is None else _repair(t, n, r) for t, n, r in rows], pa.string())


@query("name_repair", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '강선이 갔다' WHEN p_partkey % 3 = 1 THEN '강선이 강수에게' ELSE '강수와 강무가' END AS fixed FROM part")
def name_repair(spark, d):
    ship(spark)
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "강성이 갔다").when(k == 1, "강성이 강수에게").otherwise("강수와 강무가")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), repair_name(text, F.lit("강선"), F.when(k == 1, "강성").otherwise(F.lit(None).cast("string"))).alias("fixed"))


@query("running_share", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def running_share(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("o_custkey")
    return load(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w) / F.sum("o_totalprice").over(whole), 6).alias("share"))


def recognise(df: DataFrame, text: str, recogniser: Callable[[Column], Column], known: DataFrame | None = None, key: str = "hash") -> DataFrame:
    """Port for a recogniser: the distinct texts that ``known`` (hash, entities) lacks go through it once, and all rows get their entities.

    ``recogniser`` maps a text column to entities, and must raise rather than give an empty list when it can't work.
    """
    rows = df.withColumn(key, F.sha2(F.col(text), 256))
    todo = rows.select(key, text).dropDuplicates([key])
    if known is not None:
        todo = todo.join(known.select(key), key, "left_anti")
    fresh = todo.select(key, recogniser(F.col(text)).alias("entities"))
    return rows.join(fresh if known is None else known.unionByName(fresh), key, "left")


def translate_uncached(df: DataFrame, cache: DataFrame, key: str, translator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Port for a model: only rows whose key the cache lacks, one a key, reach ``translator``; all rows get (translation)."""
    missing = df.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    done = translator(missing).select(key, "translation")
    return df.join(cache.select(key, "translation").unionByName(done), key, "left")

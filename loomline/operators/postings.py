"""Posting lists in blocks: (surface, block) -> the ids of one range, delta-coded, so no surface is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.plans.registry import load, query
from loomline.sources import sinks

#: Ids of a block, as a power of two: a block holds 4096 at most.
BLOCK_BITS = 12


def posting_blocks(entries: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(surface, block, first, n, deltas) from ``entries`` (surface, id long): the distinct ids from block * 2^bits on, each as its distance to the one before.

    A block has at most 2^bits ids whatever a surface has, repeats are combined before the shuffle, and new entries touch their
    own blocks only. Null surfaces or ids are left out.
    """
    ids = entries.filter("surface is not null and id is not null").select("surface", F.shiftright("id", bits).alias("block"), "id").distinct()
    lists = ids.groupBy("surface", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    deltas = F.transform("ids", lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(x - F.element_at("ids", i.cast("int")))).cast("array<int>")
    return lists.select("surface", "block", F.element_at("ids", 1).alias("first"), F.size("ids").cast("long").alias("n"), deltas.alias("deltas"))


def block_ids(blocks: DataFrame, *keep: str) -> DataFrame:
    """(surface, id) and the columns ``keep`` from blocks."""
    so_far = F.aggregate("deltas", F.array(F.col("first")).cast("array<bigint>"), lambda a, d: F.concat(a, F.array(F.element_at(a, -1) + d)))
    return blocks.select("surface", *keep, F.explode(F.slice(so_far, 2, F.size("deltas"))).alias("id"))


def write_postings(blocks: DataFrame, path: str) -> None:
    """Sorted by surface and block, so that statistics let a reader skip files and row groups."""
    blocks.repartitionByRange("surface", "block").sortWithinPartitions("surface", "block").write.mode("overwrite").parquet(path)


def intersect(blocks: DataFrame, left: str, right: str) -> DataFrame:
    """The ids that both surfaces have: blocks meet by number, ids only within them; blocks that one of the two lacks are never opened."""
    a, b = blocks.filter(F.col("surface") == left), blocks.filter(F.col("surface") == right)
    both = a.join(b.select("block"), "block", "left_semi"), b.join(a.select("block"), "block", "left_semi")
    return block_ids(both[0]).select("id").join(block_ids(both[1]).select("id"), "id", "left_semi")


# --- queries


def _brands(spark, d) -> DataFrame:
    """Each line's brand and order: the postings of 25 surfaces."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("surface"))
    return load(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("id")).join(part, "l_partkey").select("surface", "id")


@query(
    "posting_blocks",
    """SELECT p_brand AS surface, l_orderkey // 4096 AS block, min(l_orderkey) AS first, count(DISTINCT l_orderkey) AS n, max(l_orderkey) AS last, md5(string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR)) AS ids
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def brand_blocks(spark, d):
    """The orders of each brand, written in blocks and read back: their ids' digest, first and last."""
    path = sinks.scratch(spark, "postings")
    write_postings(posting_blocks(_brands(spark, d)), path)
    ids = block_ids(spark.read.parquet(path), "block", "first", "n")
    digest = F.md5(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","))
    return ids.groupBy("surface", "block", "first", "n").agg(F.max("id").alias("last"), digest.alias("ids"))


@query(
    "posting_intersection",
    """WITH b AS (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), lo AS (SELECT min(p_brand) AS lo, max(p_brand) AS hi FROM part)
    SELECT l_orderkey AS id FROM b, lo WHERE p_brand = lo INTERSECT SELECT l_orderkey FROM b, lo WHERE p_brand = hi""",
)
def posting_intersection(spark, d):
    """Orders with both the first and the last brand, from their posting blocks."""
    lo, hi = load(spark, d, "part").agg(F.min("p_brand"), F.max("p_brand")).first()
    path = sinks.scratch(spark, "postings")
    write_postings(posting_blocks(_brands(spark, d)), path)
    return intersect(spark.read.parquet(path), lo, hi)

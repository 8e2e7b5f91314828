"""Corpus pipeline over ``documents``: toxicity, exact dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept; all but the last return the columns
of documents. Results between stages are tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from loomline.llm.common import Tables

#: No stage but exact dedup can be written in SQL; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5 stay. It learns from the labelled ones among them, the fold of op2.

    Null and empty texts have the base rate; repeated rows go or stay alike; very long texts are scored whole; rows with a
    null key are scored, but not learned from; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.remainder(F.col("doc_id"), 5) != 0)
    return toxicity.keep_civil(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null counts as empty; a null key loses to any other; rows that repeat key and text are one; an empty table stays empty.
    """
    return exact_dedup.keep_distinct(docs)


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of near duplicates (five-word shingles, similarity of 0.8 or more): the smallest doc_id.

    Texts without words and rows with a null key all stay; rows that repeat a key are one document; an empty table stays empty.
    """
    return jaccard_join.keep_one_each(docs, shingle=5, num=8, den=10)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item stay; null and empty texts do, and repeated rows go or stay alike."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is its end token, repeated rows are packed each, an empty table gives no rows.

    Workers remember few pieces, as they still hold what earlier stages took.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048, most_pieces=200_000)


STAGES = [
    ("toxicity", civil),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", distinct_sets),
    ("decontamination", untested),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's input is deleted once its output is saved, the last one's stays for the lazy result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    tables = Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

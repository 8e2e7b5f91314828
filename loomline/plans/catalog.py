"""The catalogue of the library's queries: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import aggregates, cache, databases, extras, filters, jobs, joins, neighbours, order, ordering, postings, prompts, replay, reports, scoring, services, sourced, textual, writes  # noqa: F401
from loomline.streaming import consumer, timers  # noqa: F401
from loomline.streaming import queries as streaming_queries  # noqa: F401

from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity linking, then the distribution of difficulty tiers."""
    return QUERIES["tier_distribution"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

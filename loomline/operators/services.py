"""Texts enriched by a recogniser behind a call; here the call is a function in the process, as a query has no server to ask."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from loomline.plans.registry import load, query
from loomline.sources import remote, sinks

_tried: set[str] = set()


def recogniser(request: str) -> str:
    """Stands in for a service: capitalised words as entities. It fails for good on texts with an insult, and once on texts with a colon."""
    text = json.loads(request)["text"]
    if re.search(r"\bidiot\b", text):
        raise ValueError("refused")
    if ":" in text and text not in _tried:
        _tried.add(text)
        raise remote.Transient("busy")
    _tried.discard(text)
    return json.dumps(re.findall("[A-Z][a-z]+", text))


@query(
    "remote_entities",
    """WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
    SELECT sha256(text) AS key, CASE WHEN NOT regexp_matches(text, '\\bidiot\\b') THEN len(regexp_extract_all(text, '[A-Z][a-z]+')) END AS entities, CASE WHEN regexp_matches(text, '\\bidiot\\b') THEN 'ValueError: refused' END AS error,
    CASE WHEN contains(text, ':') AND NOT regexp_matches(text, '\\bidiot\\b') THEN 2 ELSE 1 END AS attempts FROM d""",
)
def remote_entities(spark, d):
    """Each distinct text is asked for once, transient failures again; a refusal is an error, no entities an empty answer."""
    docs = load(spark, d, "documents").filter("text is not null")
    requests = docs.select(F.sha2("text", 256).alias("key"), F.to_json(F.struct("text", F.lit(0.5).alias("min_score"))).alias("request"))
    got = remote.enrich(requests, recogniser, sinks.scratch(spark, "answers"), wait_s=0.001, rounds=2)
    return got.select("key", F.size(F.from_json("answer", "array<string>")).alias("entities"), "error", "attempts").withColumn("entities", F.when(F.col("error").isNull(), F.col("entities")))

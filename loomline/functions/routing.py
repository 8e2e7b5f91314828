"""Difficulty tiers, failure classes and retry hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of formulaic sentences, with their class.
FORMULAIC = [
    ("傳曰|傳敎曰|下敎曰|傳旨", "전교"),
    ("答曰|答敎曰", "비답"),
    ("啓曰|啓言|狀啓|書啓|馳啓", "계사"),
    ("傳于.{0,10}曰", "전교(대상 지정)"),
    ("知道|依啓|勿煩|省疏具悉", "정형 비답"),
    ("允許|允從|不允|不許", "윤허·불윤"),
    ("藥房|無所啓|無事", "정례 보고"),
    ("常參|經筵|晝講|朝講|夕講", "강연 정례"),
    ("謝恩|下直|入直|政事", "정례 인사"),
]
# Patterns and the phrase to use for each, in order.
PHRASES = [
    ("傳敎曰|下敎曰|傳旨", "전교하기를"),
    ("啓曰|啓言|狀啓", "아뢰기를 / 장계하기를"),
    ("允許|允從|許之(?!諫)", "윤허하다"),
    ("不許|不允", "윤허하지 않다"),
    ("拜.*爲|除授|落點", "제수하다"),
    ("行幸|臨幸", "거둥하다"),
    ("還宮", "환궁하다"),
    ("書啓", "서계하기를"),
    ("馳啓", "치계하기를"),
]


def signals(text: Column, entities: Column, formulaic: list[tuple[str, str]] = FORMULAIC) -> Column:
    """Counts of entities by type and of persons by link result, and whether a formulaic pattern occurs."""
    count = lambda f: F.size(F.filter(entities, f))
    person = lambda e: e["type"] == "PER"
    return F.struct(
        F.size(entities).alias("entities"),
        count(person).alias("per"),
        count(lambda e: e["type"] == "LOC").alias("loc"),
        count(lambda e: e["type"] == "DAT").alias("dat"),
        count(lambda e: person(e) & e["kb_id"].isNotNull()).alias("confirmed"),
        count(lambda e: person(e) & e["kb_id"].isNull() & (e["link_stage"] == "MISS")).alias("kb_miss"),
        count(lambda e: person(e) & e["kb_id"].isNull() & (e["link_stage"] == "AMBIGUOUS")).alias("ambiguous"),
        F.coalesce(text.rlike("|".join(p for p, _ in formulaic)), F.lit(False)).alias("formulaic"),
    )


def tier(s: Column) -> Column:
    """T2 with an ambiguous person, T0 for a formulaic sentence without entities, else T1."""
    return F.when(s["ambiguous"] > 0, "T2").when((s["entities"] == 0) & s["formulaic"], "T0").otherwise("T1")


def tier_reason(s: Column) -> Column:
    return (
        F.when(s["ambiguous"] > 0, F.concat(F.lit("ambiguous persons: "), s["ambiguous"].cast("string")))
        .when((s["entities"] == 0) & s["formulaic"], "no entity, formulaic")
        .when(s["kb_miss"] > 0, F.concat(F.lit("unknown persons: "), s["kb_miss"].cast("string")))
        .when((s["per"] == 0) & (s["entities"] == 0), "no entity, not formulaic")
        .when(s["per"] == 0, "no person")
        .otherwise(F.concat(F.lit("confirmed persons: "), s["confirmed"].cast("string")))
    )


# Failure class -> (retryable, dead at once).
ERROR_FLAGS = {
    "SPEND_CAP": (False, True),
    "QUOTA_DAILY": (False, False),
    "RATE_LIMITED": (True, False),
    "SERVER_ERROR": (True, False),
    "TIMEOUT": (True, False),
    "AUTH_FAILED": (False, True),
    "MODEL_UNAVAILABLE": (False, True),
    "PARSE_ERROR": (True, False),
    "CONTENT_FILTERED": (False, True),
    "NER_UNAVAILABLE": (True, False),
    "UNKNOWN": (True, False),
}
# Failure class -> (status, code, retry-after) for an operator's key; a caller's own key changes three.
ERROR_HTTP = {
    "RATE_LIMITED": (429, "LLM_RATE_LIMITED", True),
    "QUOTA_DAILY": (429, "LLM_QUOTA_DAILY", True),
    "SPEND_CAP": (502, "LLM_SPEND_CAP", False),
    "AUTH_FAILED": (502, "LLM_UPSTREAM_AUTH", False),
    "CONTENT_FILTERED": (422, "LLM_CONTENT_FILTERED", False),
    "NER_UNAVAILABLE": (503, "NER_UNAVAILABLE", True),
    "TIMEOUT": (504, "LLM_TIMEOUT", False),
    "SERVER_ERROR": (502, "LLM_UPSTREAM_ERROR", False),
    "MODEL_UNAVAILABLE": (502, "LLM_MODEL_UNAVAILABLE", False),
    "PARSE_ERROR": (502, "LLM_PARSE_ERROR", False),
    "UNKNOWN": (500, "INTERNAL_ERROR", False),
}
ERROR_HTTP_OWN_KEY = {"SPEND_CAP": (403, "LLM_SPEND_CAP", False), "AUTH_FAILED": (400, "LLM_KEY_REJECTED", False)}


def error_class(message: Column, kind: Column | None = None) -> Column:
    """Class of a failure message; ``kind`` names typed failures ('parse', 'ner'), which go first. Codes are whole words: 5000ms is no 500."""
    m = F.lower(F.coalesce(message, F.lit("")))
    any_of = lambda *parts: m.rlike("|".join(parts))
    limited = any_of(r"\b429\b", "resource_exhausted")
    typed = F.when(kind == "parse", "PARSE_ERROR").when(kind == "ner", "NER_UNAVAILABLE") if kind is not None else F.when(F.lit(False), "")
    return (
        typed.when(limited & m.contains("spending cap"), "SPEND_CAP")
        .when(limited & any_of("perday", "per day"), "QUOTA_DAILY")
        .when(limited, "RATE_LIMITED")
        .when(any_of("api_key_invalid", "api key not valid", "api key expired", "permission_denied", "unauthenticated"), "AUTH_FAILED")
        .when(any_of(r"\b404\b", "not_found", "no longer available"), "MODEL_UNAVAILABLE")
        .when(any_of(r"\b503\b", "unavailable", r"\b500\b", "internal"), "SERVER_ERROR")
        .when(any_of("timed out", "timeout"), "TIMEOUT")
        .when(any_of("safety", "blocked", "prohibited"), "CONTENT_FILTERED")
        .otherwise("UNKNOWN")
    )


# Where providers state when to retry, in order, and the longest wait believed.
RETRY_PATTERNS = (r"(?i)retry\s+in\s+([0-9]+(?:\.[0-9]+)?)\s*s", r"(?i)retry[_-]?delay\"?\s*[:=]\s*\"?([0-9]+(?:\.[0-9]+)?)\s*s")
RETRY_MOST_MS = 300_000


def retry_hint_ms(message: Column) -> Column:
    found = F.coalesce(*[F.when(message.rlike(p), F.regexp_extract(message, p, 1)) for p in RETRY_PATTERNS])
    wait = F.round(found.cast("double") * 1000).cast("long")
    return F.when(wait > RETRY_MOST_MS, F.lit(RETRY_MOST_MS).cast("long")).otherwise(wait)


def retry_attempts(failed: DataFrame, cls: str, attempts: int = 2, base_ms: int = 2000, factor: int = 2, jitter: float = 0.5) -> DataFrame:
    """A row an attempt of each failing call, with the wait after it and the bounds that jitter sets; none after the last.

    Only classes that may pass are tried again, and parse errors aren't: the same output would come back.
    """
    again = F.col(cls).isin([c for c, (retry, _) in ERROR_FLAGS.items() if retry and c != "PARSE_ERROR"])
    rows = failed.withColumn("_last", F.when(again, attempts).otherwise(1)).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("_last"))))
    wait = F.when(F.col("attempt") < F.col("_last"), base_ms * F.pow(F.lit(factor), F.col("attempt") - 1))
    return rows.withColumns({"wait_ms": wait.cast("long"), "least_ms": (wait * (1 - jitter)).cast("long"), "most_ms": (wait * (1 + jitter)).cast("long")}).drop("_last")


def failure_outcome(cls: Column, delivery: Column) -> Column:
    """struct(status, error, dead_letter, pause_batch, acknowledge) of a failed job at its nth delivery."""
    dead_now = cls.isin([c for c, (_, dead) in ERROR_FLAGS.items() if dead])
    quota = cls == "QUOTA_DAILY"
    worn_out = ~dead_now & ~quota & (delivery >= 4)
    return F.struct(
        F.when(dead_now | worn_out, "DEAD").otherwise("FAILED").alias("status"),
        F.when(worn_out, F.concat(cls, F.lit("_MAX_REDELIVERY"))).otherwise(cls).alias("error"),
        (dead_now | worn_out).alias("dead_letter"),
        cls.isin("QUOTA_DAILY", "SPEND_CAP").alias("pause_batch"),
        (dead_now | quota | worn_out).alias("acknowledge"),
    )

"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks of the canonical hash: ASCII only, so a no-break space stays.
ASCII_BLANKS = r"\s+"


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode NFC; the built-in functions have none. ASCII texts are passed on as they are."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def percent(part: Column, whole: Column) -> Column:
    """``12.34%``, halves to even; a dash where there is no whole."""
    return F.when(whole == 0, "—").otherwise(F.format_string("%.2f%%", F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 2)))


def normalized_hash(text: Column) -> Column:
    """Hex SHA-256 of the NFC form without ASCII blanks."""
    return F.sha2(F.regexp_replace(nfc(text), ASCII_BLANKS, ""), 256)


def clean_output(text: Column, deep: bool = False) -> Column:
    """Drop reasoning blocks and list circles; ``deep`` also drops brackets that hold Han characters and squeezes blanks."""
    out = F.regexp_replace(text, r"(?s)<thought>.*?</thought>", "")
    if deep:
        out = F.regexp_replace(out, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^\s*○\s*", ""), "○", " ")
    if deep:
        out = F.regexp_replace(F.regexp_replace(out, r"\([^)]*[一-鿿][^)]*\)", ""), r"\s+", " ")
    return F.trim(out)


def han_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[一-鿿]")) / F.greatest(F.length(text), F.lit(1))


def bucket(n: Column, edges: list[tuple[int, str]], last: str, inclusive: bool) -> Column:
    """The first label whose edge ``n`` doesn't pass; the scorers' length buckets differ in edges and in inclusiveness."""
    out = None
    for edge, label in edges:
        hit = n <= edge if inclusive else n < edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule, in order, whose pattern occurs; null if none does."""
    out = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def all_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all rules whose pattern occurs, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules]))


def reign_year(doc_id: Column) -> Column:
    """AD year of ids like ``SJW-A07...``: the fifth character A, then a two-digit year counted from 1623; else null."""
    return F.when(F.substring(doc_id, 5, 1) == "A", F.lit(1623) + F.substring(doc_id, 6, 2).try_cast("int") - 1)


def snippet(text: Column, pattern: str, before: int = 15, after: int = 80, most: int = 100) -> Column:
    """A window around the first match, cut at the first line feed after the match begins, at most ``most`` characters and an ellipsis."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    window = F.substring(text, start, at - start + after)
    line = F.concat(F.substring(window, F.lit(1), at - start), F.split_part(F.substr(window, at - start + 1), F.lit("\n"), F.lit(1)))
    return F.when(at > 0, F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line))


def json_block(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, whatever fences stand around; null without."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) * F.lit(0.65)).cast("long")

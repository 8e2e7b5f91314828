"""Prompts built of optional sections, first candidates, links by entity type, messages in brief and tables as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.registry import load, query

from .joins import MENTIONS_SQL, _index, _people, mentions
from .order import dense_order
from .replay import _SENT_SQL, render, sentences
from .textual import _FAILED_SQL, failures

# Titles of a prompt's sections, marks of their lines, and the instruction that names go before.
NAMES_TITLE = "[등장 인물 — 반드시 아래 한글명 그대로 사용]"
PERIOD_TITLE = "[현대어 X → 실록 문체 O — 반드시 대체]"
PHRASES_TITLE = "[이 원문 패턴에서 반드시 사용할 표현]"
RULE_TITLE = "[번역 규칙]"
LINE_MARK = "  · "
INSTRUCTION = "위 문체로 다음 한문을 현대 한국어로 번역하세요. 번역문만 출력하세요:"


def lines(items: Column, mark: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")


def section(title: str, items: Column) -> Column:
    """A title and a line an item; nothing without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), lines(items, LINE_MARK))).otherwise("")


def before(prompt: Column, line: str, block: Column) -> Column:
    """``block`` put before a line of the prompt; an empty one changes nothing."""
    return F.when(block == "", prompt).otherwise(F.replace(prompt, F.lit(line), F.concat(block, F.lit("\n" + line))))


def period_pairs(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*[F.lit(f"{modern} X → {period} O") for modern, period in pairs])


def phrase_rule(phrase: Column, instead_of: Column, usage: Column) -> Column:
    """The rule that a phrase must be used, not others, and a usage where there is one; nothing without a phrase."""
    use = F.concat(F.lit(f"\n{RULE_TITLE}\n{LINE_MARK}「"), phrase, F.lit("」를 반드시 사용하세요. ("), instead_of, F.lit(")"))
    return F.coalesce(F.concat(use, F.coalesce(F.concat(F.lit(f'\n{LINE_MARK}용례: "'), usage, F.lit('"')), F.lit("")), F.lit("\n")), F.lit(""))


_EXAMPLES = ("이르기를", "아뢰기를")
_PAIRS = [("왕", "상"), ("했다", "하였다")]
_MARKED = f"chr(10) || '{LINE_MARK}' || "


@query(
    "prompt_names",
    f"""SELECT p_partkey AS id, '- 이르기를' || chr(10) || '- 아뢰기를' || chr(10) || CASE WHEN p_size >= 10 THEN '{NAMES_TITLE}' || {_MARKED} p_brand || ' → ' || p_name || CASE WHEN p_size >= 20 THEN {_MARKED} p_type || ' → ' || p_brand ELSE '' END || chr(10) ELSE '' END || '{INSTRUCTION}' || chr(10) || p_name AS prompt FROM part""",
)
def prompt_names(spark, d):
    """Examples, then the names to use before the instruction; of small parts none are known."""
    p = load(spark, d, "part")
    pair = lambda a, b, least: F.when(F.col("p_size") >= least, F.concat(a, F.lit(" → "), b))
    names = F.array_compact(F.array(pair(F.col("p_brand"), F.col("p_name"), 10), pair(F.col("p_type"), F.col("p_brand"), 20)))
    base = render("{examples}\n" + INSTRUCTION + "\n{text}", examples=lines(F.array(*map(F.lit, _EXAMPLES)), "- "), text=F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), before(base, INSTRUCTION, section(NAMES_TITLE, names)).alias("prompt"))


@query(
    "prompt_period",
    f"""SELECT p_partkey AS id, chr(10) || '{PERIOD_TITLE}' || {_MARKED} '왕 X → 상 O' || {_MARKED} '했다 X → 하였다 O' || chr(10) || CASE WHEN p_size >= 25 THEN '{PHRASES_TITLE}' || {_MARKED} p_brand ELSE '' END || chr(10) || p_name AS prompt FROM part""",
)
def prompt_period(spark, d):
    """The table of modern and period words, then the phrases that the text's patterns call for."""
    phrases = F.array_compact(F.array(F.when(F.col("p_size") >= 25, F.col("p_brand"))))
    out = render("\n{period}\n{phrases}\n{text}", period=section(PERIOD_TITLE, period_pairs(_PAIRS)), phrases=section(PHRASES_TITLE, phrases), text=F.col("p_name"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), out.alias("prompt"))


@query(
    "prompt_phrase",
    f"""SELECT p_partkey AS id, CASE WHEN p_size >= 10 THEN chr(10) || '{RULE_TITLE}' || {_MARKED} '「' || p_brand || '」를 반드시 사용하세요. (' || p_type || ')' || CASE WHEN p_size >= 20 THEN {_MARKED} '용례: "' || p_name || '"' ELSE '' END || chr(10) ELSE '' END || chr(10) || p_name AS prompt FROM part""",
)
def prompt_phrase(spark, d):
    size = F.col("p_size")
    rule = phrase_rule(F.when(size >= 10, F.col("p_brand")), F.col("p_type"), F.when(size >= 20, F.col("p_name")))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(rule, F.lit("\n"), "p_name").alias("prompt"))


@query("person_links", f"WITH {_SENT_SQL} SELECT id, p_name || ':' || id || ';' || p_brand || ':' || CASE WHEN size >= 20 THEN 'b' ELSE '-' END || ';' || p_type || ':-' AS links FROM t")
def person_links(spark, d):
    """Only persons are linked; other entities pass through without a link."""
    rows = sentences(spark, d)
    looked_up = F.transform("entities", lambda e: F.concat_ws(":", e["surface"], F.when((e["type"] == "PER") & e["kb_id"].isNotNull(), e["kb_id"]).otherwise("-")))
    return rows.select("id", F.array_join(looked_up, ";").alias("links"))


def first_names(rows: DataFrame, index: DataFrame, people: DataFrame, reading: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (surface, ...) with ``name``: that of the first person in the surface's index, else the reading of the surface where it differs from it.

    The index is cut to a person a surface before it meets the rows.
    """
    first = index.groupBy("surface").agg(F.min_by("person_id", "pos").alias("person_id")).join(people.select("person_id", F.col("name").alias("_known")), "person_id", "left").drop("person_id")
    read = reading(F.col("surface"))
    return rows.join(first, "surface", "left").withColumn("name", F.coalesce("_known", F.when((read != "") & (read != F.col("surface")), read))).drop("_known")


@query(
    "first_candidate",
    f"WITH {MENTIONS_SQL}, f AS (SELECT surface, arg_min(p_name, pos) AS known FROM entry GROUP BY surface) SELECT doc_id, line, coalesce(known, nullif(upper(m.surface), m.surface)) AS name FROM mentions m LEFT JOIN f USING (surface)",
)
def first_candidate(spark, d):
    """Upper case stands in for the reading, which is a function to plug in."""
    return first_names(mentions(spark, d), _index(spark, d), _people(spark, d), F.upper).select("doc_id", "line", "name")


def brief(chain: Column, most: int = 200) -> Column:
    """``Kind: message`` of a chain's root cause, its last struct(kind, message); the message is cut, a missing one reads null."""
    root = F.element_at(chain, -1)
    return F.concat(root["kind"], F.lit(": "), F.substring(F.coalesce(root["message"], F.lit("null")), 1, most))


@query(
    "error_brief",
    f"WITH {_FAILED_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Wrapped: null' ELSE class || ': ' || substr(repeat(message, 10), 1, 200) END AS short, substr(repeat(message, 20), 1, 300) AS shown, substr(repeat(message, 30), 1, 400) AS dead FROM c",
)
def error_brief(spark, d):
    """Messages cut for the log (200, of the root cause), the answer (300) and the dead letter (400)."""
    m = F.col("message")
    cause = lambda kind, text: F.struct(kind.alias("kind"), text.alias("message"))
    direct, wrapped = cause(F.col("class"), F.repeat(m, F.lit(10))), cause(F.lit("Wrapped"), F.lit(None).cast("string"))
    chain = F.when(F.col("event_id") % 3 == 0, F.array(direct, wrapped)).otherwise(F.array(direct))
    return failures(spark, d).select("event_id", brief(chain).alias("short"), F.substring(F.repeat(m, F.lit(20)), 1, 300).alias("shown"), F.substring(F.repeat(m, F.lit(30)), 1, 400).alias("dead"))


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """A table as text: (line, text), head and rule first. Lines are numbered by ranges, so a long table is no list in one task."""
    cells = lambda parts: F.concat(F.lit("| "), F.array_join(F.array(*parts), " | ", "—"), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "line long, text string")
    body = dense_order(rows, order, "_line").select((F.col("_line") + 2).alias("line"), cells([F.col(c).cast("string") for c in rows.columns]).alias("text"))
    return head.unionByName(body)


@query(
    "markdown_report",
    """WITH r AS (SELECT r_name, count(*) AS nations, min(n_name) FILTER (n_nationkey % 2 = 0) AS even FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT 0 AS line, '| r_name | nations | even |' AS text UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' | ' || nations || ' | ' || coalesce(even, '—') || ' |' FROM r""",
)
def markdown_report(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return markdown(n.groupBy("r_name").agg(F.count("*").alias("nations"), F.min(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("even")), ["r_name"])

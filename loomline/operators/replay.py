"""Slotting, quality gate, routing, prompts and cache replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import routing, slots
from loomline.functions import text as T
from loomline.plans.registry import load, query

from .aggregates import GRADE_SQL

_NAMES = ("김류", "강선", "이원익", "정문회")
_NAME_SQL = "['김류', '강선', '이원익', '정문회']"


def _name(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _NAMES)), (k % 4 + 1).cast("int"))


def sentences(spark, d) -> DataFrame:
    """A sentence a part: its name is a confirmed person, its brand one that is confirmed, ambiguous or unknown by size, its type a place."""
    p = load(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    known = size >= 20
    entity = lambda surface, kind, kb, name, stage: F.struct(
        surface.alias("surface"), F.lit(kind).alias("type"), kb.alias("kb_id"), name.alias("resolved_name"), stage.alias("link_stage")
    )
    none = F.lit(None).cast("string")
    return p.select(
        key.alias("id"),
        size.alias("size"),
        F.concat("p_brand", F.lit(" met "), "p_name", F.lit(" at "), "p_type", F.lit(" with "), "p_name").alias("text"),
        F.array(
            entity(F.col("p_name"), "PER", key.cast("string"), _name(key), F.lit("SINGLE")),
            entity(F.col("p_brand"), "PER", F.when(known, F.lit("b")), F.when(known, _name(key + 1)), F.when(known, "TIME").when(size >= 10, "AMBIGUOUS").otherwise("MISS")),
            entity(F.col("p_type"), "LOC", none, none, none),
        ).alias("entities"),
        F.concat(_name(key), F.lit("가 "), F.when(key % 5 == 0, F.lit("그")).otherwise(_name(key + 1)), F.lit("를 보았다")).alias("translation"),
    )


_SENT_SQL = f"""s AS (SELECT p_partkey AS id, p_size AS size, p_name, p_brand, p_type, p_brand || ' met ' || p_name || ' at ' || p_type || ' with ' || p_name AS text, {_NAME_SQL}[p_partkey % 4 + 1] AS n1, {_NAME_SQL}[(p_partkey + 1) % 4 + 1] AS n2 FROM part),
t AS (SELECT *, n1 || '가 ' || CASE WHEN id % 5 = 0 THEN '그' ELSE n2 END || '를 보았다' AS translation, CASE WHEN size >= 20 THEN 2 ELSE 1 END AS slots,
CASE WHEN size >= 20 THEN replace(replace(text, p_name, '⟪PER2⟫'), p_brand, '⟪PER1⟫') ELSE replace(text, p_name, '⟪PER1⟫') END AS template FROM s)"""


def _slotted(spark, d) -> DataFrame:
    rows = sentences(spark, d)
    rows = rows.withColumn("slots", slots.confirmed(F.col("text"), F.col("entities")))
    return rows.withColumn("template", slots.source_template(F.col("text"), F.col("slots")))


@query("slot_template", f"WITH {_SENT_SQL} SELECT id, template, slots FROM t")
def slot_template(spark, d):
    return _slotted(spark, d).select("id", "template", F.size("slots").alias("slots"))


@query("template_hash", f"WITH {_SENT_SQL} SELECT id, sha256(regexp_replace(nfc_normalize(template), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS hash FROM t")
def template_hash(spark, d):
    return _slotted(spark, d).select("id", T.normalized_hash(F.col("template")).alias("hash"))


@query(
    "templateize",
    f"""WITH {_SENT_SQL} SELECT id, CASE WHEN slots = 1 THEN replace(translation, n1, '⟪PER1⟫') WHEN contains(replace(translation, CASE WHEN length(n1) > length(n2) THEN n1 ELSE n2 END, ''), CASE WHEN length(n1) > length(n2) THEN n2 ELSE n1 END) AND contains(translation, n1) AND contains(translation, n2)
    THEN replace(replace(translation, n1, '⟪PER2⟫'), n2, '⟪PER1⟫') END AS translation_template FROM t""",
)
def templateize(spark, d):
    return _slotted(spark, d).select("id", slots.translation_template(F.col("translation"), F.col("slots")).alias("translation_template"))


def _final_sql(n: str) -> str:
    return f"((unicode(right({n}, 1)) - 44032) % 28 <> 0)"


@query(
    "reinject",
    f"""WITH {_SENT_SQL} SELECT id, CASE WHEN slots = 2 THEN n2 || CASE WHEN {_final_sql('n2')} THEN '이' ELSE '가' END || ' ' || n1 || CASE WHEN {_final_sql('n1')} THEN '을' ELSE '를' END || ' 보았다. ' || n2 || CASE WHEN {_final_sql('n2')} THEN '이라' ELSE '라' END || ', ' || n1 || '이조' END AS filled FROM t""",
)
def reinject(spark, d):
    """A stored template filled with another sentence's names; two markers, so one-slot sentences don't fit."""
    template = F.lit("⟪PER1⟫가 ⟪PER2⟫를 보았다. ⟪PER1⟫이라, ⟪PER2⟫이조")
    return _slotted(spark, d).select("id", slots.reinject(template, F.col("slots")).alias("filled"))


@query(
    "particle_fix",
    f"""WITH {_SENT_SQL} SELECT id, n1 || CASE WHEN {_final_sql('n1')} THEN '은' ELSE '는' END || ' ' || n1 || CASE WHEN {_final_sql('n1')} THEN '과' ELSE '와' END || '/' || n1 || '가문' AS filled FROM t""",
)
def particle_fix(spark, d):
    name = _name(F.col("id"))
    return sentences(spark, d).select("id", slots.fill_slot(F.lit("⟪PER1⟫는 ⟪PER1⟫와/⟪PER1⟫가문"), F.lit("⟪PER1⟫"), name).alias("filled"))


_REFLECTED = "(contains(translation, {n}) OR (length({n}) >= 3 AND contains(translation, substr({n}, 2))))"
_GATE_SQL = f"""g AS (SELECT *, NOT {_REFLECTED.format(n='n1')} OR (size >= 20 AND NOT {_REFLECTED.format(n='n2')}) AS missing FROM t), v AS (SELECT *, CASE WHEN missing THEN 'REJECTED' WHEN size < 10 THEN 'DEGRADED' ELSE 'VERIFIED' END AS grade FROM g)"""


@query("quality_gate", f"WITH {_SENT_SQL}, {_GATE_SQL} SELECT id, grade, CASE WHEN size >= 20 AND NOT {_REFLECTED.format(n='n2')} THEN n2 ELSE '' END AS missing FROM v")
def quality_gate(spark, d):
    rows = sentences(spark, d).withColumn("g", slots.quality_grade(F.col("translation"), F.col("entities")))
    return rows.select("id", "g.grade", F.array_join("g.missing", ",").alias("missing"))


@query("gate_fp_rate", f"WITH {_SENT_SQL}, {_GATE_SQL} SELECT count(*) AS n, round(avg((grade = 'REJECTED')::INT), 6) AS rate FROM v WHERE size >= 20")
def gate_fp_rate(spark, d):
    rows = sentences(spark, d).filter("size >= 20").select(slots.quality_grade(F.col("translation"), F.col("entities"))["grade"].alias("grade"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("grade") == "REJECTED").cast("int")), 6).alias("rate"))


@query("aligned_grade", f"WITH {_SENT_SQL}, {_GATE_SQL} SELECT id, CASE WHEN grade = 'REJECTED' AND id % 2 = 0 THEN CASE WHEN size < 10 THEN 'DEGRADED' ELSE 'VERIFIED' END ELSE grade END AS grade FROM v")
def aligned_grade(spark, d):
    """A rejected row whose pair was found misaligned (here: even ids) is graded by its unknown persons alone."""
    g = slots.quality_grade(F.col("translation"), F.col("entities"))["grade"]
    miss = F.exists("entities", lambda e: e["link_stage"] == "MISS")
    fixed = F.when(miss, "DEGRADED").otherwise("VERIFIED")
    return sentences(spark, d).select("id", F.when((g == "REJECTED") & (F.col("id") % 2 == 0), fixed).otherwise(g).alias("grade"))


@query(
    "routing_signals",
    f"WITH {_SENT_SQL} SELECT id, 3 AS entities, 2 AS per, 1 AS loc, CASE WHEN size >= 20 THEN 2 ELSE 1 END AS confirmed, (size < 10)::INT AS kb_miss, (size >= 10 AND size < 20)::INT AS ambiguous FROM t",
)
def routing_signals(spark, d):
    rows = sentences(spark, d).withColumn("s", routing.signals(F.col("text"), F.col("entities")))
    return rows.select("id", "s.entities", "s.per", "s.loc", "s.confirmed", "s.kb_miss", "s.ambiguous")


@query(
    "tier_classify",
    f"""WITH {_SENT_SQL} SELECT id, CASE WHEN size >= 10 AND size < 20 THEN 'T2' ELSE 'T1' END AS tier, CASE WHEN size >= 10 AND size < 20 THEN 'ambiguous persons: 1' WHEN size < 10 THEN 'unknown persons: 1' ELSE 'confirmed persons: 2' END AS reason FROM t""",
)
def tier_classify(spark, d):
    rows = sentences(spark, d).withColumn("s", routing.signals(F.col("text"), F.col("entities")))
    return rows.select("id", routing.tier(F.col("s")).alias("tier"), routing.tier_reason(F.col("s")).alias("reason"))


def kb_block(entities: Column) -> Column:
    """A line for each person of the master: the name and first office, or all candidates of an ambiguous one."""
    line = lambda e: F.when(
        F.size(e["candidates"]) == 1,
        F.concat(F.lit("  · "), e["surface"], F.lit(" → "), e["candidates"][0]["name"], F.coalesce(F.concat(F.lit("  (관직: "), e["candidates"][0]["offices"][0], F.lit(")")), F.lit(""))),
    ).otherwise(
        F.concat(
            F.lit("  · "), e["surface"], F.lit(" → 동명이인 후보 중 문맥으로 판단: "),
            F.array_join(F.transform(e["candidates"], lambda c: F.concat(c["name"], F.coalesce(F.concat(F.lit("(활동 "), c["active_from"].cast("string"), F.lit("~")), F.lit("(")), F.coalesce(F.concat(F.lit(", "), c["offices"][0]), F.lit("")), F.lit(")"))), " / "),
        )
    )
    some = F.filter(entities, lambda e: F.size(e["candidates"]) > 0)
    return F.when(F.size(some) > 0, F.concat(F.lit("\n[등장 인물 한자→한글]\n"), F.array_join(F.transform(some, line), "\n"), F.lit("\n"))).otherwise("")


def _kb_rows(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    person = lambda name, year, office: F.struct(name.alias("name"), year.alias("active_from"), F.array(office).alias("offices"))
    first = person(_name(F.col("p_partkey")), F.col("p_size"), F.col("p_type"))
    second = person(_name(F.col("p_partkey") + 1), F.lit(None).cast("int"), F.col("p_brand"))
    cands = F.when(F.col("p_partkey") % 2 == 0, F.array(first)).otherwise(F.array(first, second))
    return p.select(F.col("p_partkey").alias("id"), "p_name", kb_block(F.array(F.struct(F.col("p_name").alias("surface"), cands.alias("candidates")))).alias("block"))


_BLOCK_SQL = f"""b AS (SELECT p_partkey AS id, p_name, chr(10) || '[등장 인물 한자→한글]' || chr(10) || '  · ' || p_name || ' → ' || CASE WHEN p_partkey % 2 = 0 THEN {_NAME_SQL}[p_partkey % 4 + 1] || '  (관직: ' || p_type || ')'
ELSE '동명이인 후보 중 문맥으로 판단: ' || {_NAME_SQL}[p_partkey % 4 + 1] || '(활동 ' || p_size || '~, ' || p_type || ') / ' || {_NAME_SQL}[(p_partkey + 1) % 4 + 1] || '(, ' || p_brand || ')' END || chr(10) AS block FROM part)"""


@query("kb_block", f"WITH {_BLOCK_SQL} SELECT id, block FROM b")
def kb_blocks(spark, d):
    return _kb_rows(spark, d).select("id", "block")


def render(template: str, **values: Column) -> Column:
    """A template's ``{name}`` slots filled with columns; every slot must be given."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


@query("prompt_render", f"WITH {_BLOCK_SQL} SELECT id, 'Use: x' || block || chr(10) || p_name || chr(10) || 'end' AS prompt FROM b")
def prompt_render(spark, d):
    return _kb_rows(spark, d).select("id", render("Use: {positive}{kb}\n{original}\nend", positive=F.lit("x"), kb=F.col("block"), original=F.col("p_name")).alias("prompt"))


@query("slot_extended", "SELECT p_partkey AS id, replace(replace(p_brand || ' met ' || p_name || ' at ' || p_type, p_name, '⟪PER1⟫'), p_type, '⟪LOC1⟫') AS template FROM part")
def slot_extended(spark, d):
    """Typed markers for persons and places: each kind is numbered on its own."""
    rows = sentences(spark, d).withColumn("text", F.regexp_replace("text", " with .*$", ""))
    person = F.filter("entities", lambda e: e["kb_id"] == F.col("id").cast("string"))
    place = F.filter("entities", lambda e: e["type"] == "LOC")
    filled = F.aggregate(F.transform(person, lambda e, i: F.struct(e["surface"].alias("s"), F.concat(F.lit("⟪PER"), (i + 1).cast("string"), F.lit("⟫")).alias("m"))), F.col("text"), lambda a, x: F.replace(a, x["s"], x["m"]))
    both = F.aggregate(F.transform(place, lambda e, i: F.struct(e["surface"].alias("s"), F.concat(F.lit("⟪LOC"), (i + 1).cast("string"), F.lit("⟫")).alias("m"))), filled, lambda a, x: F.replace(a, x["s"], x["m"]))
    return rows.select("id", both.alias("template"))


def fake_translate(text: Column, entities: Column, drop_first: bool = False) -> Column:
    """Deterministic stand-in for a model: surfaces become names in the entities' order, optionally all but the first."""
    known = F.filter(entities, lambda e: F.coalesce(e["resolved_name"], F.lit("")) != "")
    return F.aggregate(F.slice(known, F.lit(2), F.size(known)) if drop_first else known, text, lambda a, e: F.replace(a, e["surface"], e["resolved_name"]))


@query("fake_translate", f"WITH {_SENT_SQL} SELECT id, CASE WHEN size >= 20 THEN replace(replace(text, p_name, n1), p_brand, n2) ELSE replace(text, p_name, n1) END AS whole, CASE WHEN size >= 20 THEN replace(text, p_brand, n2) ELSE text END AS dropped FROM t")
def fake_translations(spark, d):
    t, e = F.col("text"), F.col("entities")
    return sentences(spark, d).select("id", fake_translate(t, e).alias("whole"), fake_translate(t, e, True).alias("dropped"))


# --- cache replay ---------------------------------------------------------------------------------------------------


def replay(items: DataFrame) -> DataFrame:
    """items (pos, l1_key, template_hash, grade, stores) -> their rows with ``outcome``: L1, L2 or LLM, as a sequential replay gives.

    Closed form, no ordered pass. a: a key's first admissible position; without the second level a row hits iff pos > a.
    p: a template's first position that calls the model, is verified and stores a template; from there on no row of
    the template calls the model, so a later row hits the first level iff a <= p, else the second. Holds where a key
    has one template; minima per key and template are combined before the shuffle, so hot keys do no harm.
    """
    keys = items.groupBy("l1_key").agg(F.min(F.when(F.col("grade") != "REJECTED", F.col("pos"))).alias("a"))
    rows = items.join(keys, "l1_key")
    hit = F.coalesce(F.col("pos") > F.col("a"), F.lit(False))
    stored = rows.filter(F.col("template_hash").isNotNull() & ~hit & F.col("stores") & (F.col("grade") == "VERIFIED")).groupBy("template_hash").agg(F.min("pos").alias("p"))
    out = rows.join(stored, "template_hash", "left")
    late = F.coalesce(F.col("pos") > F.col("p"), F.lit(False))
    outcome = F.when(late & F.coalesce(F.col("a") <= F.col("p"), F.lit(False)), "L1").when(late, "L2").when(hit, "L1").otherwise("LLM")
    return out.withColumn("outcome", outcome).drop("a", "p")


def cache_items(spark, d) -> DataFrame:
    docs = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    grade = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 0, "DEGRADED").otherwise("VERIFIED")
    masked = F.md5(F.regexp_replace("text", "[0-9A-Z]+", "#"))
    return docs.select(F.col("doc_id").alias("pos"), F.md5("text").alias("l1_key"), F.when(F.length("text") % 2 == 0, masked).alias("template_hash"), grade.alias("grade"), (F.col("doc_id") % 5 != 0).alias("stores"))


_ITEMS_SQL = f"""items AS (SELECT doc_id AS pos, md5(text) AS k, CASE WHEN length(text) % 2 = 0 THEN md5(regexp_replace(text, '[0-9A-Z]+', '#', 'g')) END AS th, coalesce({GRADE_SQL}, 'VERIFIED') AS grade, doc_id % 5 <> 0 AS stores FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, min(pos) FILTER (grade <> 'REJECTED') OVER (PARTITION BY k) AS a FROM items), r1 AS (SELECT *, coalesce(pos > a, false) AS hit FROM r),
r2 AS (SELECT *, min(pos) FILTER (th IS NOT NULL AND NOT hit AND stores AND grade = 'VERIFIED') OVER (PARTITION BY th) AS p0 FROM r1), r3 AS (SELECT *, CASE WHEN th IS NOT NULL THEN p0 END AS p FROM r2),
o AS (SELECT *, CASE WHEN coalesce(pos > p, false) AND coalesce(a <= p, false) THEN 'L1' WHEN coalesce(pos > p, false) THEN 'L2' WHEN hit THEN 'L1' ELSE 'LLM' END AS outcome FROM r3)"""


@query("l1_replay", f"WITH {_ITEMS_SQL} SELECT pos, hit FROM o")
def l1_replay(spark, d):
    items = cache_items(spark, d)
    keys = items.groupBy("l1_key").agg(F.min(F.when(F.col("grade") != "REJECTED", F.col("pos"))).alias("a"))
    return items.join(keys, "l1_key").select("pos", F.coalesce(F.col("pos") > F.col("a"), F.lit(False)).alias("hit"))


@query("cache_replay", f"WITH {_ITEMS_SQL} SELECT outcome, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM o GROUP BY outcome")
def cache_replay(spark, d):
    counts = replay(cache_items(spark, d)).groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / load(spark, d, "documents").count(), 4))


@query("replay_cost", f"WITH {_ITEMS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'LLM') AS calls, count(*) FILTER (NOT hit) AS l1_calls FROM o) SELECT n, l1_calls, calls, round(n * 0.5::DOUBLE, 4) AS off_krw, round(calls * 0.5::DOUBLE, 4) AS on_krw FROM c")
def replay_cost(spark, d):
    """Calls and cost without a cache, with the first level and with both, at half a won a call."""
    both = replay(cache_items(spark, d)).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "LLM").alias("calls"))
    first = l1_replay(spark, d).agg(F.count_if(~F.col("hit")).alias("l1_calls"))
    return both.join(F.broadcast(first)).select("n", "l1_calls", "calls", F.round(F.col("n") * 0.5, 4).alias("off_krw"), F.round(F.col("calls") * 0.5, 4).alias("on_krw"))

"""Queries over sources that are written first, chosen by name, or looked up again: rule files, strict lines, modes, examples and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.shipping import ship
from loomline.plans.registry import load, query
from loomline.sources import readers, sinks

from .cache import click_items
from .extras import repair_name
from .joins import MENTIONS_SQL, counted_stages, mentions
from .replay import replay

# --- files


@query("strict_lines", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def strict_lines(spark, d):
    """Lines of JSON with blank ones between them, read so that a broken line would be an error."""
    path = sinks.scratch(spark, "strict")
    s = load(spark, d, "supplier")
    lines = s.select(F.explode(F.array(F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal")), F.lit(""))).alias("value"))
    lines.write.text(path)
    return readers.json_lines(spark, path, "s_suppkey long, s_name string, s_acctbal double", strict=True)


@query("xml_fallback_file", "SELECT n_nationkey AS id, n_name AS translation FROM nation")
def xml_fallback_file(spark, d):
    """Files that don't parse, one a region: contents of the tag by pattern."""
    path = sinks.scratch(spark, "markup")
    n = load(spark, d, "nation").select("n_regionkey", F.concat(F.lit("<article><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><translation>"), "n_name", F.lit("</translation><never closed>")).alias("value"))
    n.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = readers.xml_fallback(spark, path, "translation").withColumnRenamed("translation", "n_name")
    return found.join(load(spark, d, "nation"), "n_name").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("translation"))


def first_rule(rows: DataFrame, text: Column, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` with the name of the first rule (place, pattern, name), in file order, whose pattern the text has; null without one.

    Rules travel with each row's test as one array, so there may be ``most`` at most; more are an error.
    """
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("place", "pattern", "name"))).alias("_rules"))
    checked = listed.select(F.when(F.size("_rules") <= most, F.col("_rules")).otherwise(F.raise_error(F.lit(f"more than {most} rules"))).alias("_rules"))
    hit = F.filter("_rules", lambda r: text.contains(r["pattern"]))
    return rows.join(F.broadcast(checked)).withColumn("rule", F.try_element_at(hit, F.lit(1))["name"]).drop("_rules")


@query(
    "rule_file",
    """WITH r AS (SELECT n_nationkey AS place, lower(substr(n_name, 1, 3)) AS pattern, n_name AS name FROM nation)
    SELECT doc_id, arg_min(name, place) AS rule FROM documents LEFT JOIN r ON contains(text, pattern) GROUP BY doc_id""",
)
def rule_file(spark, d):
    """A table of rules with comments and blank lines is written, read in file order, and applied to whole texts."""
    path = sinks.scratch(spark, "rules")
    lines = load(spark, d, "nation").select("n_nationkey", F.concat_ws("\t", F.lower(F.substring("n_name", 1, 3)), "n_name").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n# next\n\n")
    lines.agg(F.concat(F.lit("# pattern\tname\n"), body).alias("value")).write.text(path)
    rules = readers.rule_rows(spark, path).select("place", F.col("fields")[0].alias("pattern"), F.col("fields")[1].alias("name"))
    return first_rule(load(spark, d, "documents").select("doc_id", "text"), F.col("text"), rules).select("doc_id", "rule")


@query("chosen_sources", f"WITH {MENTIONS_SQL} SELECT 'file' AS mode, stage, count(*) AS n FROM linked GROUP BY stage UNION ALL SELECT 'noop', 'MISS', count(*) FROM mentions")
def chosen_sources(spark, d):
    """The same mentions with the knowledge source that each configured mode names: the file, or none, which finds nobody."""
    modes = {"file": lambda: counted_stages(spark, d), "noop": lambda: mentions(spark, d).agg(F.lit("MISS").alias("stage"), F.count("*").alias("n"))}
    parts = [readers.choose(m, modes)().select(F.lit(m).alias("mode"), "stage", "n") for m in ("file", "noop")]
    return parts[0].unionByName(parts[1])


# --- repair of names


#: Syllables of which names and their wrong readings are made here.
SYLLABLES = "강선수무이원익정문회김류"
_SYL = lambda k: F.substring(F.lit(SYLLABLES), (k % len(SYLLABLES) + 1).cast("int"), F.lit(1))
_SYL_SQL = f"substr('{SYLLABLES}', ({{}} % {len(SYLLABLES)} + 1)::INT, 1)"


@query(
    "name_repair_varied",
    f"""WITH s AS (SELECT p_partkey AS id, {_SYL_SQL.format("p_partkey")} AS a, {_SYL_SQL.format("p_partkey // 12")} AS b, {_SYL_SQL.format("p_size")} AS x, {_SYL_SQL.format("p_size // 7 + 3")} AS y, p_size, p_name FROM part),
    t AS (SELECT id, a || b AS name, p_name || ' ' || a || x || ' met' || CASE WHEN p_size % 3 > 0 THEN ' ' || a || y || '.' ELSE '' END AS text, CASE WHEN p_size % 3 = 2 THEN a || y END AS reading, a FROM s),
    f AS (SELECT *, regexp_extract_all(text, a || '[가-힣]') AS found FROM t)
    SELECT id, CASE WHEN contains(text, name) THEN text WHEN len(found) = 1 THEN replace(text, found[1], name) WHEN reading IS NOT NULL AND list_contains(found, reading) THEN
      substr(text, 1, instr(text, reading) - 1) || name || substr(text, instr(text, reading) + 2) ELSE text END AS fixed FROM f""",
)
def name_repair_varied(spark, d):
    """A part's text with one or two readings of a name that differs from part to part: the only one, or the one that equals the reading, is put right."""
    ship(spark)
    p = load(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    a, b, x, y = _SYL(k), _SYL(F.floor(k / 12)), _SYL(size), _SYL(F.floor(size / 7) + 3)
    text = F.concat("p_name", F.lit(" "), a, x, F.lit(" met"), F.when(size % 3 > 0, F.concat(F.lit(" "), a, y, F.lit("."))).otherwise(""))
    return p.select(k.alias("id"), repair_name(text, F.concat(a, b), F.when(size % 3 == 2, F.concat(a, y))).alias("fixed"))


# --- hits and the rows that stored them


_CLICK_ITEMS_SQL = """items AS (SELECT row_number() OVER (ORDER BY ts NULLS FIRST, click_id NULLS FIRST, props NULLS FIRST, kind NULLS FIRST, value NULLS FIRST) - 1 AS pos, md5(coalesce(props, '')) AS k, CASE WHEN regexp_replace(props, '[0-9]+', '#', 'g') <> props THEN md5(regexp_replace(props, '[0-9]+', '#', 'g')) END AS th,
CASE WHEN coalesce(value, 0) < 5 THEN 'REJECTED' WHEN value < 20 THEN 'DEGRADED' ELSE 'VERIFIED' END AS grade, kind <> 'error' AS stores FROM clicks),
r1 AS (SELECT *, coalesce(pos > min(pos) FILTER (grade <> 'REJECTED') OVER (PARTITION BY k), false) AS hit, min(pos) FILTER (grade <> 'REJECTED') OVER (PARTITION BY k) AS a FROM items),
r2 AS (SELECT *, CASE WHEN th IS NOT NULL THEN min(pos) FILTER (th IS NOT NULL AND NOT hit AND stores AND grade = 'VERIFIED') OVER (PARTITION BY th) END AS p FROM r1)"""


@query("storer_pairs", f"WITH {_CLICK_ITEMS_SQL} SELECT h.p AS stored_by, h.pos FROM r2 h JOIN items s ON s.pos = h.p WHERE h.pos > h.p AND NOT coalesce(h.a <= h.p, false) AND h.grade <> 'DEGRADED' AND s.grade <> 'DEGRADED'")
def storer_pairs(spark, d):
    """Clicks that hit the second level with the click that stored their template, where neither is degraded."""
    out = replay(click_items(spark, d))
    hits = out.filter("outcome = 'L2' and grade <> 'DEGRADED'").select("template_hash", "pos")
    first = out.filter("outcome = 'LLM' and grade = 'VERIFIED' and stores and template_hash is not null").groupBy("template_hash").agg(F.min("pos").alias("stored_by"))
    return hits.join(first, "template_hash").select("stored_by", "pos")


# --- examples for a prompt


def select_examples(queries: DataFrame, pool: DataFrame, n: int = 5, most: int = 500, seed: str = "0") -> DataFrame:
    """(q, place, doc_id, step) for queries (q, pat, len) from a pool (rank, doc_id, pat, len) of at most ``most`` rows; more are an error.

    Step 0: the example of the query's pattern nearest in length, the first of the pool if none has it. Step 1: the first of each
    other pattern, in the order of the patterns. Step 2: examples of other patterns in an order shuffled by seed and query, until there
    are ``n``. The pool is one small row, so no task holds more than it.
    """
    listed = pool.agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col("pat").alias("p"), F.col("len").alias("l")))).alias("_pool"))
    checked = listed.select(F.when(F.size("_pool") <= most, F.col("_pool")).otherwise(F.raise_error(F.lit(f"more than {most} examples"))).alias("_pool"))
    rows = queries.join(F.broadcast(checked)).filter(F.size("_pool") > 0)
    near = F.transform(F.filter("_pool", lambda e: e["p"] == F.col("pat")), lambda e: F.struct(F.abs(e["l"] - F.col("len")).alias("far"), e["rank"].alias("rank"), e.alias("e")))
    rows = rows.withColumn("_anchor", F.coalesce(F.try_element_at(F.array_sort(near), F.lit(1))["e"], F.element_at("_pool", 1)))
    rows = rows.withColumn("_others", F.filter("_pool", lambda e: (e["rank"] != F.col("_anchor.rank")) & (e["p"] != F.col("pat"))))
    first = lambda p: F.try_element_at(F.filter("_others", lambda e: e["p"] == p), F.lit(1))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("_others", lambda e: e["p"]), lambda p: p != F.col("_anchor.p"))))
    rows = rows.withColumn("_kinds", F.slice(F.transform(kinds, first), 1, n - 1))
    used = F.transform("_kinds", lambda e: e["rank"])
    rest = F.transform(F.filter("_others", lambda e: ~F.array_contains(used, e["rank"])), lambda e: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("q").cast("string"), e["doc_id"].cast("string"))).alias("shuffled"), e["rank"].alias("rank"), e.alias("e")))
    rows = rows.withColumn("_fill", F.slice(F.array_sort(rest), F.lit(1), F.lit(n - 1) - F.size("_kinds")))
    chosen = lambda e, step: F.struct(e["doc_id"].alias("doc_id"), F.lit(step).alias("step"))
    final = F.concat(F.array(chosen(F.col("_anchor"), 0)), F.transform("_kinds", lambda e: chosen(e, 1)), F.transform("_fill", lambda e: chosen(e["e"], 2)))
    return rows.select("q", F.posexplode(final).alias("place", "e")).select("q", "place", "e.doc_id", "e.step")


@query(
    "fewshot_fill",
    """WITH d AS (SELECT doc_id, lang AS pat, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS len, n_chars FROM documents WHERE lang IS NOT NULL), pool AS (SELECT doc_id, pat, len, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM d QUALIFY rank <= 500),
    q AS (SELECT doc_id AS q, pat AS qpat, len AS qlen FROM d WHERE doc_id % 50 = 0),
    anchor AS (SELECT q, qpat, doc_id, rank FROM q JOIN pool ON true QUALIFY row_number() OVER (PARTITION BY q ORDER BY pat <> qpat, CASE WHEN pat = qpat THEN abs(len - qlen) END, rank) = 1),
    other AS (SELECT a.q, p.doc_id, p.rank, p.pat, a.rank AS arank, row_number() OVER (PARTITION BY a.q, p.pat ORDER BY p.rank) AS k, (SELECT pat FROM pool x WHERE x.rank = a.rank) AS apat FROM anchor a JOIN pool p ON p.pat <> a.qpat AND p.rank <> a.rank),
    kinds AS (SELECT q, doc_id, rank, row_number() OVER (PARTITION BY q ORDER BY pat) AS place FROM other WHERE k = 1 AND pat <> apat QUALIFY place <= 4), n AS (SELECT q, count(*) AS n FROM kinds GROUP BY q),
    fill AS (SELECT o.q, o.doc_id, coalesce(n, 0) + row_number() OVER (PARTITION BY o.q ORDER BY md5('0:' || o.q || ':' || o.doc_id), o.rank) AS place FROM other o LEFT JOIN n USING (q) WHERE (o.q, o.rank) NOT IN (SELECT (q, rank) FROM kinds) QUALIFY place <= 4)
    SELECT q, 0 AS place, doc_id, 0 AS step FROM anchor UNION ALL SELECT q, place::INT, doc_id, 1 FROM kinds UNION ALL SELECT q, place::INT, doc_id, 2 FROM fill""",
)
def fewshot_fill(spark, d):
    """Five examples for every fiftieth document from the 500 longest, patterns being languages."""
    size = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    docs = load(spark, d, "documents").filter("lang is not null").select("doc_id", F.col("lang").alias("pat"), size.alias("len"), "n_chars")
    pool = docs.orderBy(F.desc("n_chars"), "doc_id").limit(500).select(F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("rank"), "doc_id", "pat", "len")
    return select_examples(docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("q"), "pat", "len"), pool)

"""Reports in full: what moved between two runs, how features interact, examples of patterns, tags with the documents that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import metrics as M
from loomline.functions import morphemes
from loomline.functions import text as T
from loomline.functions.shipping import bound_batches, ship
from loomline.plans.registry import load, query
from loomline.sources import readers

from .aggregates import ARTICLE_PATTERNS
from .scoring import pairs

# --- movers


def movers_report(rows: DataFrame, key: str, band: float = 0.5, shown: int = 5, tail: int = 10) -> DataFrame:
    """(metric, place, id, value, name) of ``rows`` (``key``, delta, missing_a, missing_b): what a run B changed against A.

    Sums and bands, the sum of the ``tail`` worst and its share of a total loss, the ``shown`` worst and best with their ids, and
    each name missing in B only (lost) or in A only (gained). Few rows are ranked: each task sends its own extremes.
    """
    none = F.lit(None)
    one = rows.agg(
        F.count("*").cast("double").alias("pairs"), F.round(F.sum("delta"), 4).alias("total"), F.round(F.avg("delta"), 4).alias("mean"),
        F.count_if(F.col("delta") < -band).cast("double").alias("worse"), F.count_if(F.col("delta") > band).cast("double").alias("better"), F.count_if(F.abs("delta") <= band).cast("double").alias("rest"),
    )
    worst = rows.orderBy("delta", key).limit(tail).select("delta", F.col(key).alias("id"))
    best = rows.orderBy(F.desc("delta"), key).limit(shown).select("delta", F.col(key).alias("id"))
    low = worst.agg(F.round(F.sum("delta"), 4).alias("tail"))
    facts = one.join(F.broadcast(low)).withColumn("share", F.when(F.col("total") < 0, F.round(100 * F.col("tail") / F.col("total"), 2)))
    names = ["pairs", "total", "mean", "worse", "better", "rest", "tail", "share"]
    flat = facts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))).select("metric", none.cast("int").alias("place"), none.cast("long").alias("id"), "value", none.cast("string").alias("name"))
    ranked = lambda t, label, order: t.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") <= shown).select(F.lit(label).alias("metric"), "place", "id", F.col("delta").alias("value"), none.cast("string").alias("name"))
    moved = lambda label, here, there: rows.select(F.lit(label).alias("metric"), none.cast("int").alias("place"), F.col(key).alias("id"), none.cast("double").alias("value"), F.explode(F.array_except(here, there)).alias("name"))
    return flat.unionByName(ranked(worst, "worst", ["delta", "id"])).unionByName(ranked(best, "best", [F.desc("delta"), F.col("id")])).unionByName(moved("lost", "missing_b", "missing_a")).unionByName(moved("gained", "missing_a", "missing_b"))


_RUNS_SQL = """p AS (SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS va, round(avg(value) FILTER (event_type = 'click'), 6) AS vb,
list(DISTINCT 'n' || CAST(floor(value / 10) AS INT)) FILTER (event_type = 'view' AND value < 30) AS ma, list(DISTINCT 'n' || CAST(floor(value / 10) AS INT)) FILTER (event_type = 'click' AND value < 30) AS mb FROM events GROUP BY 1),
m AS (SELECT user_id, round(vb - va, 6) AS delta, coalesce(ma, []) AS ma, coalesce(mb, []) AS mb FROM p WHERE va IS NOT NULL AND vb IS NOT NULL)"""


@query(
    "movers_report",
    f"""WITH {_RUNS_SQL}, w AS (SELECT *, row_number() OVER (ORDER BY delta, user_id) AS lo, row_number() OVER (ORDER BY delta DESC, user_id) AS hi FROM m),
    t AS (SELECT count(*)::DOUBLE AS pairs, round(sum(delta), 4) AS total, round(avg(delta), 4) AS mean, count(*) FILTER (delta < -0.5)::DOUBLE AS worse, count(*) FILTER (delta > 0.5)::DOUBLE AS better, count(*) FILTER (abs(delta) <= 0.5)::DOUBLE AS rest,
      round(sum(delta) FILTER (lo <= 10), 4) AS tail FROM w), f AS (SELECT *, CASE WHEN total < 0 THEN round(100 * tail / total, 2) END AS share FROM t)
    SELECT unnest(['pairs', 'total', 'mean', 'worse', 'better', 'rest', 'tail', 'share']) AS metric, NULL::INT AS place, NULL::BIGINT AS id, unnest([pairs, total, mean, worse, better, rest, tail, share]) AS value, NULL::VARCHAR AS name FROM f
    UNION ALL SELECT 'worst', lo, user_id, delta, NULL FROM w WHERE lo <= 5 UNION ALL SELECT 'best', hi, user_id, delta, NULL FROM w WHERE hi <= 5
    UNION ALL SELECT 'lost', NULL, user_id, NULL, unnest(list_filter(mb, lambda n: NOT list_contains(ma, n))) FROM m UNION ALL SELECT 'gained', NULL, user_id, NULL, unnest(list_filter(ma, lambda n: NOT list_contains(mb, n))) FROM m""",
)
def movers(spark, d):
    """Users' clicks against their views: the mean value of each is the score, values under 30 name what is missing."""
    e = load(spark, d, "events")
    of = lambda kind: F.col("event_type") == kind
    missing = lambda kind: F.collect_set(F.when(of(kind) & (F.col("value") < 30), F.concat(F.lit("n"), F.floor(F.col("value") / 10).cast("string"))))
    rows = e.groupBy("user_id").agg(F.round(F.avg(F.when(of("view"), F.col("value"))), 6).alias("va"), F.round(F.avg(F.when(of("click"), F.col("value"))), 6).alias("vb"), missing("view").alias("missing_a"), missing("click").alias("missing_b"))
    return movers_report(rows.withColumn("delta", F.round(F.col("vb") - F.col("va"), 6)).filter("delta is not null"), "user_id")


# --- interaction of features


def interaction(rows: DataFrame, features: list[str], gamma: float = 0.5, bins: int = 10) -> DataFrame:
    """(i, j, m) for each two features: -|correlation| + gamma * (importance of j - importance of i), importance being the entropy over equal bins, scaled to 0..1.

    Two passes, each to one small row: extremes and correlations, then counts by bin.
    """
    pairs_ = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    span = rows.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features], *[F.corr(a, b).alias(f"c_{a}_{b}") for a, b in pairs_])
    width = lambda f: (F.col(f"hi_{f}") - F.col(f"lo_{f}")) / bins
    placed = rows.join(F.broadcast(span)).select(F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.when(width(f) > 0, F.least(F.floor((F.col(f) - F.col(f"lo_{f}")) / width(f)), F.lit(bins - 1))).otherwise(F.lit(bins // 2)).alias("bin")) for f in features])))
    counts = placed.groupBy("f", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("f").agg(F.sum("n").alias("all"))
    share = F.col("n") / (F.col("all") + 1e-8)
    entropy = counts.join(F.broadcast(totals), "f").groupBy("f").agg((-F.sum(share * F.log(share + 1e-8))).alias("h"))
    ends = entropy.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    scaled = entropy.join(F.broadcast(ends)).select("f", ((F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("imp"))
    both = span.select(F.inline(F.array(*[F.struct(F.lit(x).alias("i"), F.lit(y).alias("j"), F.abs(F.col(f"c_{a}_{b}")).alias("c")) for a, b in pairs_ for x, y in ((a, b), (b, a))])))
    at = lambda side: scaled.select(F.col("f").alias(side), F.col("imp").alias(f"imp_{side}"))
    m = both.join(F.broadcast(at("i")), "i").join(F.broadcast(at("j")), "j")
    return m.select("i", "j", F.round(-F.col("c") + gamma * (F.col("imp_j") - F.col("imp_i")), 6).alias("m"))


_FEATURES = ["commas", "dots", "len", "lines"]
_FEATURES_SQL = "f AS (SELECT least(length(text) / 350.0, 1.0)::DOUBLE AS len, len(regexp_extract_all(text, '\\.')) / length(text) AS dots, len(regexp_extract_all(text, ',')) / length(text) AS commas, least(len(regexp_extract_all(text, chr(10))) / 20.0, 1.0)::DOUBLE AS lines FROM documents WHERE text <> '')"
_INTERACTION_SQL = (
    f"WITH {_FEATURES_SQL}, e AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS f, -sum(n / (t + 1e-8) * ln(n / (t + 1e-8) + 1e-8)) AS h FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT least(floor(({f} - lo) / ((hi - lo) / 10)), 9) AS bin FROM f, (SELECT min({f}) AS lo, max({f}) AS hi FROM f)) GROUP BY bin)" for f in _FEATURES)
    + "), s AS (SELECT f, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER () + 1e-8) AS imp FROM e), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, abs(corr({a}, {b})) AS c FROM f" for a in _FEATURES for b in _FEATURES if a != b)
    + ") SELECT i, j, round(-c + 0.5 * (b.imp - a.imp), 6) AS m FROM c JOIN s a ON a.f = i JOIN s b ON b.f = j"
)


@query("feature_interaction", _INTERACTION_SQL)
def feature_interaction(spark, d):
    text, n = F.col("text"), F.length("text")
    per = lambda p: F.regexp_count(text, F.lit(p))
    rows = load(spark, d, "documents").filter("text <> ''").select(F.least(n / F.lit(350.0), F.lit(1.0)).alias("len"), (per(r"\.") / n).alias("dots"), (per(",") / n).alias("commas"), F.least(per("\n") / F.lit(20.0), F.lit(1.0)).alias("lines"))
    return interaction(rows, _FEATURES)


# --- patterns and tags


def pattern_examples(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str]], shown: int = 5) -> DataFrame:
    """(name, articles, place, example): the articles in which a pattern occurs, each counted once, and its first distinct examples in order of ``key``.

    An example is the snippet around an article's first match. A task ranks its own first ones only; which are distinct is
    decided by a minimum per example.
    """
    hits = docs.select(key, F.explode(F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(n).alias("name"), T.snippet(F.col(text), p).alias("example"))) for n, p in rules]))).alias("h")).select(key, "h.*")
    per = hits.groupBy("name", "example").agg(F.count("*").alias("n"), F.min(key).alias("first")).withColumn("usable", F.coalesce(F.col("example") != "", F.lit(False)))
    counts = per.groupBy("name").agg(F.sum("n").alias("articles"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("first", "example"))
    firsts = per.filter("usable").withColumn("place", place).filter(F.col("place") <= shown)
    return counts.join(firsts.select("name", "place", "example"), "name", "left").select("name", "articles", "place", "example")


_SNIPPET_SQL = "CASE WHEN length(line) > 100 THEN substr(line, 1, 100) || '…' ELSE line END"
_EXAMPLES_SQL = (
    "WITH x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, doc_id, text, instr(text, regexp_extract(text, '{p}')) AS p FROM documents WHERE regexp_matches(text, '{p}')" for n, p in ARTICLE_PATTERNS)
    + f"""), w AS (SELECT *, greatest(p - 15, 1) AS st FROM x), y AS (SELECT *, substr(text, st, p - st) || split_part(substr(substr(text, st, p - st + 80), p - st + 1), chr(10), 1) AS line FROM w),
    e AS (SELECT name, {_SNIPPET_SQL} AS example, min(doc_id) AS first FROM y GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first, example) AS place FROM e WHERE example <> ''),
    c AS (SELECT name, count(*) AS articles FROM x GROUP BY 1) SELECT c.name, articles, place::INT AS place, example FROM c LEFT JOIN r ON r.name = c.name AND place <= 5"""
)


@query("pattern_examples", _EXAMPLES_SQL)
def patterns_with_examples(spark, d):
    return pattern_examples(load(spark, d, "documents"), "doc_id", "text", ARTICLE_PATTERNS)


#: Endings whose words are ranked.
ENDINGS = ["ing", "ent", "ion", "ain"]


@query(
    "endings_top",
    "WITH w AS (" + " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{2,5}}{e}')) AS w FROM documents" for e in ENDINGS) + ") SELECT w, count(*) AS n FROM w GROUP BY w HAVING count(*) >= 30 ORDER BY n DESC, w LIMIT 200",
)
def endings_top(spark, d):
    """The 200 most frequent words of the patterns, of those that occur 30 times or more; a word that two patterns find counts for both."""
    found = F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{2,5}}{e}"), F.lit(0)) for e in ENDINGS])
    counts = load(spark, d, "documents").select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.filter("n >= 30").orderBy(F.desc("n"), "w").limit(200)


def tag_report(docs: DataFrame, tags: str, k: int = 20) -> DataFrame:
    """(tag, n, place, word, times, empty_pct) of ``docs`` with a column of (tag, word) structs: a tag's total, its k most frequent words, and the share of documents without any tag."""
    empty = docs.agg(F.round(100 * F.count_if(F.size(tags) == 0) / F.count("*"), 4).alias("empty_pct"))
    counts = docs.select(F.explode(tags).alias("t")).groupBy("t.tag", "t.word").agg(F.count("*").alias("times"))
    totals = counts.groupBy("tag").agg(F.sum("times").alias("n"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("times"), "word"))
    top = counts.withColumn("place", place).filter(F.col("place") <= k)
    return top.join(totals, "tag").join(F.broadcast(empty)).select("tag", "n", "place", "word", "times", "empty_pct")


@query(
    "tag_report",
    """WITH t AS (SELECT l_orderkey, l_returnflag AS tag, p_name AS word FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' AND l_discount > 0.05),
    z AS (SELECT round(100 * count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM t)) / count(*), 4) AS empty_pct FROM orders), c AS (SELECT tag, word, count(*) AS times FROM t GROUP BY ALL)
    SELECT tag, sum(times) OVER (PARTITION BY tag)::BIGINT AS n, row_number() OVER (PARTITION BY tag ORDER BY times DESC, word)::INT AS place, word, times, empty_pct FROM c, z QUALIFY place <= 20""",
)
def tags(spark, d):
    """An order's lines that came back at a discount as its tagged words."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("word"))
    lines = load(spark, d, "lineitem").filter("l_returnflag <> 'N' and l_discount > 0.05").join(part, "l_partkey")
    per = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("tag"), "word")).alias("tags"))
    orders = load(spark, d, "orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return tag_report(orders.select("o_orderkey", F.coalesce("tags", F.array().cast("array<struct<tag:string,word:string>>")).alias("tags")), "tags")


# --- spans of a class, word features, morphemes


@query(
    "class_spans",
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:div|p|a|nav|footer)[^>]*class="[^"]*"') AS opened FROM pages), s AS (SELECT page_id, unnest(opened) AS tag, generate_subscripts(opened, 1) - 1 AS pos FROM p)
    SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(tag, 'class="([^"]*)"', 1) AS class FROM s""",
)
def class_spans(spark, d):
    """The classes of a page's elements, in order: the page's structure that a class-bound reader goes by."""
    tags_ = F.regexp_extract_all("html", F.lit(r'(?s)<(?:div|p|a|nav|footer)[^>]*class="[^"]*"'), F.lit(0))
    rows = load(spark, d, "pages").select("page_id", F.posexplode(tags_).alias("pos", "tag"))
    return rows.select("page_id", "pos", F.regexp_extract("tag", 'class="([^"]*)"', 1).alias("class"))


@query(
    "index_spans",
    """WITH p AS (SELECT page_id, regexp_extract_all('<span class="idx_person">' || coalesce(regexp_extract(url, '://([^/]*)', 1), '') || '</span> <span class="x">no</span> <span id="k" class="a idx_person b">' || page_id || '</span>' || html, '(?s)<span[^>]*class="[^"]*\\bidx_person\\b[^"]*"[^>]*>(.*?)</span>', 1) AS found FROM pages)
    SELECT page_id, unnest(found) AS span, CAST(generate_subscripts(found, 1) - 1 AS INT) AS pos FROM p""",
)
def index_spans(spark, d):
    """Whole pages with their host and number set before them as indexed spans: those of the class are read, in order, others not."""
    host = F.coalesce(F.regexp_extract("url", "://([^/]*)", 1), F.lit(""))
    marked = F.concat(F.lit('<span class="idx_person">'), host, F.lit('</span> <span class="x">no</span> <span id="k" class="a idx_person b">'), F.col("page_id").cast("string"), F.lit("</span>"), "html")
    return readers.html_spans(load(spark, d, "pages").select("page_id", marked.alias("html")), "page_id", "html", "idx_person")


def entity_features(words: Column, kinds: Column, most: float = 40.0) -> list[Column]:
    """Seven features of a text's words and its entities' types: length, density and variety of entities, shares of persons, places or groups, and dates, and richness of words."""
    n, e = F.size(words), F.size(kinds)
    share = lambda *which: F.when(e > 0, F.size(F.filter(kinds, lambda k: k.isin(*which))) / e).otherwise(0.0)
    bare = F.transform(words, lambda x: F.lower(F.rtrim(F.ltrim(x, F.lit(".,!?;:")), F.lit(".,!?;:"))))
    return [
        F.round(F.least(n / F.lit(most), F.lit(1.0)), 6).alias("length_norm"), F.round(F.least(e / F.greatest(n, F.lit(1)), F.lit(1.0)), 6).alias("density"), F.round(F.when(e > 0, F.size(F.array_distinct(kinds)) / e).otherwise(0.0), 6).alias("type_diversity"),
        F.round(share("PER"), 6).alias("per_ratio"), F.round(share("LOC", "ORG"), 6).alias("org_loc_ratio"), F.round(share("DAT"), 6).alias("date_ratio"), F.round(F.size(F.array_distinct(bare)) / F.greatest(n, F.lit(1)), 6).alias("richness"),
    ]


#: Patterns that stand for a recogniser here, a type each.
KIND_PATTERNS = [("PER", "[A-Z][a-z]{6,}"), ("LOC", "[A-Z][a-z]{3}[^a-z]"), ("ORG", "[A-Z]{3,}"), ("DAT", "[0-9]{2,}")]
_KINDS_SQL = " || ".join(f"list_transform(regexp_extract_all(text, '{p}'), lambda x: '{k}')" for k, p in KIND_PATTERNS)


@query(
    "entity_features",
    f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w, {_KINDS_SQL} AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT *, len(w) AS n, len(k) AS e FROM t)
    SELECT doc_id, round(least(n / 40.0, 1.0), 6)::DOUBLE AS length_norm, round(least(e / greatest(n, 1), 1.0), 6) AS density, CASE WHEN e > 0 THEN round(len(list_distinct(k)) / e, 6) ELSE 0 END AS type_diversity,
    CASE WHEN e > 0 THEN round(len(list_filter(k, lambda x: x = 'PER')) / e, 6) ELSE 0 END AS per_ratio, CASE WHEN e > 0 THEN round(len(list_filter(k, lambda x: x IN ('LOC', 'ORG'))) / e, 6) ELSE 0 END AS org_loc_ratio,
    CASE WHEN e > 0 THEN round(len(list_filter(k, lambda x: x = 'DAT')) / e, 6) ELSE 0 END AS date_ratio, round(len(list_distinct(list_transform(w, lambda x: lower(rtrim(ltrim(x, '.,!?;:'), '.,!?;:'))))) / greatest(n, 1), 6) AS richness FROM c""",
)
def text_entity_features(spark, d):
    kinds = F.concat(*[F.array_repeat(F.lit(k), F.regexp_count("text", F.lit(p))) for k, p in KIND_PATTERNS])
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return load(spark, d, "documents").filter("text is not null").select("doc_id", *entity_features(words, kinds))


@query("morpheme_scores")
def morpheme_scores(spark, d):
    """BLEU and chrF of answers against questions, over morphemes: both sides are cut by one dictionary of 20,000 pieces, learned from all turns."""
    ship(spark)
    bound_batches(spark)
    spans = morphemes.segmenter(*morphemes.piece_costs(load(spark, d, "conversations"), "text", 20000))
    cut = pairs(spark, d).select("turn", F.array_join(spans("hyp"), " ").alias("hyp"), F.array_join(spans("ref"), " ").alias("ref"))
    stats = cut.select("turn", M.bleu_word_stats("hyp", "ref").alias("b"), M.chrf_stats("hyp", "ref").alias("c"))
    sums = stats.groupBy("turn").agg(F.count("*").alias("n"), M.summed(F.col("b"), 2 + 2 * M.BLEU_ORDER).alias("b"), M.summed(F.col("c"), 3 * M.CHRF_ORDER).alias("c"))
    return sums.select("turn", "n", F.col("b")[0].alias("pieces"), F.round(M.bleu_score(F.col("b")), 6).alias("bleu"), F.round(M.chrf_score(F.col("c")), 6).alias("chrf"))

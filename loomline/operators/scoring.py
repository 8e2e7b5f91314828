"""Evaluation: n-gram metrics, name recall, stratified breakdowns, round medians and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import metrics as M
from loomline.functions import text as T
from loomline.functions.shipping import bound_batches, ship
from loomline.plans.registry import load, query


def pairs(spark, d) -> DataFrame:
    """A user turn as hypothesis for the assistant's next turn."""
    c = load(spark, d, "conversations")
    user = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("hyp"))
    return user.join(c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("ref")), ["conv_id", "turn"])


def corpus_scores(rows: DataFrame, by: str, groups: Column) -> DataFrame:
    """chrF and BLEU (characters, words) of each group, from one statistics row a pair; a pair goes to all its ``groups`` once it is counted."""
    ship(rows.sparkSession)
    bound_batches(rows.sparkSession)
    stats = rows.select(groups.alias("groups"), M.chrf_stats("hyp", "ref").alias("c"), M.bleu_char_stats("hyp", "ref").alias("b"), M.bleu_word_stats("hyp", "ref").alias("w"))
    stats = stats.select(F.explode("groups").alias(by), "c", "b", "w")
    sums = stats.groupBy(by).agg(F.count("*").alias("n"), M.summed(F.col("c"), 3 * M.CHRF_ORDER).alias("c"), M.summed(F.col("b"), 2 + 2 * M.BLEU_ORDER).alias("b"), M.summed(F.col("w"), 2 + 2 * M.BLEU_ORDER).alias("w"))
    return sums.select(by, "n", F.round(M.chrf_score(F.col("c")), 6).alias("chrf"), F.round(M.bleu_score(F.col("b")), 6).alias("bleu_char"), F.round(M.bleu_score(F.col("w")), 6).alias("bleu_word"))


def _scores_sql(groups: str, select: str) -> str:
    """The metrics in SQL: n-grams of characters without blanks (c) and of words (w), counted on both sides per pair, then summed per group.

    ``groups`` lists a pair's group keys; ``select`` reads grp, n and the scores of each group.
    """
    gram = {"c": "substr({}, i, k)", "w": "array_to_string({}[i:i + k - 1], ' ')"}
    grams = lambda kind, side, longest: (
        f"SELECT id, '{kind}' AS kind, k, unnest(list_transform(range(1, length({side}{kind}) - k + 2), lambda i: {gram[kind].format(side + kind)})) AS g, "
        f"{int(side == 'h')} AS a, {int(side == 'r')} AS b FROM t, range(1, {longest + 1}) o(k)"
    )
    return f"""WITH p AS (SELECT row_number() OVER () AS id, u.conv_id, a.turn, u.text AS hyp, a.text AS ref FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
    t AS (SELECT *, regexp_replace(hyp, '\\s', '', 'g') AS hc, regexp_replace(ref, '\\s', '', 'g') AS rc, regexp_extract_all(hyp, '\\S+') AS hw, regexp_extract_all(ref, '\\S+') AS rw, {groups} AS grps FROM p),
    g AS ({grams('c', 'h', 6)} UNION ALL {grams('c', 'r', 6)} UNION ALL {grams('w', 'h', 4)} UNION ALL {grams('w', 'r', 4)}),
    m AS (SELECT id, kind, k, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS hits FROM (SELECT id, kind, k, g, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL) GROUP BY ALL),
    q AS (SELECT id, unnest(grps) AS grp FROM t), z AS (SELECT grp, count(*) AS n FROM q GROUP BY grp),
    s AS (SELECT grp, kind, k, sum(a) AS a, sum(b) AS b, sum(hits) AS hits FROM q JOIN m USING (id) GROUP BY ALL),
    c AS (SELECT grp, avg(hits / a) AS p, avg(hits / b) AS r FROM s WHERE kind = 'c' AND a > 0 AND b > 0 GROUP BY grp),
    e AS (SELECT *, sum((a > 0 AND hits = 0)::INT) OVER (PARTITION BY grp, kind ORDER BY k) AS gaps FROM s WHERE k <= 4),
    l AS (SELECT grp, kind, max(a) FILTER (k = 1) AS a, max(b) FILTER (k = 1) AS b, max(hits) FILTER (k = 1) AS uni, count(*) FILTER (a > 0) AS orders,
      sum(CASE WHEN a = 0 THEN 0 WHEN hits = 0 THEN ln(100.0 / (2 ** gaps * a)) ELSE ln(100.0 * hits / a) END) AS logs FROM e GROUP BY ALL),
    x AS (SELECT grp, kind, orders, CASE WHEN coalesce(a, 0) = 0 OR uni = 0 THEN NULL WHEN a < b THEN exp(1 - b / a) ELSE 1 END AS brevity, logs FROM l),
    y AS (SELECT grp, max(CASE WHEN orders = 4 THEN brevity * exp(logs / 4) END) FILTER (kind = 'c') AS bleu_char, max(CASE WHEN orders = 4 THEN brevity * exp(logs / 4) END) FILTER (kind = 'w') AS bleu_word,
      max(brevity * exp(logs / orders)) FILTER (kind = 'c') AS effective FROM x GROUP BY grp),
    f AS (SELECT grp, n, round(coalesce(CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) END, 0), 6) AS chrf, round(coalesce(bleu_char, 0), 6) AS bleu_char, round(coalesce(bleu_word, 0), 6) AS bleu_word,
      round(coalesce(effective, 0), 6) AS bleu FROM z LEFT JOIN c USING (grp) LEFT JOIN y USING (grp)) {select}"""


_BREAKDOWN_SQL = "['all', 'len=' || CASE WHEN length(hyp) <= 80 THEN 'S' WHEN length(hyp) <= 200 THEN 'M' ELSE 'L' END, 'odd=' || conv_id % 2]"


@query("chrf_corpus", _scores_sql("['all']", "SELECT n, chrf FROM f"))
def chrf_corpus(spark, d):
    return corpus_scores(pairs(spark, d), "all", F.array(F.lit("all"))).select("n", "chrf")


@query("bleu_corpus", _scores_sql("[turn]", "SELECT grp AS turn, n, bleu_char, bleu_word FROM f"))
def bleu_corpus(spark, d):
    return corpus_scores(pairs(spark, d), "turn", F.array("turn")).select("turn", "n", "bleu_char", "bleu_word")


@query("chrf_sentence", _scores_sql("[id]", "SELECT conv_id, turn, chrf, bleu FROM f JOIN t ON id = grp"))
def chrf_sentence(spark, d):
    ship(spark)
    rows = pairs(spark, d).select("conv_id", "turn", M.chrf_stats("hyp", "ref").alias("c"), M.bleu_char_stats("hyp", "ref").alias("b"))
    return rows.select("conv_id", "turn", F.round(M.chrf_score(F.col("c")), 6).alias("chrf"), F.round(M.bleu_score(F.col("b"), effective=True), 6).alias("bleu"))


@query("score_breakdown", _scores_sql(_BREAKDOWN_SQL, "SELECT grp AS \"group\", n, chrf, bleu_char, bleu_word FROM f"))
def score_breakdown(spark, d):
    """All pairs, by length and by parity of the conversation, from one pass: each pair is counted once and goes to its three groups before the sums."""
    n = F.length("hyp")
    groups = F.array(F.lit("all"), F.concat(F.lit("len="), T.bucket(n, [(80, "S"), (200, "M")], "L", True)), F.concat(F.lit("odd="), (F.col("conv_id") % 2).cast("string")))
    return corpus_scores(pairs(spark, d), "group", groups)


_NAMES_SQL = "n AS (SELECT l_orderkey AS doc, l_returnflag AS tag, l_quantity > 25 AS strict, l_quantity > 20 AS lenient FROM lineitem)"


def names(spark, d) -> DataFrame:
    l = load(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("tag"), (F.col("l_quantity") > 25).alias("strict"), (F.col("l_quantity") > 20).alias("lenient"))


@query(
    "ets_metrics",
    f"""WITH {_NAMES_SQL}, d AS (SELECT doc, count(*) AS n, count(*) FILTER (strict) AS s, count(*) FILTER (lenient) AS l FROM n GROUP BY doc)
    SELECT round(sum(s) / sum(n), 6) AS strict, round(sum(l) / sum(n), 6) AS lenient, round(avg(s / n), 6) AS macro, sum(n)::BIGINT AS names, count(*) AS sentences FROM d""",
)
def ets_metrics(spark, d):
    """Micro and macro accuracy; a sentence without names is in no denominator, and without any the scores are null."""
    per = names(spark, d).groupBy("doc").agg(F.count("*").alias("n"), F.count_if("strict").alias("s"), F.count_if("lenient").alias("l"))
    return per.agg(
        F.round(F.sum("s") / F.sum("n"), 6).alias("strict"), F.round(F.sum("l") / F.sum("n"), 6).alias("lenient"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"), F.sum("n").alias("names"), F.count("*").alias("sentences")
    )


@query("name_recall", f"WITH {_NAMES_SQL} SELECT CASE WHEN count(*) = 0 THEN 'NaN'::DOUBLE ELSE round(avg(strict::INT), 6) END AS recall FROM n")
def name_recall(spark, d):
    """NaN, not null, without any name."""
    return names(spark, d).agg(F.when(F.count("*") == 0, F.lit(float("nan"))).otherwise(F.round(F.avg(F.col("strict").cast("int")), 6)).alias("recall"))


@query("ner_recall_mean", f"WITH {_NAMES_SQL}, d AS (SELECT doc, avg(strict::INT) FILTER (tag = 'A') AS r FROM n GROUP BY doc) SELECT round(avg(r), 6) AS recall, count(r) AS docs FROM d")
def ner_recall_mean(spark, d):
    per = names(spark, d).groupBy("doc").agg(F.avg(F.when(F.col("tag") == "A", F.col("strict").cast("int"))).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("recall"), F.count("r").alias("docs"))


@query("tag_recall_rollup", f"WITH {_NAMES_SQL} SELECT coalesce(tag, 'ALL') AS tag, count(*) AS n, round(avg(strict::INT), 6) AS base, round(avg(lenient::INT), 6) AS few FROM n GROUP BY ROLLUP (tag)")
def tag_recall_rollup(spark, d):
    rows = names(spark, d).rollup("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("strict").cast("int")), 6).alias("base"), F.round(F.avg(F.col("lenient").cast("int")), 6).alias("few"))
    return rows.withColumn("tag", F.coalesce("tag", F.lit("ALL")))


_ROUNDS_SQL = "r AS (SELECT event_type AS variant, user_id % 3 AS round, round(avg(value), 6) AS chrf, round(avg((value > 30)::INT), 6) AS recall, round(avg(user_id), 6) AS tokens FROM events GROUP BY ALL)"
_MEDIAN_SQL = f"{_ROUNDS_SQL}, m AS (SELECT variant, round(median(chrf), 6) AS chrf, round(median(recall), 6) AS recall, round(median(tokens), 6) AS tokens FROM r GROUP BY variant HAVING count(*) >= 3)"
CONTROL = "view"


def rounds(spark, d) -> DataFrame:
    e = load(spark, d, "events").groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("round"))
    return e.agg(F.round(F.avg("value"), 6).alias("chrf"), F.round(F.avg((F.col("value") > 30).cast("int")), 6).alias("recall"), F.round(F.avg("user_id"), 6).alias("tokens"))


def medians(rows: DataFrame) -> DataFrame:
    """Medians over rounds of each variant that has three or more."""
    per = rows.groupBy("variant").agg(*[F.round(F.median(c), 6).alias(c) for c in ("chrf", "recall", "tokens")], F.count("*").alias("k"))
    return per.filter("k >= 3").drop("k")


@query("round_median", f"WITH {_MEDIAN_SQL} SELECT * FROM m")
def round_median(spark, d):
    return medians(rounds(spark, d))


@query("round_spread", f"WITH {_ROUNDS_SQL} SELECT round(max(chrf) - min(chrf), 6) AS chrf, round(max(recall) - min(recall), 6) AS recall FROM r WHERE variant = '{CONTROL}'")
def round_spread(spark, d):
    """Tolerances: the spread of the control's rounds."""
    return rounds(spark, d).filter(F.col("variant") == CONTROL).agg(*[F.round(F.max(c) - F.min(c), 6).alias(c) for c in ("chrf", "recall")])


@query(
    "noninferiority",
    f"""WITH {_MEDIAN_SQL}, t AS (SELECT max(chrf) - min(chrf) AS tc, max(recall) - min(recall) AS tr FROM r WHERE variant = '{CONTROL}'), b AS (SELECT chrf AS bc, recall AS br FROM m WHERE variant = '{CONTROL}'),
    v AS (SELECT variant, round(chrf - bc, 6) AS d_chrf, round(recall - br, 6) AS d_recall, tokens, chrf - bc >= -tc AND recall - br >= -tr AS pass FROM m, t, b WHERE variant <> '{CONTROL}') SELECT variant, d_chrf, d_recall, pass, pass AND tokens = (SELECT min(tokens) FROM v WHERE pass) AS chosen FROM v""",
)
def noninferiority(spark, d):
    """A variant passes if no metric falls below the control by more than the tolerance; of those, the fewest tokens are chosen."""
    m, tol = medians(rounds(spark, d)), round_spread(spark, d).toDF("tc", "tr")
    base = m.filter(F.col("variant") == CONTROL).select(F.col("chrf").alias("bc"), F.col("recall").alias("br"))
    v = m.filter(F.col("variant") != CONTROL).join(F.broadcast(tol)).join(F.broadcast(base))
    ok = (F.col("chrf") - F.col("bc") >= -F.col("tc")) & (F.col("recall") - F.col("br") >= -F.col("tr"))
    v = v.select("variant", F.round(F.col("chrf") - F.col("bc"), 6).alias("d_chrf"), F.round(F.col("recall") - F.col("br"), 6).alias("d_recall"), "tokens", ok.alias("pass"))
    least = v.agg(F.min(F.when(F.col("pass"), F.col("tokens"))).alias("least"))
    return v.join(F.broadcast(least)).select("variant", "d_chrf", "d_recall", "pass", F.coalesce(F.col("pass") & (F.col("tokens") == F.col("least")), F.lit(False)).alias("chosen"))


@query("ab_compare", f"WITH {_MEDIAN_SQL} SELECT round(a.chrf - b.chrf, 6) AS d_chrf, round(a.recall - b.recall, 6) AS d_recall, round(100 * (a.tokens - b.tokens) / b.tokens, 4) AS d_tokens_pct FROM m a, m b WHERE a.variant = 'click' AND b.variant = '{CONTROL}'")
def ab_compare(spark, d):
    m = medians(rounds(spark, d))
    pick = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c)))
    return m.agg(
        F.round(pick("chrf", "click") - pick("chrf", CONTROL), 6).alias("d_chrf"),
        F.round(pick("recall", "click") - pick("recall", CONTROL), 6).alias("d_recall"),
        F.round(100 * (pick("tokens", "click") - pick("tokens", CONTROL)) / pick("tokens", CONTROL), 4).alias("d_tokens_pct"),
    )

"""Queries over the text, routing, failure and recognition functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import ner, routing, slots
from loomline.functions import text as T
from loomline.functions.shipping import ship
from loomline.plans.registry import load, query

#: Sentences in the shape of the court records, dealt to documents by id and put before their texts; the tables have none.
SENTENCES = (
    "傳曰, 知道。", "○ 上在昌德宮。", "以姜銑爲副修撰", "領議政李元翼進曰, 許之。", "答曰, 允從。不允", "命放釋罪廢之人。", "承旨金自點, 啓曰, 還宮", "許之諫, 馳啓", "傳于李馨長曰知道", "拜柳洪爲判書", "藥房無事", "上曰, 不許。狀啓",
)
_SENTENCE_SQL = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + f"][doc_id % {len(SENTENCES)} + 1] || chr(10) || coalesce(text, '')"


def sentences(spark, d) -> DataFrame:
    """Whole texts, each after a sentence."""
    first = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("s"))


@query("formulaic_flag", f"SELECT doc_id, regexp_matches({_SENTENCE_SQL}, '{'|'.join(p for p, _ in routing.FORMULAIC)}') AS formulaic FROM documents")
def formulaic_flag(spark, d):
    return sentences(spark, d).select("doc_id", F.col("s").rlike("|".join(p for p, _ in routing.FORMULAIC)).alias("formulaic"))


def _plain(pattern: str) -> str:
    """DuckDB has no lookahead: the one that is used becomes a character or the end."""
    return pattern.replace("許之(?!諫)", "許之([^諫]|$)")


@query(
    "pattern_phrases",
    f"SELECT doc_id, concat_ws('; ', {', '.join(f'''CASE WHEN regexp_matches(s, '{_plain(p)}') THEN '{t}' END''' for p, t in routing.PHRASES)}) AS phrases FROM (SELECT doc_id, {_SENTENCE_SQL} AS s FROM documents)",
)
def pattern_phrases(spark, d):
    """All phrases whose pattern occurs, in the table's order."""
    return sentences(spark, d).select("doc_id", F.array_join(T.all_matches(F.col("s"), routing.PHRASES), "; ").alias("phrases"))


# A first-match phrase table.
FIRST_PHRASES = [
    ("傳敎曰|傳敎하여曰|下敎曰", "전교하기를"), ("傳旨", "전지하기를"), ("御命", "어명으로"), ("允許|允從|許之(?!諫)", "윤허하다"), ("不許|不允", "윤허하지 않다"), ("薨逝|薨", "훙서하다"), ("卒逝|卒(?!業)", "졸하다"),
    ("行幸|臨幸", "거둥하다"), ("還宮", "환궁하다"), ("拜.*爲|除授|落點", "제수하다"), ("狀啓", "장계하기를"), ("馳啓", "치계하기를"), ("書啓", "서계하기를"), ("啓曰|言啓|啓稟", "아뢰기를"),
]


@query(
    "first_match_rule",
    f"SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(s, '{_plain(p).replace('卒(?!業)', '卒([^業]|$)')}') THEN '{t}' ''' for p, t in FIRST_PHRASES)} END AS phrase FROM (SELECT doc_id, {_SENTENCE_SQL} AS s FROM documents)",
)
def first_match_rule(spark, d):
    return sentences(spark, d).select("doc_id", T.first_match(F.col("s"), FIRST_PHRASES).alias("phrase"))


# Sentence patterns in order, and length edges of the three scorers (inclusive, exclusive, exclusive).
SENTENCE_PATTERNS = [("啓曰", "REP"), ("不許", "DEN"), ("狀啓", "MEM"), ("上曰|傳曰", "ROY")]
EDGES_SCORER, EDGES_SELECTOR, EDGES_REVIEW = [(30, "XS"), (80, "S"), (150, "M")], [(50, "XS"), (150, "S"), (350, "M")], [(30, "0-30"), (80, "30-80")]


@query(
    "pattern_bucket",
    f"""SELECT doc_id, CASE WHEN contains(s, '啓曰') THEN 'REP' WHEN contains(s, '不許') THEN 'DEN' WHEN contains(s, '狀啓') THEN 'MEM' WHEN regexp_matches(s, '上曰|傳曰') THEN 'ROY' ELSE 'GEN' END AS pattern,
    CASE WHEN n <= 30 THEN 'XS' WHEN n <= 80 THEN 'S' WHEN n <= 150 THEN 'M' ELSE 'L' END AS scorer, CASE WHEN n < 50 THEN 'XS' WHEN n < 150 THEN 'S' WHEN n < 350 THEN 'M' ELSE 'L' END AS selector,
    CASE WHEN n < 30 THEN '0-30' WHEN n < 80 THEN '30-80' ELSE '80+' END AS review FROM (SELECT doc_id, {_SENTENCE_SQL} AS s, length(text) AS n FROM documents)""",
)
def pattern_bucket(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.length("text").alias("n")).join(sentences(spark, d), "doc_id")
    return rows.select(
        "doc_id",
        F.coalesce(T.first_match(F.col("s"), SENTENCE_PATTERNS), F.lit("GEN")).alias("pattern"),
        T.bucket(F.col("n"), EDGES_SCORER, "L", True).alias("scorer"),
        T.bucket(F.col("n"), EDGES_SELECTOR, "L", False).alias("selector"),
        T.bucket(F.col("n"), EDGES_REVIEW, "80+", False).alias("review"),
    )


@query(
    "clean_text",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('○ ' || text || ' (x王y)  ○<thought>a b</thought>z', '(?s)<thought>.*?</thought>', '', 'g'), '^\\s*○\\s*', ''), '○', ' ', 'g')) AS light,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('○ ' || text || ' (x王y)  ○<thought>a b</thought>z', '(?s)<thought>.*?</thought>', '', 'g'), '^\\s*○\\s*', ''), '○', ' ', 'g'), '\\([^)]*[一-鿿][^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS deep FROM documents""",
)
def clean_text(spark, d):
    raw = F.concat(F.lit("○ "), F.col("text"), F.lit(" (x王y)  ○<thought>a b</thought>z"))
    return load(spark, d, "documents").select("doc_id", T.clean_output(raw).alias("light"), T.clean_output(raw, deep=True).alias("deep"))


@query("script_ratio", f"SELECT doc_id, round(len(regexp_extract_all(s, '[一-鿿]')) / greatest(length(s), 1), 6) AS han, regexp_matches(s, '[一-鿿]') AS has_han, regexp_full_match(s, '[가-힣]+') AS all_hangul FROM (SELECT doc_id, {_SENTENCE_SQL} AS s FROM documents)")
def script_ratio(spark, d):
    s = F.col("s")
    return sentences(spark, d).select("doc_id", F.round(T.han_ratio(s), 6).alias("han"), s.rlike("[一-鿿]").alias("has_han"), s.rlike(r"\A[가-힣]+\z").alias("all_hangul"))


def features(text: Column) -> list[Column]:
    """Eight features of a sentence: length, four pattern flags, two mark densities, variety of characters."""
    n = F.greatest(F.length(text), F.lit(1))
    han = F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1))
    count = lambda p: F.regexp_count(text, F.lit(p))
    flag = lambda p: text.rlike(p).cast("double")
    return [
        F.least(n / F.lit(350.0), F.lit(1.0)).alias("len"), flag("啓曰|又啓").alias("rep"), flag("不許|不允").alias("den"), flag("狀啓|書啓").alias("mem"), flag("上曰|傳曰|上이").alias("roy"),
        F.least(count("·") / n * 5, F.lit(1.0)).alias("dots"), F.least(count("[月日]") / n * 10, F.lit(1.0)).alias("dates"), (F.size(F.array_distinct(han)) / F.greatest(F.size(han), F.lit(1))).alias("variety"),
    ]


@query(
    "text_features",
    f"""SELECT doc_id, round(least(greatest(length(s), 1) / 350.0, 1.0), 6)::DOUBLE AS len, regexp_matches(s, '啓曰|又啓')::INT::DOUBLE AS rep, regexp_matches(s, '不許|不允')::INT::DOUBLE AS den, regexp_matches(s, '狀啓|書啓')::INT::DOUBLE AS mem,
    regexp_matches(s, '上曰|傳曰|上이')::INT::DOUBLE AS roy, round(least(len(regexp_extract_all(s, '·')) / greatest(length(s), 1) * 5, 1.0), 6)::DOUBLE AS dots, round(least(len(regexp_extract_all(s, '[月日]')) / greatest(length(s), 1) * 10, 1.0), 6)::DOUBLE AS dates,
    round(len(list_distinct(regexp_extract_all(s, '[一-鿿]'))) / greatest(len(regexp_extract_all(s, '[一-鿿]')), 1), 6)::DOUBLE AS variety FROM (SELECT doc_id, {_SENTENCE_SQL} AS s FROM documents)""",
)
def text_features(spark, d):
    names = ("len", "rep", "den", "mem", "roy", "dots", "dates", "variety")
    return sentences(spark, d).select("doc_id", *features(F.col("s"))).select("doc_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    "multilabel_counts",
    """WITH x AS (SELECT doc_id, length(text) AS n, n_chars, CASE WHEN length(text) < 200 THEN 'short' END AS a, CASE WHEN contains(text, '!!') THEN 'shout' END AS b, CASE WHEN contains(text, '|') THEN 'table' END AS c, CASE WHEN regexp_matches(text, '[0-9a-f]{32}') THEN 'hex' END AS e FROM documents),
    y AS (SELECT unnest(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL AND e IS NULL THEN ['other'] ELSE list_filter([a, b, c, e], lambda t: t IS NOT NULL) END) AS label FROM x) SELECT label, count(*) AS n FROM y GROUP BY label""",
)
def multilabel_counts(spark, d):
    t = F.col("text")
    labels = F.array_compact(
        F.array(F.when(F.length(t) < 200, "short"), F.when(t.contains("!!"), "shout"), F.when(t.contains("|"), "table"), F.when(t.rlike("[0-9a-f]{32}"), "hex"))
    )
    rows = load(spark, d, "documents").select(F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("other")))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def bad_output(output: Column, reference: Column, original: Column) -> Column:
    """A failed marker, mostly Han characters, or far too short against reference or original."""
    hangul, han = F.regexp_count(output, F.lit("[가-힣]")), F.regexp_count(output, F.lit("[一-鿿]"))
    ratio = lambda t: F.length(output) / F.greatest(F.length(t), F.lit(1))
    return output.contains("__TRANSLATION_FAILED__") | ((han > hangul * 0.3) & (han > 3)) | (ratio(reference) < 0.3) | (ratio(original) < 0.3)


@query(
    "bad_output",
    f"""SELECT doc_id, contains(o, '__TRANSLATION_FAILED__') OR (len(regexp_extract_all(o, '[一-鿿]')) > len(regexp_extract_all(o, '[가-힣]')) * 0.3 AND len(regexp_extract_all(o, '[一-鿿]')) > 3) OR length(o) / greatest(length(s), 1) < 0.3 OR length(o) / greatest(n % 30, 1) < 0.3 AS bad
    FROM (SELECT doc_id, {_SENTENCE_SQL} AS s, n_chars AS n, CASE doc_id % 4 WHEN 0 THEN '__TRANSLATION_FAILED__' WHEN 1 THEN {_SENTENCE_SQL} WHEN 2 THEN '가나' ELSE '가나다라마바사아자차' END AS o FROM documents)""",
)
def bad_outputs(spark, d):
    rows = sentences(spark, d).join(load(spark, d, "documents").select("doc_id", (F.col("n_chars") % 30).alias("m")), "doc_id")
    k = F.col("doc_id") % 4
    rows = rows.withColumn("o", F.when(k == 0, "__TRANSLATION_FAILED__").when(k == 1, F.col("s")).when(k == 2, "가나").otherwise("가나다라마바사아자차"))
    return rows.select("doc_id", bad_output(F.col("o"), F.col("s"), F.repeat(F.lit("x"), F.col("m").cast("int"))).alias("bad"))


@query(
    "snippet",
    """WITH x AS (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents WHERE contains(text, ' the ')), w AS (SELECT doc_id, greatest(p - 15, 1) AS st, p, text FROM x),
    y AS (SELECT doc_id, substr(text, st, p - st) || split_part(substr(substr(text, st, p - st + 80), p - st + 1), chr(10), 1) AS line FROM w) SELECT doc_id, CASE WHEN length(line) > 100 THEN substr(line, 1, 100) || '…' ELSE line END AS snippet FROM y""",
)
def snippets(spark, d):
    return load(spark, d, "documents").filter(F.col("text").contains(" the ")).select("doc_id", T.snippet(F.col("text"), " the ").alias("snippet"))


#: Failure messages in the shapes providers send, dealt to events by id.
FAILURES = (
    "429 RESOURCE_EXHAUSTED retry in 7.5s", "429 quota PerDay exceeded", "429 monthly spending cap", "[503] overloaded", "Request timed out after 5000ms", "processed 4290 tokens", "404 model no longer available",
    "400 API_KEY_INVALID", "blocked by safety", "HTTP 500 Internal", "retryDelay: 900s resource_exhausted", "permission_denied on models/x 404",
)
_FAILURE_SQL = "[" + ", ".join(f"'{s}'" for s in FAILURES) + f"][event_id % {len(FAILURES)} + 1]"
_CLASS_SQL = """CASE WHEN regexp_matches(m, '\\b429\\b|resource_exhausted') THEN CASE WHEN contains(m, 'spending cap') THEN 'SPEND_CAP' WHEN regexp_matches(m, 'perday|per day') THEN 'QUOTA_DAILY' ELSE 'RATE_LIMITED' END
WHEN regexp_matches(m, 'api_key_invalid|api key not valid|api key expired|permission_denied|unauthenticated') THEN 'AUTH_FAILED' WHEN regexp_matches(m, '\\b404\\b|not_found|no longer available') THEN 'MODEL_UNAVAILABLE'
WHEN regexp_matches(m, '\\b503\\b|unavailable|\\b500\\b|internal') THEN 'SERVER_ERROR' WHEN regexp_matches(m, 'timed out|timeout') THEN 'TIMEOUT' WHEN regexp_matches(m, 'safety|blocked|prohibited') THEN 'CONTENT_FILTERED' ELSE 'UNKNOWN' END"""
_FAILED_SQL = f"f AS (SELECT event_id, user_id, {_FAILURE_SQL} AS message, lower({_FAILURE_SQL}) AS m FROM events), c AS (SELECT *, {_CLASS_SQL} AS class FROM f)"


def failures(spark, d) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, FAILURES)), (F.col("event_id") % len(FAILURES) + 1).cast("int"))
    rows = load(spark, d, "events").select("event_id", "user_id", message.alias("message"))
    return rows.withColumn("class", routing.error_class(F.col("message")))


@query("error_classify", f"WITH {_FAILED_SQL} SELECT event_id, class FROM c")
def error_classify(spark, d):
    return failures(spark, d).select("event_id", "class")


@query(
    "retry_hint",
    f"""WITH {_FAILED_SQL} SELECT event_id, CASE WHEN ms > 300000 THEN 300000 ELSE ms END AS hint_ms FROM (SELECT event_id, CAST(round(TRY_CAST(coalesce(nullif(regexp_extract(m, 'retry\\s+in\\s+([0-9]+(\\.[0-9]+)?)\\s*s', 1), ''), nullif(regexp_extract(m, 'retry[_-]?delay"?\\s*[:=]\\s*"?([0-9]+(\\.[0-9]+)?)\\s*s', 1), '')) AS DOUBLE) * 1000) AS BIGINT) AS ms FROM c)""",
)
def retry_hint(spark, d):
    return failures(spark, d).select("event_id", routing.retry_hint_ms(F.col("message")).alias("hint_ms"))


def http_table(spark, own_key: bool) -> DataFrame:
    rows = routing.ERROR_HTTP | (routing.ERROR_HTTP_OWN_KEY if own_key else {})
    return spark.createDataFrame([(c, *v) for c, v in rows.items()], "class string, status int, code string, retry boolean")


_HTTP_SQL = ", ".join(f"('{c}', {s}, '{k}', {str(r).lower()})" for c, (s, k, r) in routing.ERROR_HTTP.items())


@query(
    "error_http_map",
    f"""WITH {_FAILED_SQL}, h AS (SELECT * FROM (VALUES {_HTTP_SQL}) t(class, status, code, retry)), r AS (SELECT event_id, TRY_CAST(coalesce(nullif(regexp_extract(m, 'retry in ([0-9.]+)s', 1), ''), nullif(regexp_extract(m, 'retrydelay: ([0-9.]+)s', 1), '')) AS DOUBLE) AS s FROM c)
    SELECT event_id, status, code, CASE WHEN retry THEN greatest(1, CAST(ceil(coalesce(CASE WHEN s > 300 THEN 300 ELSE s END, 60)) AS BIGINT)) END AS retry_after FROM c JOIN h USING (class) JOIN r USING (event_id)""",
)
def error_http_map(spark, d):
    """Status, code and, where a retry makes sense, seconds to wait: the hint rounded up, a minute without one."""
    rows = failures(spark, d).join(F.broadcast(http_table(spark, False)), "class")
    wait = F.coalesce(routing.retry_hint_ms(F.col("message")), F.lit(60000))
    return rows.select("event_id", "status", "code", F.when(F.col("retry"), F.greatest(F.lit(1), F.ceil(wait / 1000))).cast("long").alias("retry_after"))


@query(
    "failure_policy",
    f"""WITH {_FAILED_SQL}, d AS (SELECT *, 1 + user_id % 5 AS delivery, class IN ('SPEND_CAP', 'AUTH_FAILED', 'MODEL_UNAVAILABLE', 'CONTENT_FILTERED') AS dead FROM c)
    SELECT event_id, CASE WHEN dead OR (class <> 'QUOTA_DAILY' AND delivery >= 4) THEN 'DEAD' ELSE 'FAILED' END AS status, class || CASE WHEN NOT dead AND class <> 'QUOTA_DAILY' AND delivery >= 4 THEN '_MAX_REDELIVERY' ELSE '' END AS error,
    class IN ('QUOTA_DAILY', 'SPEND_CAP') AS pause_batch, dead OR class = 'QUOTA_DAILY' OR delivery >= 4 AS acknowledge FROM d""",
)
def failure_policy(spark, d):
    rows = failures(spark, d).withColumn("o", routing.failure_outcome(F.col("class"), 1 + F.col("user_id") % 5))
    return rows.select("event_id", "o.status", "o.error", "o.pause_batch", "o.acknowledge")


@query("reign_year", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 1623 + TRY_CAST(lpad((doc_id % 60)::VARCHAR, 2, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '0' END) AS INT) - 1 END AS year FROM documents")
def reign_years(spark, d):
    n = F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0")
    n = F.when(F.col("doc_id") % 7 == 0, F.lpad((F.col("doc_id") % 60).cast("string"), 2, "x")).otherwise(n)
    made = F.concat(F.lit("SJW-"), F.when(F.col("doc_id") % 5 == 0, "B").otherwise("A"), n, F.lit("0"))
    return load(spark, d, "documents").select("doc_id", T.reign_year(made).alias("year"))


@query("office_dict", "SELECT DISTINCT o AS office FROM (SELECT regexp_extract(p_type || ' (' || p_brand || ')', '\\(([^)]*)\\)', 1) AS o FROM part) WHERE length(o) >= 2")
def office_dict(spark, d):
    title = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return load(spark, d, "part").select(F.regexp_extract(title, r"\(([^)]*)\)", 1).alias("office")).filter(F.length("office") >= 2).distinct()


@query("json_roundtrip", "SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 6 = 0 THEN '{}' ELSE props END, '$.k') AS INT) AS k, event_id % 6 = 0 AS dropped FROM events")
def json_roundtrip(spark, d):
    """Cached values read back: what doesn't parse is dropped and counts as a miss."""
    raw = F.when(F.col("event_id") % 6 == 0, "{bad").otherwise(F.col("props"))
    value = F.from_json(raw, "k int")
    return load(spark, d, "events").select("event_id", value["k"].alias("k"), F.coalesce(value["k"].isNull(), F.lit(True)).alias("dropped"))


@query("json_repair", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_repair(spark, d):
    raw = F.concat(F.lit("```json\nHere: "), "props", F.lit("\n``` done"))
    return load(spark, d, "events").select("event_id", F.from_json(T.json_block(raw), "k int")["k"].alias("k"))


@query("map_sum", "SELECT event_id, round(value + user_id, 6) AS total, 3 AS stages FROM events")
def map_sum(spark, d):
    merged = F.map_concat(F.create_map(F.lit("ner"), F.col("value")), F.create_map(F.lit("llm"), F.col("user_id").cast("double"), F.lit("parse"), F.lit(0.0)))
    return load(spark, d, "events").select("event_id", F.round(F.aggregate(F.map_values(merged), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(merged).alias("stages"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) * 0.65::DOUBLE) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("day_bucket", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(floor(max(epoch(ts))) - floor(min(epoch(ts))) AS BIGINT) AS span FROM events GROUP BY 1")
def day_bucket(spark, d):
    t = F.col("ts").cast("timestamp")
    return load(spark, d, "events").groupBy(F.date_format(t, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), (F.unix_timestamp(F.max(t)) - F.unix_timestamp(F.min(t))).alias("span"))


@query("content_version", "SELECT 'nations-' || substr(sha256(string_agg(n_name, '' ORDER BY n_nationkey)), 1, 8) AS version FROM nation")
def content_version(spark, d):
    """A version from the content: name and eight hex digits of the hash of all parts in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return load(spark, d, "nation").agg(F.concat(F.lit("nations-"), F.substring(F.sha2(F.array_join(parts, ""), 256), 1, 8)).alias("version"))


@query("name_reflected", "SELECT doc_id, contains(text, w) OR (length(w) >= 3 AND contains(text, substr(w, 2))) AS hit FROM (SELECT doc_id, text, substr('xthe', 1 + (doc_id % 3)::INT) AS w FROM documents)")
def name_reflected(spark, d):
    w = F.substr(F.lit("xthe"), (1 + F.col("doc_id") % 3).cast("int"))
    return load(spark, d, "documents").select("doc_id", slots.name_reflected(F.col("text"), w).alias("hit"))


@query("rule_ner")
def rule_ner(spark, d):
    """Names by rule with offsets."""
    ship(spark)
    return sentences(spark, d).select("doc_id", ner.rule_ner("s").alias("found")).select("doc_id", F.array_join(F.transform("found", lambda e: F.concat(e["surface"], F.lit("@"), e["start"].cast("string"))), ";").alias("found"))


@query(
    "bio_spans",
    """WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['B-PER', 'I-PER', 'O'] WHEN 1 THEN ['I-LOC', 'B-PER', 'I-LOC'] WHEN 2 THEN ['O', 'O', 'O'] ELSE ['B-DAT', 'I-DAT', 'I-DAT'] END AS labels FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, unnest([1, 2, 3]) AS i, unnest(labels) AS label, unnest([0.9, 0.5, 0.4]::DOUBLE[]) AS score FROM l),
    k AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind FROM t), p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
    o AS (SELECT *, sum((kind IS NOT NULL AND (label LIKE 'B-%' OR kind IS DISTINCT FROM before))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM p),
    e AS (SELECT doc_id, kind, min(2 * i - 2) AS s, max(2 * i) AS e, avg(score) AS m FROM o WHERE kind IS NOT NULL GROUP BY doc_id, span, kind HAVING avg(score) >= 0.5)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce((SELECT string_agg(kind || ':' || s || ':' || e || ':' || round(m, 4), ';' ORDER BY s) FROM e WHERE e.doc_id = d.doc_id), '') END AS spans FROM documents d""",
)
def bio_spans(spark, d):
    """Label sequences merged to spans: three tokens of two characters, labels by id."""
    ship(spark)
    k = F.col("doc_id") % 4
    labels = F.when(k == 0, F.array(*map(F.lit, ("B-PER", "I-PER", "O")))).when(k == 1, F.array(*map(F.lit, ("I-LOC", "B-PER", "I-LOC")))).when(k == 2, F.array(*map(F.lit, ("O", "O", "O")))).otherwise(F.array(*map(F.lit, ("B-DAT", "I-DAT", "I-DAT"))))
    args = (labels, F.array(F.lit(0.9), F.lit(0.5), F.lit(0.4)), F.array(*map(F.lit, (0, 2, 4))), F.array(*map(F.lit, (2, 4, 6))))
    rows = load(spark, d, "documents").select("doc_id", ner.bio_spans(0.5)(F.col("text"), *args).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string"), e["score"].cast("string"))), ";").alias("spans"))


DICTIONARY = ("worthless", "less", "idiot", "the", "thes", "edition", "tion")


def _marked_sql(text: str) -> str:
    """The text with each word's kept occurrences as runs of a private character, longer words first: no two words of equal length overlap."""
    for w in sorted(DICTIONARY, key=len, reverse=True):
        text = f"replace({text}, '{w}', repeat(chr({0xE000 + DICTIONARY.index(w)}), {len(w)}))"
    return text


@query(
    "dict_match",
    f"""WITH m AS (SELECT doc_id, {_marked_sql('text')} AS m FROM documents), w AS (SELECT unnest({list(DICTIONARY)}) AS word, unnest(range(57344, {57344 + len(DICTIONARY)})) AS mark)
    SELECT doc_id, word, CAST((length(m) - length(replace(m, chr(mark::INT), ''))) / length(word) AS BIGINT) AS n, CAST(instr(m, chr(mark::INT)) - 1 AS INT) AS first FROM m, w WHERE contains(m, chr(mark::INT))""",
)
def dict_match(spark, d):
    """Dictionary words per document, longest first, without overlaps."""
    ship(spark)
    rows = load(spark, d, "documents").select("doc_id", F.inline(ner.dictionary_matches(list(DICTIONARY))("text")))
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("start").alias("first"))

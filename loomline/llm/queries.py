"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import bitsliced, collocations, concurrency, decontamination, jaccard_join, language, packing, secrets, sharding, token_files, toxicity, url_filter

#: Fixed values of the url contract: (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_seeded_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = toxicity.remainder(F.col("doc_id"), 5)
    model = toxicity.train(docs, labels, fold != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = sharding.even_tree(8, racks=2, regions=2)
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), eight, sharding.with_new_region(eight, 8))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


def op5_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_tiled_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def op7_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, blanks_dropped=True)


def op8_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


def op10_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = toxicity.remainder(F.col("doc_id"), 3)
    found = language.identify(docs, language.train(docs, fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op11_fenwick_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.open_sales(*[_table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")])


def op12_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op13_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def queries() -> dict:
    return {
        "op1_seeded_decontamination": op1_seeded_decontamination,
        "op2_factorization_toxicity": op2_factorization_toxicity,
        "op3_hash_tree_shards": op3_hash_tree_shards,
        "op4_sum_of_squares_packing": op4_sum_of_squares_packing,
        "op5_token_efficiency_secrets": op5_token_efficiency_secrets,
        "op6_tiled_jaccard_components": op6_tiled_jaccard_components,
        "op7_orc_token_files": op7_orc_token_files,
        "op8_url_redirects": op8_url_redirects,
        "op9_grace_dedup": op9_grace_dedup,
        "op10_mixture_language": op10_mixture_language,
        "op11_fenwick_concurrency": op11_fenwick_concurrency,
        "op12_bitsliced_topk": op12_bitsliced_topk,
        "op13_suffix_collocations": op13_suffix_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_grace_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
            FROM d""",
        "op11_fenwick_concurrency": """
            WITH shipped AS (SELECT sale_id, max(floor(epoch_us(shipped_at) / 60000000)) AS m FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id),
            nations AS (SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY client_id),
            opened AS (SELECT coalesce(nation, -1) AS nation, CAST(floor(epoch_us(sold_at) / 60000000) AS BIGINT) AS a, CAST(m AS BIGINT) + 10080 AS b,
              CASE WHEN total IS NULL OR NOT isfinite(total) THEN 0 ELSE CAST(floor(100 * total + 0.5) AS BIGINT) END AS cents
              FROM sales s LEFT JOIN shipped USING (sale_id) LEFT JOIN nations USING (client_id) WHERE sold_at IS NOT NULL),
            valid AS (SELECT * FROM opened WHERE b IS NULL OR b > a),
            sides AS (SELECT nation, a, b, cents FROM valid UNION ALL SELECT -2, a, b, cents FROM valid),
            deltas AS (SELECT nation, a AS m, 1 AS dn, cents AS dc FROM sides UNION ALL SELECT nation, b, -1, -cents FROM sides WHERE b IS NOT NULL),
            moments AS (SELECT nation, m, sum(dn) AS dn, sum(dc) AS dc FROM deltas GROUP BY ALL HAVING sum(dn) <> 0 OR sum(dc) <> 0),
            running AS (SELECT nation, m, lead(m) OVER w AS nxt, CAST(sum(dn) OVER w AS BIGINT) AS n_open, CAST(sum(dc) OVER w AS BIGINT) AS open_cents FROM moments WINDOW w AS (PARTITION BY nation ORDER BY m))
            SELECT CAST(nation AS INT) AS nation_id, m * 60 AS from_s, nxt * 60 AS to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation ORDER BY m) AS high_open,
              n_open = max(n_open) OVER (PARTITION BY nation) AS is_peak FROM running""",
        "op12_bitsliced_topk": """
            WITH usable AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
            scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
            SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
        "op13_suffix_collocations": r"""
            WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
            totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
            grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 6) t(size))),
            counts AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
            longer AS (SELECT s.lang, s.phrase FROM counts s JOIN counts b ON b.lang = s.lang AND b.size > s.size AND b.a >= s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.size > 1),
            kept AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM longer)),
            cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
            scored AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, CAST(1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
              FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.p JOIN counts r ON r.lang = c.lang AND r.phrase = c.q JOIN totals t ON t.lang = c.lang),
            best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
            SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM best WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""",
    }

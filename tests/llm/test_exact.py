"""Operators whose results are exact: sharding, deduplication, packing, token files, urls, the Jaccard join."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyarrow.orc import ORCFile
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import common, exact_dedup, fasttok, jaccard_join, packing, sharding, textvec, token_files, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, hub long, n long"


def table(spark, rows):
    """Rows (doc_id, text) with nulls and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 7, 1) for i, t in rows], DOCS)


ROWS = [(0, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f"), (4, "A  b c\td e f"), (5, "x"), (6, "x"), (6, "x"), (None, "a b c d e f"), (None, "only null"), (9, "word " * 30000), (10, "  \n ")]


# --- sharding


def test_shards_keep_their_law(spark):
    eight = sharding.even_tree(8)
    docs = table(spark, ROWS).unionByName(table(spark, [(i, "t" * (i % 50)) for i in range(100, 3100)]))
    rows = sharding.assign_shards(docs, eight, sharding.with_new_region(eight, 8)).collect()
    assert len(rows) == len(ROWS) + 3000
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) < 1.4 * min(counts.values())
    moved = sum(r["grown_shard"] == 8 for r in rows) / len(rows)
    assert 0.07 < moved < 0.16
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["size"] == len("A  b c\td e f") + 1 and by_id[1]["size"] == 1
    assert by_id[4]["text_crc32"] == zlib.crc32(b"A  b c\td e f")
    assert sharding.assign_shards(docs.limit(0), eight).count() == 0


def test_shards_match_a_plain_descent(spark):
    """The same draws recomputed one by one: the child with the least -ln(u) / weight wins at each level."""
    root = sharding.tree({"r0": {"k0": {0: 1.0, 1: 3.0}, "k1": {2: 0.5}}, "r1": {"k2": {3: 1.0, 4: 0.0}}, "r2": {"k3": {5: 2.0}}})
    paths = {}

    def collect(n):
        for c in n.children:
            paths[c.path] = c
            collect(c)

    collect(root)
    order = sorted(paths)
    rows = spark.range(500).select("id", *[F.xxhash64("id", F.lit(p)).alias(f"h{k}") for k, p in enumerate(order)], sharding.shard_of(F.col("id"), root).alias("shard")).collect()
    for r in rows:
        node = root
        while node.shard is None:
            alive = [c for c in node.children if c.weight > 0]
            time = [-np.log((((r[f"h{order.index(c.path)}"] % 2**64) >> 11) + 0.5) * 2.0**-53) / c.weight for c in alive]
            node = alive[int(np.argmin(time))]
        assert r["shard"] == node.shard


def test_weight_changes_confine_movement(spark):
    before = sharding.tree({"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0}}, "r1": {"k2": {3: 1.0, 4: 1.0}}, "r2": {"k3": {5: 2.0}}})
    after = sharding.tree({"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 3.0}}, "r1": {"k2": {3: 1.0, 4: 1.0}}, "r2": {"k3": {5: 2.0}}})
    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")).collect()
    for r in rows:
        if r["a"] != r["b"]:
            assert r["b"] in (0, 1, 2)  # only into the subtree whose weight grew
        if r["a"] == 2:
            assert r["b"] == 2


# --- exact dedup


def test_grace_spills_and_compares_contents():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(400)]
    rows = [rng.choice(texts) for _ in range(3000)]
    weak = lambda t: zlib.crc32(t) % 7 << 40  # noqa: E731  many collisions of the hash
    records = [(weak(t), hashlib.sha256(t).digest(), t, 1, i, 1) for i, t in enumerate(rows)]
    merged = {e[2]: (e[3], e[4]) for e in exact_dedup.grace(records, budget=2000)}
    want = {}
    for i, t in enumerate(rows):
        want[t] = (want.get(t, (0, 0))[0] + 1, i)
    assert merged == want


def test_exact_dedup(spark):
    rows = {}
    for r in exact_dedup.exact_dedup(table(spark, ROWS), budget=4000).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in rows[0]] == [(3, 3, False)]
    assert [(r["keep_id"], r["kept"]) for r in rows[3]] == [(3, True)]
    assert rows[1][0]["keep_id"] == 2 and rows[2][0]["kept"] and rows[1][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in rows[6]] == [(6, 3, True)] * 2
    assert sorted((r["keep_id"] is None, r["kept"]) for r in rows[None]) == [(False, False), (True, True)]
    stay = exact_dedup.keep_distinct(table(spark, ROWS))
    assert stay.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in stay.collect()) == [-1, 2, 3, 4, 6, 9, 10]
    assert exact_dedup.exact_dedup(table(spark, ROWS).limit(0)).count() == 0


def test_keeping_distinct_leaves_any_columns(spark):
    rows = [(1, "a", "u1", 5), (2, "a", "u2", 6), (3, None, "u3", 7), (4, "", "u4", 8), (None, "a", "u5", 1), (None, "b", "u6", 2), (None, "b", "u6", 2), (5, "x" * 300000, "u7", 3), (5, "x" * 300000, "u7", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, own long")
    docs = docs.withColumns({"_digest": F.col("digest"), "_key": F.col("own"), "top": F.col("own"), "at_top": F.lit(9), "n": F.lit(1), "content": F.col("text"), "a.b": F.lit(1)})
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r["digest"] for r in got) == ["u2", "u4", "u6", "u7"]
    assert all(r["_digest"] == r["digest"] and r["_key"] == r["own"] == r["top"] for r in got)
    assert exact_dedup.keep_distinct(docs.limit(0)).count() == 0


# --- tokens


@pytest.mark.parametrize(("file", "dropped"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_tokenizers_ids(file, dropped):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "'", "9", "!", "..", " ", "\x1c", "́", "日本", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "\r\n", " the", ".\nThe", "x,", "don't."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + ["see <|endoftext|> here"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert fasttok.PieceEncoder(public_tokenizers.path(file), dropped).encode(texts) == want


@pytest.mark.parametrize(("file", "dropped"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_few_remembered_pieces_give_the_same_ids(file, dropped):
    rng = random.Random(4)
    path = public_tokenizers.path(file)
    few, many = fasttok.PieceEncoder(path, dropped, 1000), fasttok.PieceEncoder(path, dropped)
    for _ in range(20):
        texts = ["the " + " ".join("".join(rng.choices("abcdeé", k=7)) + rng.choice(["", ",", "  x"]) for _ in range(30)) for _ in range(20)]
        assert few.encode(texts) == many.encode(texts)
        assert len(few.known) <= 1000 + 2 * 20 * 62  # what a batch adds: pieces and the words in them
    assert len(many.known) > 8000


def test_packing_with_few_remembered_pieces(spark, monkeypatch):
    rng = random.Random(5)
    docs = table(spark, [*ROWS, *((100 + i, " ".join("".join(rng.choices("abcde", k=6)) for _ in range(900))) for i in range(60))]).coalesce(1)
    file = public_tokenizers.path("byte_bpe_50k.json")
    key = lambda r: (r["sequence_id"], r["offset"])
    want = sorted(packing.pack(docs, file, end_id=1).collect(), key=key)
    assert sorted(packing.pack(docs, file, end_id=1, most_pieces=50).collect(), key=key) == want
    asked = []
    monkeypatch.setattr(packing, "pack", lambda *args, **named: asked.append(named))
    corpus_pipeline.packed(spark, docs, "")
    assert asked[0]["most_pieces"] <= 200_000  # 180 bytes each, in two workers beside a heap that earlier stages filled


def test_packing_holds_each_id_once(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    rng = random.Random(3)
    rows = [*ROWS, *((100 + i, "word and other " * rng.randrange(900)) for i in range(150))]
    pieces = packing.pack(table(spark, rows).repartition(3), file, end_id=1, size=2048).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    windows, seen = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        seen[p["doc_id"]].append(p)
    assert set(seen) == set(ids)
    for i, many in ids.items():
        assert sum(p["length"] for p in seen[i]) == sum(map(len, many))
        if len(many) == 1:
            at = 0
            for p in sorted(seen[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(many[0])
                assert p["ids_crc32"] == zlib.crc32(many[0][at : at + p["length"]].tobytes())
                at += p["length"]
    partial = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
        partial += at < 2048
    assert partial <= 3  # one a task
    assert packing.pack(table(spark, ROWS).limit(0), file, 1).count() == 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10)
    rng = random.Random(4)
    counts = Counter()
    for k in range(300):
        size = rng.randrange(1, 11)
        options = []
        for h in [0, *sorted(x for x, c in counts.items() if c)]:
            if h + size <= 10:
                after = counts.copy()
                if h:
                    after[h] -= 1
                if h + size < 10:
                    after[h + size] += 1
                options.append((sum(c * c for c in after.values()), h, after))
        best = min(options, key=lambda o: (o[0], o[1]))
        packer.place(size, k)
        counts = best[2]
        assert {h: len(w) for h, w in enumerate(packer.open) if w} == {h: c for h, c in counts.items() if c}


def test_token_files_round_trip(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    rows = [r for r in ROWS if r[0] is not None]
    got = sorted(token_files.token_table(table(spark, rows).repartition(3), file, 2, True).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_table(table(spark, ROWS).limit(0), file, 2, True).count() == 0


def test_token_files_are_pruned_by_their_metadata(spark, tmp_path):
    file = public_tokenizers.path("word_bpe_49k.json")
    path = str(tmp_path / "tokens")
    docs = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_files.write_token_files(docs, path, file, 2, True)
    parts = [ORCFile(p) for p in sorted(tmp_path.glob("tokens/*.orc"))]
    assert sum(p.nrows for p in parts) == 20000
    assert all(p.row_index_stride == 1000 and p.nstripes >= 1 and p.file_footer_length > 0 for p in parts)
    tokenizer = Tokenizer.from_file(file)
    for wanted, most in (([7000], 1000), ([7001], 0), ([10, 39998], 2000), ([], 0)):  # 7001 lies in a row group's range; its Bloom filter has no such id
        found = token_files.lookup(spark, path, wanted)
        rows = {r["doc_id"]: list(r["ids"]) for r in found.collect()}
        assert rows == {i: [*tokenizer.encode(f"word {i}", add_special_tokens=False).ids, 2] for i in wanted if i % 2 == 0}
        if wanted:
            plan = found._jdf.queryExecution().executedPlan()
            read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
            assert read <= most + 1000 * (wanted == [7001])


# --- urls


RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
PAGES = [
    (0, "http://A.Example.com/en/x?q=1", None), (1, "https://www.example.com/en/x", ""), (2, "ftp://a.net/es/1", None), (3, "nothing", None), (4, None, None), (5, "http://example.com", None),
    (6, "http://m.org/start", '<link rel="canonical" href="http://a.net/es/1">'), (7, "http://m.org/next", '<meta http-equiv="refresh" content="0; url=/start">'), (8, "http://m.org/other", "<link rel=canonical href='next#x'>"),
    (9, "http://n.org/a", '<link rel="canonical" href="http://b.net/es/2"><link rel="canonical" href="http://www.example.com/en/y">'), (10, "http://free.org/a", '<link rel="stylesheet" href="http://a.net/es/1">'), (6, "http://m.org/start", None),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = url_filter.judge_urls(pages.withColumn("rule", F.lit("clash")).withColumn("component", F.lit(1)), RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/es/1", "net/es/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("example.com", "", None, "allow")
    assert [got[k][2:] for k in (6, 7, 8)] == [(None, "block")] * 3  # over two and three edges
    assert got[9][3] == "allow"  # an allowed name takes precedence
    assert got[10][3] == "allow"
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    log = spark.createDataFrame([("http://free.org/a", "http://m.org/other")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, RULES, log).collect()}[10] == "block"


def test_spellings_without_edges_stay_apart(spark):
    rows = [(1, "http://a.net/es", None), (2, "http://a.net/es/", None), (3, "http://www.a.net/es?ref=x", None), (4, "http://a.net:80/es", None), (5, "http://a.net/es/#top", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, RULES).collect()} == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block"}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, RULES, fold_spellings=True).collect()} == {"block"}


def plain_verdict(url):
    """(rule, verdict) by the longest rule."""
    if url is None or "://" not in url:
        return None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_match_union_find_on_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(3):
        hosts = ["a.net", "www.a.net", "b.org", "example.com", "www.example.com", "c.org", "d.io"]
        urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/', '/x', '/index.html'])}{rng.choice(['', '?ref=1', '#f', str(i)])}" for i in range(80)]
        log = [(rng.choice(urls), rng.choice(urls)) for _ in range(45)]
        rows = [(i, u) for i, u in enumerate(urls)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in log:
            parent[find(a.split("#")[0])] = find(b.split("#")[0])
        says = defaultdict(set)
        for u in [*urls, *(x for e in log for x in e)]:
            says[find(u.split("#")[0])].add(plain_verdict(u)[1])
        want = {i: plain_verdict(u)[1] or ("block" if "block" in (s := says[find(u.split("#")[0])]) and "allow" not in s else "allow") for i, u in rows}
        got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES, spark.createDataFrame(log, "src string, dst string"), html=None).collect()
        assert {r["page_id"]: r["verdict"] for r in got} == want
        assert {r["page_id"]: r["rule"] for r in got} == {i: plain_verdict(u)[0] for i, u in rows}


def test_urls_of_tags_over_lines(spark):
    rows = [
        (1, "http://m.org/a", '<link href="http://a.net/es/1"\n  rel="canonical">'),
        (2, "http://m.org/b", '<meta content="0;\r\n url=http://a.net/es/1"\r\n http-equiv="refresh">'),
        (3, "http://m.org/c", '<link\nrel="canonical"\nhref="http://a.net/es/1"\n>'),
        (4, "http://m.org/d", '<link href="http://a.net/es/1"\n  rel="stylesheet">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, RULES).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


# --- Jaccard join


def shingles(text, k):
    w = [x.lower() for x in (text or "").encode().replace(b"\x1c", b"\x1c").split()]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_jaccard_components_match_brute_force(spark, k, num, den):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [*ROWS], [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))] for _ in range(25)]
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    want = brute_components(rows, k, num, den)
    out = jaccard_join.jaccard_components(table(spark, rows).repartition(3), k, num, den, block=500).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]), r
    sizes = {i: len(shingles(t, k)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out if r["doc_id"] is not None)
    kept = jaccard_join.keep_one_each(table(spark, rows), k, num, den).filter("doc_id is not null").select("doc_id").distinct()
    assert {r[0] for r in kept.collect()} == set(want.values())


def test_keeping_one_each_leaves_any_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "u1", 5), (2, text + " more", "u2", 6), (3, None, "u3", 7), (None, text, "u4", 8), (4, "word " * 100000, "u5", 9), (4, "word " * 100000, "u6", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string, key long").withColumn("_drop", F.col("dropped")).withColumn("component_id", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = jaccard_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["dropped"] for r in kept.collect()) == ["u1", "u3", "u4", "u5", "u6"]
    assert all(r["_drop"] == r["dropped"] for r in kept.collect())
    assert jaccard_join.keep_one_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [False, True])
def test_components_of_contracted_parts(spark, monkeypatch, text):
    """Chains, stars, loops and nulls in many small parts and in one part, which needs no rounds."""
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100)] + [(200, 201 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7), (None, 3), (5, None)]
    rng.shuffle(edges)
    named = lambda i: i if i is None or not text else f"é{i:04}"
    around = defaultdict(set)
    for a, b in edges:
        if None not in (a, b) and a != b:
            around[a].add(b)
            around[b].add(a)
    want = {}
    for first in sorted(around):
        todo = [first] if first not in want else []
        while todo:
            i = todo.pop()
            want[i] = first
            todo += [k for k in around[i] if k not in want]
    df = spark.createDataFrame([(named(a), named(b)) for a, b in edges], "a string, b string" if text else "a long, b long").repartition(7)
    rounds, real = [], common._starred
    monkeypatch.setattr(common, "_starred", lambda e: rounds.append(e) or real(e))
    for most in (0, 4, 60, 1 << 16):
        rounds.clear()
        with common.Tables(spark) as tables:
            got = [tuple(r) for r in common.connected_components(df, tables, most).select("node", "component").collect()]
        assert len(got) == len(want) and dict(got) == {named(i): named(k) for i, k in want.items()}
        assert bool(rounds) == (most < len(edges))
    with common.Tables(spark) as tables:
        assert not common.connected_components(df.limit(0), tables).count()


def test_jaccard_of_empty_table(spark):
    assert jaccard_join.jaccard_components(table(spark, ROWS).limit(0)).count() == 0


def test_pairs_of_a_group_of_near_copies_follow_its_size(spark, monkeypatch):
    """Copies of a text with one or two words changed: about a tenth of all pairs link. Past the first stars few pairs are compared a document, and components are exact."""
    rng, rows = random.Random(7), []
    for i in range(500):
        words = [f"w{k}" for k in range(100)]
        for _ in range(rng.choice((1, 2))):
            words[rng.randrange(100)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    near, real = [], jaccard_join.Tables.save

    def save(self, df, label):
        out = real(self, df, label)
        if label == "near":
            near.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.Tables, "save", save)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table(spark, rows).repartition(4)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (t.split() for _, t in rows)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(500):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(500)}
    assert 0 < sum(near[1:]) <= 1.5 * len(rows)


def test_pairs_at_the_threshold_share_a_part():
    rng = np.random.default_rng(1)
    tiles = jaccard_join.Tiles(85, 100)
    for _ in range(800):
        n = int(rng.integers(1, 150))
        u = rng.integers(0, 2**64, 2 * n + 5, dtype=np.uint64)
        drop, add = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        a, b = u[:n], np.concatenate([u[drop:n], u[n : n + add]])
        if 100 * (n - drop) >= 85 * (n + add):
            keys, owner = jaccard_join.all_keys([np.sort(a), np.sort(b)], tiles)
            assert len(np.intersect1d(keys[owner == 0], keys[owner == 1]))
        both = len(np.intersect1d(a, b))
        assert jaccard_join.overlap_bound(jaccard_join.bitmap(a), len(a), jaccard_join.bitmap(b), len(b)) >= both


def test_word_hashes_follow_the_words():
    texts = ["a B\tc\x0bd", "", " x ", "é É y", "z" * 10_000_00 + " end", "a b\x1cc"]
    h, at = textvec.word_hashes(texts)
    words = [w.lower() for t in texts for w in t.encode().split()]
    assert len(h) == len(words)
    assert len({(int(x), w) for x, w in zip(h, words, strict=True)}) == len(set(words)) == len({int(x) for x in h})

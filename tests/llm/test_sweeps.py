"""Concurrency sweep, bit-sliced search and collocations against plain recomputation."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from loomline.llm import bitsliced, collocations, concurrency
from loomline.llm.common import Tables

# --- concurrency


def plain_sweep(deltas):
    per = defaultdict(lambda: [0, 0])
    for g, m, dn, dc in deltas:
        if g is not None and m is not None:
            per[g, m][0] += dn
            per[g, m][1] += dc
    out = []
    for g in {g for g, _ in per}:
        rows = sorted((m, *v) for (h, m), v in per.items() if h == g and v != [0, 0])
        n = c = 0
        made = []
        for m, dn, dc in rows:
            n, c = n + dn, c + dc
            made.append((m, n, c))
        peak, high = max((x[1] for x in made), default=0), None
        for k, (m, n, c) in enumerate(made):
            high = n if high is None else max(high, n)
            out.append((g, m * 60, made[k + 1][0] * 60 if k + 1 < len(made) else None, n, c, high, n == peak))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_sweep_matches_a_plain_pass(spark, bits):
    rng = random.Random(bits)
    deltas = [(rng.choice([1, 1, 1, 2, -2, None]), rng.choice([rng.randrange(-3000, 3000), rng.randrange(40), None, 5]), rng.choice([-1, 0, 1]), rng.randrange(-3, 4)) for _ in range(1500)]
    deltas += [(7, 100, 1, 5), (7, 100, -1, -5), (8, 3, -4, 0), (8, 4, -1, 0)]
    rows = concurrency.sweep(spark.createDataFrame(deltas, "grp int, minute long, dn long, dc long"), bits).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain_sweep(deltas)
    assert len({r["grp"] for r in rows if not r["is_peak"]}) > 2


def test_sweep_of_a_hot_group_and_of_nothing(spark):
    rows = spark.range(40000).select(F.lit(1).alias("grp"), (F.col("id") * 3).alias("minute"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).cast("long").alias("dn"), F.lit(1).cast("long").alias("dc"))
    got = concurrency.sweep(rows)
    assert got.count() == 40000 and got.filter("is_peak").count() == 20000 and got.filter("to_s is null").count() == 1
    assert got.filter("open_cents <> from_s / 180 + 1 or high_open <> 1").count() == 0
    assert concurrency.sweep(rows.limit(0)).count() == 0


def test_sales_edges(spark):
    t = lambda h, m=0, s=0: dt.datetime(2024, 1, 1, h, m, s)
    sales = [(1, 1, 10.005, t(1, 0, 59)), (2, 1, None, t(2)), (3, None, 1.0, t(1)), (4, 9, 1.0, t(1)), (5, 1, 1.0, None), (6, 1, float("nan"), t(3)), (None, 2, 2.0, t(4)), (7, 1, 5.0, dt.datetime(2024, 2, 1))]
    lines = [(1, t(5, 7, 30)), (1, None), (2, None), (6, t(3)), (7, t(0)), (None, t(9))]
    clients = [(1, 4, "x"), (2, None, "y"), (None, 3, "z"), (1, 6, "twice")]
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz").withColumns({"nation_id": F.lit(99), "shipped_at": F.lit("clash"), "grp": F.lit(1), "size": F.lit(1)})
    lines_ = spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz").withColumn("total", F.lit(-1))
    got = concurrency.open_sales(s, lines_, spark.createDataFrame(clients, "client_id long, nation_id int, name string")).collect()
    base = int(t(0).replace(tzinfo=dt.timezone.utc).timestamp())
    rows = {(r["nation_id"], r["from_s"] - base): (r["n_open"], r["open_cents"]) for r in got}
    week = 7 * 86400
    # sale 7 ends before it starts; sale 5 has no start; of client 1 the smaller nation counts
    assert rows[4, 3600] == (1, 1001) and rows[4, 7200] == (2, 1001) and rows[4, 10800] == (3, 1001)
    assert rows[4, 10800 + week] == (2, 1001) and rows[4, 5 * 3600 + 420 + week] == (1, 0)
    assert rows[-1, 3600] == (2, 200) and rows[-1, 14400] == (3, 400)
    assert rows[-2, 3600] == (3, 1201)
    assert concurrency.open_sales(s.limit(0), lines_, spark.createDataFrame(clients, "client_id long, nation_id int, name string")).count() == 0


# --- bit-sliced search


def plain_top(rows, k, scale):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(np.float64(x) * scale)) for x in v]
            usable[i] = min(usable.get(i, w), w)
    out = []
    for q in (i for i in usable if i % 20 == 0):
        score = lambda i: sum(a * b for a, b in zip(usable[q], usable[i]))  # noqa: B023, E731
        best = sorted(((-score(i), i) for i in usable if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "queries"), [(1 << 16, 256), (64, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(bitsliced, "ROWS", rows)
    monkeypatch.setattr(bitsliced, "QUERIES", queries)
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in np.float32(rng.normal(size=9) * 3)]) for i in rng.choice(10000, 300, replace=False)]
    vectors += [(20000 + i, [1.0] * 9) for i in range(90)]  # ties over the boundary
    vectors += [(40, None), (None, [1.0] * 9), (60, [None] + [1.0] * 8), (80, [float("nan")] * 9), (100, [float("inf")] * 9), (21000, [2.0] * 9), (21000, [2.0] * 9), (21000, [1.0] * 9), (21020, [0.0] * 9), (21040, [0.5, -0.5]), (21060, [])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, block int, group string, v int")
    got = sorted(tuple(r) for r in bitsliced.exact_top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == plain_top(vectors, 20, 64)
    few = df.filter("vec_id in (20000, 20020, 20001)")
    assert len(bitsliced.exact_top_k(few, F.col("vec_id") % 20 == 0).collect()) == 4
    assert bitsliced.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_of_slices():
    rng = np.random.default_rng(0)
    v = rng.integers(-90, 120, (200, 7))
    v[3] = 0
    block = bitsliced.build_block(np.arange(200), v)
    for q in (rng.integers(-50, 50, 7), np.zeros(7, int), np.array([0, 0, -1, 0, 0, 0, 0]), np.array([99])):
        slices, shift = bitsliced.score_slices(block, ~block["slices"], q)
        total = sum(((np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) << w) for w, s in enumerate(slices)), np.zeros(200, int)) + shift
        assert (total == v[:, : len(q)] @ q).all()
    with pytest.raises(ValueError):
        bitsliced._matrix(__import__("pyarrow").array([[1 << 30]]))


# --- collocations


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ",;:!?\n\x0b\x0c\r":
        low = low.replace(c, ".")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in low.split(".")]


def plain_collocations(docs, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for w in words_of(text):
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    out = []
    for lang in n:
        cands = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(b) > len(p) and cands[b] >= a and any(b[i : i + len(p)] == p for i in range(len(b))) for b in cands):
                continue
            cuts = []
            for k in range(1, len(p)):
                l, r = f[lang, p[:k]], f[lang, p[k:]]  # noqa: E741
                cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
            s, _, l, r = min(cuts)  # noqa: E741
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):  # noqa: E741
            out.append((lang, k + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 1 << 19])
def test_collocations_match_a_plain_count(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    rng = random.Random(5)
    vocab = [*"abcdefgh", "Große", "ÀB", "x\x00y", "\x1cz", "語"]
    docs = [(" ".join(rng.choices(vocab, k=rng.randrange(30))) + rng.choice([".", "\n", ";", "\t", " ", ""]), rng.choice(["en", "de", None, "und"])) for _ in range(400)]
    docs += [("New York City hall, New York City", "en")] * 9 + [("a a a a a a a", "fr")] * 4 + [(None, "en"), ("", None), (". ,;\n\t ", "en"), ("one two " * 3000, "de"), ("x\vy\fz\rq", "fr")]
    df = spark.createDataFrame([(t, lang, 1, "w", 0) for t, lang in docs], "text string, lang string, n int, phrase string, a int")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=8, longest=5, top=40).collect())
    assert got == plain_collocations(docs, 8, 5, 40)
    assert {r[0] for r in got} == {"en", "de", "und", "fr"}
    assert collocations.collocations(df.limit(0), 8, 5, 40).count() == 0


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500).astype(np.int32)
    for depth in (2, 3, 5, 8):
        order = collocations.suffix_array(ids, depth)
        key = lambda i: tuple(ids[i : i + depth]) + (0,) * (depth - len(ids[i : i + depth]))  # noqa: B023, E731
        assert [key(i) for i in order] == sorted(key(i) for i in np.flatnonzero(ids))
        left, shared = collocations.common_prefixes(ids, order, depth)
        for n in range(1, depth + 1):
            want = Counter(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if 0 not in ids[i : i + n])
            first, counts = collocations.intervals(order, left, shared, n)
            assert dict(zip([tuple(ids[i : i + n]) for i in first], counts.tolist(), strict=True)) == want
    assert len(collocations.suffix_array(np.zeros(3, np.int32), 5)) == 0 and len(collocations.suffix_array(np.zeros(0, np.int32), 5)) == 0


def test_a_filter_too_small_changes_nothing(spark, monkeypatch):
    docs = [(f"{a} {b} {a}", "en") for a in "abcde" for b in "fghij" for _ in range(6)]
    df = spark.createDataFrame(docs, "text string, lang string")
    real = collocations.make_filter
    monkeypatch.setattr(collocations, "make_filter", lambda h: real(h, most=3))
    assert sorted(tuple(r) for r in collocations.collocations(df, 6, 5, 99).collect()) == plain_collocations(docs, 6, 5, 99)


def test_a_task_sums_its_shards_before_it_hands_counts_on(spark, monkeypatch):
    """Rows of n-gram counts, and of what is spelled out, follow the distinct n-grams of a task, not how many of its shards hold them."""
    made, real, shards, many = {}, collocations.map_batches, collocations.make_shards, []

    def counted(df, fn, schema):
        out = real(df, fn, schema)
        if "ids" not in schema.split() and "h" not in schema.split()[0::2]:
            made[schema] = made.get(schema, 0) + out.count()
        return out

    monkeypatch.setattr(collocations, "map_batches", counted)
    # a shard from each of ``many`` partitions, all read by one task
    monkeypatch.setattr(collocations, "make_shards", lambda docs, *seed: shards(docs.repartition(many[-1]), *seed).coalesce(1))
    rows = []
    docs = [("one two three four five. six one two", "en")] * 40
    df = spark.createDataFrame(docs, "text string, lang string")
    for n in (2, 10):
        made.clear()
        many.append(n)
        assert sorted(tuple(r) for r in collocations.collocations(df, 20, 5, 99).collect()) == plain_collocations(docs, 20, 5, 99)
        rows.append(sum(made.values()))
    assert rows[0] == rows[1]


def test_many_words_are_numbered_in_parts_and_packed_in_several_keys(spark, monkeypatch):
    docs = [(f"{a} {b} {a} {b} {a}", "en") for a in "abcde" for b in "fghij" for _ in range(6)]
    df = spark.createDataFrame(docs, "text string, lang string")
    want = plain_collocations(docs, 6, 5, 99)
    monkeypatch.setattr(collocations, "WORDS", 3)
    assert sorted(tuple(r) for r in collocations.collocations(df, 6, 5, 99).collect()) == want
    ids = np.array([1, (1 << 31) - 1, 5, 1 << 30, 7])
    keys = collocations._keys(ids, np.array([0]), 5, 31)
    assert [int(k[0]) for k in keys] == [(1 << 31) + (1 << 31) - 1, (5 << 31) + (1 << 30), 7]
    names = spark.createDataFrame([("en", f"w{i}", int(n)) for i, n in enumerate(ids)], "lang string, phrase string, number long")
    counted = spark.createDataFrame([(*(int(k[0]) for k in keys), 9)], "k0 long, k1 long, k2 long, a long")
    assert [tuple(r) for r in collocations._spelled(counted, names, 5, 31).collect()] == [("en", 5, "w0 w1 w2 w3 w4", 9)]


def test_words_of_one_hash_are_hashed_anew(spark, monkeypatch):
    real = collocations.make_shards

    def clash(docs, seed=0):
        out = real(docs, seed)
        return out if seed else out.withColumn("hashes", F.transform("hashes", lambda h: h.bitwiseAND(F.lit(1))))

    monkeypatch.setattr(collocations, "make_shards", clash)
    docs = [("a b c a b", "en")] * 9
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.collocations(df, 6, 5, 99).collect()) == plain_collocations(docs, 6, 5, 99)


def test_filter_holds_its_entries(spark):
    h = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bitmap = collocations.make_filter(h)
    own = np.array([r[0] for r in h.collect()]).view(np.uint64)
    other = np.array([r[0] for r in spark.range(10000, 30000).select(F.xxhash64("id")).collect()]).view(np.uint64)
    assert collocations._inside(bitmap, own).all() and collocations._inside(bitmap, other).mean() < 0.05


def test_a_task_holds_a_few_shards_however_many_its_part_makes(spark):
    """Shards are rows of megabytes: no row group of their tables has many, as the writer and the reader hold a whole one."""
    sizes = defaultdict(list)

    class Seen(Tables):
        def save(self, df, label, *args, **kwargs):
            out = super().save(df, label, *args, **kwargs)
            files = ds.dataset(self.at[id(out)][1], format="parquet").get_fragments()
            sizes[label] += [g.total_byte_size for f in files for g in f.row_groups]
            return out

    words = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (F.xxhash64(F.col("id"), i) % 1000).cast("string"))
    docs = spark.range(0, 6000, 1, 1).select(F.array_join(words, " ").alias("text"), F.lit("en").alias("lang"))
    with Seen(spark) as tables:
        counts, _ = collocations.phrase_counts(docs, tables, 100, 2)
        assert counts.agg(F.sum("a")).first()[0] >= 6_000_000
    for label in ("shards", "runs"):
        assert sum(sizes[label]) > 20 << 20 and max(sizes[label]) <= 8 << 20, (label, sizes[label])

"""Pruned neighbours, posting blocks, morphemes, remote enrichment and tables behind JDBC."""

import itertools
import json
import math
import random
import threading
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.functions import morphemes
from loomline.operators import databases, extras, neighbours, postings
from loomline.sources import jdbc, remote

# --- neighbours


def plain_nearest(ids, v, asked):
    out = {}
    for q in asked:
        d = np.round(np.sqrt(((v - v[ids.index(q)]) ** 2).sum(1)), 9)
        out[q] = min((x, i) for x, i in zip(d.tolist(), ids, strict=True) if i != q)
    return out


def vectors(spark, ids, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")


def test_nearest_skips_most_of_a_clustered_pool(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 8)) * 50
    v = np.concatenate([c + rng.normal(size=(150, 8)) for c in centres])
    ids = [int(i) for i in rng.permutation(len(v)) * 3]
    asked = ids[::50]
    df = vectors(spark, ids, v)
    got = neighbours.nearest_pruned(df.filter(F.col("vec_id").isin(asked)), df).collect()
    assert {r["vec_id"]: (r["dist"], r["nearest"]) for r in got} == plain_nearest(ids, v, asked)
    assert sum(r["seen"] for r in got) + neighbours.PIVOTS * len(asked) < 0.1 * len(asked) * len(ids)


def test_nearest_of_even_and_tied_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(200, 5)), np.ones((80, 5)), rng.integers(0, 2, (120, 5)).astype(float)])
    ids = list(range(10, 10 + len(v)))
    df = vectors(spark, ids, v)
    got = neighbours.nearest_pruned(df.filter("vec_id % 7 = 0"), df).collect()
    assert {r["vec_id"]: (r["dist"], r["nearest"]) for r in got} == plain_nearest(ids, v, [i for i in ids if i % 7 == 0])
    assert neighbours.nearest_pruned(df, df.limit(0)).count() == 0
    alone = df.filter("vec_id = 10")
    assert neighbours.nearest_pruned(alone, alone).count() == 0


# --- postings


def test_posting_blocks_hold_a_million_ids_in_bounded_rows(spark):
    entries = spark.range(1_000_000).select(F.lit("x").alias("surface"), (F.col("id") * 3).alias("id"))
    blocks = postings.posting_blocks(entries)
    assert blocks.agg(F.max("n")).first()[0] <= 4096 and blocks.count() == 733
    ids = postings.block_ids(blocks)
    assert ids.agg(F.count("*"), F.sum("id"), F.max("id")).first() == (1_000_000, 3 * 999_999 * 500_000, 2_999_997)


def test_postings_round_trip_and_meet(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "", None]), rng.choice([None, rng.randrange(-9000, 9000), rng.randrange(10**12)])) for _ in range(3000)] + [("a", i) for i in range(0, 9000, 5)] + [("b", i) for i in range(0, 9000, 7)]
    own = defaultdict(set)
    for s, i in rows:
        if s is not None and i is not None:
            own[s].add(i)
    postings.write_postings(postings.posting_blocks(spark.createDataFrame(rows, "surface string, id long")), f"{tmp_path}/p")
    blocks = spark.read.parquet(f"{tmp_path}/p")
    got = defaultdict(list)
    for r in postings.block_ids(blocks).collect():
        got[r["surface"]].append(r["id"])
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in own.items()}
    assert sorted(r["id"] for r in postings.intersect(blocks, "a", "b").collect()) == sorted(own["a"] & own["b"])


# --- morphemes


def all_cuts(word):
    for marks in itertools.product([0, 1], repeat=max(0, len(word) - 1)):
        edges = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] if word else []


def test_best_path_is_the_cheapest_of_all_cuts():
    rng = random.Random(8)
    for _ in range(300):
        costs = {"".join(rng.choices("abc", k=rng.randrange(1, 4))): rng.choice([0.5, 1, 2, 3.25]) for _ in range(6)}
        word = "".join(rng.choices("abcd", k=rng.randrange(0, 9)))
        pieces, cost = morphemes.best_path(word, costs, 2.5, 3)
        price = lambda cut: sum(costs.get(p, 2.5 if len(p) == 1 else math.inf) for p in cut)  # noqa: B023, E731
        assert "".join(pieces) == word and price(pieces) == pytest.approx(cost) == pytest.approx(min(map(price, all_cuts(word))))


def test_segments_of_a_column(spark):
    costs, unknown = morphemes.piece_costs(spark.createDataFrame([("walking talking walked",), ("walk talk",), (None,)], "text string"), "text", 50)
    assert {"walk", "ing", "talk", "ed"} <= set(costs) and unknown > max(costs.values())
    cut = morphemes.segmenter({"walk": 1.0, "ing": 1.0, "talk": 1.0}, 9.0)
    df = spark.createDataFrame([("walking talk", 1), (None, 2), ("", 3), ("xing", 4)], "text string, k int")
    assert {r["k"]: r["p"] for r in df.select("k", cut("text").alias("p")).collect()} == {1: ["walk", "ing", "talk"], 2: None, 3: [], 4: ["x", "ing"]}


# --- remote


class _Flaky(BaseHTTPRequestHandler):
    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
        with self.server.lock:
            self.server.calls[text] += 1
            self.server.open += 1
            self.server.most = max(self.server.most, self.server.open)
            first = self.server.calls[text] == 1
        code = 503 if "flaky" in text and first or "down" in text else 400 if "bad" in text else 200
        body = json.dumps([] if "empty" in text else [text.upper()]).encode()
        threading.Event().wait(0.02)
        with self.server.lock:
            self.server.open -= 1
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), _Flaky)
    s.lock, s.calls, s.open, s.most = threading.Lock(), Counter(), 0, 0
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_enrichment_counts_calls(spark, tmp_path, server):
    texts = [f"{kind}{i}" for kind in ("ok", "flaky", "empty", "bad", "down") for i in range(8)]
    rows = spark.createDataFrame([(t, remote.entities_request(t, 0.5)) for t in texts * 2] + [(None, "x")], "key string, request string")
    call = remote.post_json(f"http://127.0.0.1:{server.server_port}/v1/ner")
    got = {r["key"]: r for r in remote.enrich(rows, call, f"{tmp_path}/kept", in_flight=3, wait_s=0.01, rounds=2, tasks=2).collect()}
    assert set(got) == set(texts)
    for t in texts:
        want = {"o": 1, "f": 2, "e": 1, "b": 1, "d": 2}[t[0]]
        assert server.calls[t] == want == got[t]["attempts"]
        assert (got[t]["error"] is None) == (t[0] in "ofe") and (got[t]["answer"] is None) == (t[0] in "bd")
        if t[0] == "e":
            assert json.loads(got[t]["answer"]) == []
    assert server.most <= 6
    before = Counter(server.calls)
    again = remote.enrich(rows, call, f"{tmp_path}/kept", in_flight=3, wait_s=0.01, rounds=2, tasks=2)
    assert again.count() == len(texts)
    assert all(server.calls[t] == before[t] for t in texts if t[0] in "ofe") and all(server.calls[t] > before[t] for t in texts if t[0] in "bd")


def test_an_answer_that_is_turned_down_is_asked_for_again():
    asked = []

    def call(body):
        asked.append(body)
        return "漢字" if len(asked) < 3 else "plain"

    again = lambda answer: None if answer == "plain" else f"no Han, please ({len(asked)})"
    assert remote.attempt(call, "q", 4, 0.0, again) == ("plain", None, 3)
    assert asked == ["q", "no Han, please (1)", "no Han, please (2)"]
    asked.clear()
    assert remote.attempt(call, "q", 2, 0.0, again) == (None, "answer turned down", 2)


def test_recognise_and_translate_ask_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    out = extras.recognise(df, "text", lambda t: F.split(t, " "))
    assert {r["id"]: r["entities"] for r in out.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["c"], 4: None}
    known = out.filter("id = 3").select("hash", F.array(F.lit("kept")).alias("entities"))
    assert {r["id"]: r["entities"] for r in extras.recognise(df, "text", lambda t: F.split(t, " "), known).collect()}[3] == ["kept"]
    cached = spark.createDataFrame([("c", "C!")], "text string, translation string")
    seen = []

    def translator(missing):
        seen.extend(r["text"] for r in missing.collect())
        return missing.withColumn("translation", F.upper("text"))

    got = extras.translate_uncached(df.filter("text is not null"), cached, "text", translator)
    assert {r["id"]: r["translation"] for r in got.collect()} == {1: "A B", 2: "A B", 3: "C!"} and seen == ["a b"]


# --- jdbc


def test_scans_push_filters_and_competing_transitions_apply_once(spark):
    db = databases.memory_database(spark)
    db.run(spark, f"CREATE TABLE JOBS ({databases.JOBS}, PRIMARY KEY (ID))")
    assert db.scan(spark, "JOBS", "ID").count() == 0
    rows = spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") % 10).alias("OWNER"), F.when(F.col("id") % 4 == 0, "PENDING").otherwise("DONE").alias("STATUS"), F.lit(1.5).alias("TOTAL"))
    db.append(rows, "JOBS")
    pending = db.scan(spark, "JOBS", "ID", 4).filter("STATUS = 'PENDING' and ID < 500").select("ID")
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(STATUS,PENDING)" in plan.replace("*", "") and pending.rdd.getNumPartitions() == 4
    assert pending.count() == 125
    ids = spark.range(0, 1000, 2).toDF("id")
    with ThreadPoolExecutor(2) as pool:
        moved = list(pool.map(lambda _: db.compare_and_set(ids, "JOBS", "ID", "STATUS", "PENDING", "RUNNING"), range(2)))
    assert sorted(moved) == [0, 250]
    assert db.insert_if_absent(rows.limit(10).unionByName(spark.createDataFrame([(5000, 1, "NEW", 2.0), (5000, 1, "NEW", 2.0)], rows.schema)), "JOBS", "ID", databases.JOBS) == 1
    assert db.upsert(spark.createDataFrame([(0, 7, "X", 9.0), (6000, 7, "X", 9.0)], rows.schema), "JOBS", "ID", databases.JOBS) == 2
    got = {r["ID"]: (r["OWNER"], r["STATUS"], r["TOTAL"]) for r in db.scan(spark, "JOBS").filter("ID in (0, 4, 6000)").collect()}
    assert got == {0: (7, "X", 9.0), 4: (4, "RUNNING", 1.5), 6000: (7, "X", 9.0)}
    with pytest.raises(Exception, match="UNKNOWN_COLUMN|not in any table|column"):
        db.run(spark, "UPDATE JOBS SET STATUS = 'Z'", "UPDATE JOBS SET UNKNOWN_COLUMN = 1")
    assert db.scan(spark, "JOBS").filter("STATUS = 'Z'").count() == 0
    assert isinstance(db, jdbc.Database)


def test_morpheme_scores_bound_their_batches(spark):
    """The query leaves Arrow batches bounded, however many rows a partition has."""
    from pyspark.sql.types import IntegerType

    from loomline.plans import catalog

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    catalog.queries()["morpheme_scores"](spark, "/root/testdata/sf0.001")
    held = F.arrow_udf(lambda a: pa.array([len(a)] * len(a), pa.int32()), IntegerType())
    sizes = spark.range(0, 5000, 1, 1).select(held("id").alias("n")).agg(F.max("n")).first()[0]
    spark.conf.set(name, before)
    assert sizes <= 1000

"""State machines, their ordered fold and their streaming twin; sources and sinks."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomline.sources import readers, sinks
from loomline.streaming import processors, queries, state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def test_decrease_and_increase():
    limits = state.RateLimits(init=20, least=2, most=60)
    s, seen = {}, []
    for _ in range(4):
        s, _ = state.feedback(s, 0, True, 0, limits)
        seen.append(s["rpm"])
    assert seen == [10, 5, 2, 2]
    limits = state.RateLimits(init=10, least=2, most=12, need=3)
    s = {}
    for _ in range(3):
        s, _ = state.feedback(s, 0, False, 0, limits)
    assert s["rpm"] == 11
    for _ in range(6):
        s, _ = state.feedback(s, 0, False, 0, limits)
    assert s["rpm"] == 12


def test_cooldown_blocks():
    limits = state.RateLimits()
    s, cooldown = state.feedback({}, 1000, True, 2000, limits)
    assert cooldown == 2000
    s, granted, wait = state.acquire(s, 2000, limits)
    assert not granted and wait == 1000


def test_sliding_and_daily():
    s, seen = {}, []
    for t in (0, 1000, 2000, 59_999, 60_000, 61_001, 86_400_000):
        s, said = state.sliding_admission(s, t, 2, 4)
        seen.append(said)
    assert seen == ["OK", "OK", "MINUTE", "MINUTE", "OK", "OK", "OK"]
    s, seen = {}, []
    for t in range(3):
        s, said = state.sliding_admission(s, t * 70_000, None, 2)
        seen.append(said)
    assert seen == ["OK", "OK", "DAY"]


def test_breaker_opens_and_closes():
    s, seen = {}, []
    for i in range(12):
        s, said = state.breaker(s, i, i % 2 == 0)
        seen.append(said)
    assert seen[:10] == ["CLOSED"] * 10 and seen[10:] == ["OPEN"] * 2
    assert state.breaker(s, 9 + 30_000, False)[1] == "CLOSED"


def _step(s, row):
    s = {"sum": s.get("sum", 0) + row["v"]}
    return s, {"k": row["k"], "i": row["i"], "sum": s["sum"]}


def test_ordered_fold_is_a_sequential_fold(spark):
    rows = [(k, i, ((i * 7) + (k or 0)) % 5) for k in (None, 1, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = {(r["k"], r["i"]): r["sum"] for r in state.ordered_fold(df, "k", ["i"], _step, "k long, i long, sum long").collect()}
    for k in (None, 1, 2, 3):
        total = 0
        for kk, i, v in rows:
            if kk == k:
                total += v
                assert got[(k, i)] == total
    assert state.ordered_fold(df.limit(0), "k", ["i"], _step, "k long, i long, sum long").count() == 0


def test_stream_twin(spark, tmp_path):
    rows = [(k, i, (i + k) % 5) for k in (1, 2) for i in range(20)]
    spark.createDataFrame(rows, "k long, i long, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, i long, v long").parquet(str(tmp_path / "in"))
    out = processors.stateful(stream, "k", processors.StepProcessor(_step, "i", ["k", "i", "sum"]), "k long, i long, sum long")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = state.ordered_fold(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], _step, "k long, i long, sum long")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("k", "i", "sum").collect())) == sorted(map(tuple, batch.collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"corpus": [{"id": "b", "original": "x"}, {"id": "a", "original": "y"}]}))
    assert [r["id"] for r in readers.json_corpus(spark, str(tmp_path / "c.json")).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "m.json").write_text(json.dumps({"강선": ["1", "1", "2"]}))
    assert readers.json_map(spark, str(tmp_path / "m.json"), "array<string>").first()["value"] == ["1", "1", "2"]
    (tmp_path / "r.jsonl").write_text('{"id":"a","hypothesis":"1"}\nbad\n{"id":"b","error":"e"}\n{"id":"a","hypothesis":"2"}\n')
    lines = readers.json_lines(spark, str(tmp_path / "r.jsonl"), "id string, hypothesis string, error string", "hypothesis")
    assert [(r["id"], r["hypothesis"]) for r in readers.last_per_key(lines, "id").collect()] == [("a", "2")]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "r.jsonl"), "id string, hypothesis string", strict=True).collect()
    (tmp_path / "x.xml").write_text("<corpus><article><translation>가</translation></article><article><translation>나</translation></article></corpus>")
    assert sorted(r["translation"] for r in readers.xml_rows(spark, str(tmp_path / "x.xml"), "article", "translation string").collect()) == ["가", "나"]
    assert sorted(r["translation"] for r in readers.xml_fallback(spark, str(tmp_path / "x.xml"), "translation").collect()) == ["가", "나"]
    (tmp_path / "t.tsv").write_text("# c\n\na\tb\nc\td\n")
    assert readers.rule_table(str(tmp_path / "t.tsv")) == [("a", "b"), ("c", "d")]
    (tmp_path / "e.tsv").write_text("# c\n")
    with pytest.raises(ValueError):
        readers.rule_table(str(tmp_path / "e.tsv"))
    with pytest.raises(ValueError):
        readers.choose("x", {"file": 1})
    with pytest.raises(ValueError):
        readers.slice_rows(spark.range(3), ["id"], 5, 1)
    (tmp_path / "p.csv").write_text("a,b\n1,\n2,x\n")
    assert readers.csv_table(spark, str(tmp_path / "p.csv"), "a int, b string").count() == 2


def test_knowledge_base(spark):
    career = spark.createDataFrame(
        [("p", 2, 1700, "좌랑", "강선", None, 1660, 1720), ("p", 1, None, "참의", "강선", "姜銑", 1660, 1720), ("p", 0, 1700, "좌랑", "강선", "姜銑", 1660, 1720), ("q", 3, None, None, "선", None, 1500, 1550)],
        "person_id string, pos long, year int, office string, hangul string, hanja string, born int, died int",
    )
    people = {r["person_id"]: r for r in readers.person_master(career).collect()}
    assert people["p"]["offices"] == ["좌랑", "참의"] and (people["p"]["active_from"], people["p"]["active_to"]) == (1700, 1700)
    assert (people["q"]["active_from"], people["q"]["active_to"], people["q"]["offices"]) == (1500, 1550, [])
    index = readers.inverted_index(spark.createDataFrame([("p", 0, "강선", "姜銑"), ("q", 1, "선", None)], "person_id string, pos long, hangul string, hanja string"), ["hangul", "hanja"])
    assert [r["person_id"] for r in index.filter("surface = '선'").orderBy("pos").collect()] == ["p", "q"]


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 3.0), (3, "d", 3.0)], "k int, name string, v double")
    assert [r["k"] for r in sinks.insert_if_absent(table, new, ["k"]).collect()] == [3]
    merged = {r["k"]: (r["name"], r["v"]) for r in sinks.upsert(table, new.distinct(), ["k"]).collect()}
    assert merged == {1: ("a", 1.0), 2: ("c", 2.0), 3: ("d", 3.0)}
    path = str(tmp_path / "out")
    assert sinks.resume_append(path, table, "k") == 2
    assert sinks.resume_append(path, new.distinct(), "k") == 1
    sinks.write_versioned(table, str(tmp_path / "cache"), {"kb": "kb-1"})
    assert spark.read.parquet(str(tmp_path / "cache")).filter("kb = 'kb-2'").count() == 0
    done, dead = sinks.split_dead_letters(spark.createDataFrame([(None, "m"), ("TIMEOUT", "x" * 500)], "error_class string, message string"))
    assert done.count() == 1 and len(dead.first()["message"]) == 400
    sinks.write_report(table, str(tmp_path / "report"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "report")).filter(F.col("k") == "1").count() == 1


def test_ingest_skips_what_earlier_batches_brought(spark, tmp_path):
    schema = "id long, t timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.timestamp_seconds(F.col("id")).alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([(2,)], "id long")
    for ts in (None, "t"):
        out, state_dir = str(tmp_path / f"out{ts}"), str(tmp_path / f"c{ts}")
        write([1, 1, 2, 3])
        processors.ingest(stream(), out, state_dir, ["id"], done, ts).awaitTermination()
        write([3, 4])
        processors.ingest(stream(), out, state_dir, ["id"], done, ts).awaitTermination()
        assert sorted(r["id"] for r in spark.read.option("recursiveFileLookup", True).schema(schema).parquet(out).collect()) == [1, 3, 4]


def test_reserved_are_the_first_of_a_day(spark):
    from loomline.streaming.queries import reserved

    rows = [(i, k, f"2024-01-0{1 + i % 2} 00:00:0{i % 3}") for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, k string, t string").select("event_id", "k", F.col("t").cast("timestamp").alias("ts")).repartition(5)
    got = {(r["k"], r["event_id"]) for r in reserved(df, "k", 4).filter("reserved").collect()}
    want = set()
    for k in ("a", None):
        for day in (0, 1):
            want |= {(k, i) for i in sorted((i for i in range(30) if i % 2 == day), key=lambda i: (i % 3, i))[:4]}
    assert got == want and reserved(df.limit(0), "k", 4).count() == 0


def test_milliseconds_round_as_in_sql(spark):
    import duckdb

    some = [0, 499, 500, 501, 1499, 1500, -499, -500, -501, -1500, 1_704_090_635_999_596, 1_704_090_635_999_499]
    df = spark.createDataFrame([(u,) for u in some], "u long").select("u", F.timestamp_micros("u").alias("ts"))
    got = {r["u"]: r["ms"] for r in df.select("u", queries._millis().alias("ms")).collect()}
    c = duckdb.connect()
    assert got == {u: c.execute("select epoch_ms(make_timestamp(?::bigint))", [u]).fetchone()[0] for u in some}


def test_token_bucket_at_a_rounded_millisecond(spark, tmp_path):
    import duckdb

    from loomline.plans import catalog

    # the third event's time rounds up to a multiple of 2160 ms, which changes its wait
    at = [1_704_090_000_000_000, 1_704_090_010_000_000, 1_704_090_635_999_596]
    df = spark.createDataFrame([(k, u, 7, "error") for k, u in enumerate(at)], "event_id long, u long, user_id long, event_type string")
    df.select("event_id", F.timestamp_micros("u").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(catalog.oracle_sql()["token_bucket"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["token_bucket"](spark, str(tmp_path)).collect()) == want

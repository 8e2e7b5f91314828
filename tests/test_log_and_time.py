"""The log and its consumer groups, timers, dense places, the expiring cache: each against a plain loop."""

import glob
import json
import os
import random
from collections import Counter

import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline.operators import cache, order
from loomline.sources import log
from loomline.streaming import consumer, timers

# --- log and groups


def entries(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id"), (F.col("id") % 7).alias("owner"))


def append(spark, path, lo, hi, parts=2):
    log.append_log(entries(spark, lo, hi), path, parts, F.col("owner"), ["id"], F.to_json(F.struct("id", "owner")))


def test_log_keeps_offsets_dense_and_keys_in_order(spark, tmp_path):
    path = f"{tmp_path}/log"
    append(spark, path, 0, 500)
    append(spark, path, 500, 800)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 800
    for part in {r["part"] for r in rows}:
        own = sorted((r["offset"], json.loads(r["body"])["id"]) for r in rows if r["part"] == part)
        assert [o for o, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    owners = {(json.loads(r["body"])["owner"], r["part"]) for r in rows}
    assert len(owners) == 7
    # a file that is missing hides what follows it until it appears
    files = log._Files(path)
    part, ranges = next(iter(files.refresh().items()))
    lost = ranges[0][2]
    os.rename(lost, lost + ".away")
    assert log._Files(path).ends()[part] == ranges[0][0] == 0
    os.rename(lost + ".away", lost)
    assert log._Files(path).ends()[part] == ranges[-1][1]


def judge(fail_at=None):
    """Outcomes of a batch; dies once before it writes the batch that holds entry ``fail_at``."""

    def process(e):
        rows = e.select("part", "offset", F.from_json("body", "id long, owner long").alias("b")).select("part", "offset", "b.id")
        if fail_at is not None and rows.filter(F.col("id") == fail_at).count():
            raise RuntimeError("killed")
        return rows

    return process


def test_a_killed_and_restarted_group_gives_each_entry_once(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    append(spark, path, 0, 600)
    with pytest.raises(Exception, match="killed"):
        consumer.consume(spark, path, "g", judge(fail_at=300), out, f"{tmp_path}/c1", most=60)
    part_done = consumer.outcomes(spark, out).count()
    assert 0 < part_done < 600
    acked = sum(log.acknowledged(path, "g").values())
    assert acked <= part_done
    # the same checkpoint goes on, then another consumer of the group finds nothing to do twice
    consumer.consume(spark, path, "g", judge(), out, f"{tmp_path}/c1", most=60)
    append(spark, path, 600, 700)
    consumer.consume(spark, path, "g", judge(), out, f"{tmp_path}/c2")
    ids = [r["id"] for r in consumer.outcomes(spark, out).select("id").collect()]
    assert sorted(ids) == list(range(700))
    assert sum(log.acknowledged(path, "g").values()) == 700


def test_written_but_unacknowledged_outcomes_are_not_made_again(spark, tmp_path):
    """A run that dies between writing and acknowledging: a new checkpoint rereads its entries, and their outcomes stay single."""
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    append(spark, path, 0, 100)
    consumer.consume(spark, path, "g", judge(), out, f"{tmp_path}/c1")
    os.remove(f"{path}/_groups/g.json")
    consumer.consume(spark, path, "g", judge(), out, f"{tmp_path}/c2")
    assert sorted(r["id"] for r in consumer.outcomes(spark, out).collect()) == list(range(100))
    # another group starts at the beginning
    consumer.consume(spark, path, "h", judge(), f"{tmp_path}/other", f"{tmp_path}/c3")
    assert consumer.outcomes(spark, f"{tmp_path}/other").count() == 100


def test_source_reads_only_the_files_of_a_range(spark, tmp_path):
    path = f"{tmp_path}/log"
    for k in range(4):
        append(spark, path, 100 * k, 100 * k + 100, parts=1)
    reader = log._GroupReader({"path": path, "group": "g", "chunk": "30"})
    ranges = reader.partitions({"0": 120}, {"0": 190})
    assert [(r.lo, r.hi) for r in ranges] == [(120, 150), (150, 180), (180, 190)]
    assert len({f for r in ranges for f in r.files}) < len(ds.dataset(path, format="parquet").files)
    got = [json.loads(x)["id"] for r in ranges for b in reader.read(r) for x in b.column(2).to_pylist()]
    assert got == list(range(120, 190))
    reader.commit({"0": 190})
    reader.commit({"0": 150})
    assert log.acknowledged(path, "g") == {"0": 190}


# --- timers


def plain_redelivery(rows, end, idle, period, most, last):
    """A loop over every tick and event."""
    out, pending = [], {}
    events = sorted(rows)
    tick = timers.next_tick(events[0][0], period) if events else end
    k = 0
    while tick < end or k < len(events):
        if k < len(events) and (events[k][0] < tick or tick >= end):
            ms, _, entry, ack = events[k]
            k += 1
            if ack:
                pending.pop(entry, None)
            else:
                pending[entry] = (ms, 1)
            continue
        for e in sorted(pending)[:most]:
            at, n = pending[e]
            if tick - at > idle:
                out.append((e, n if n >= last else n + 1, tick, n >= last))
                if n >= last:
                    del pending[e]
                else:
                    pending[e] = (tick, n + 1)
        tick += period
    return sorted(out)


def test_redelivery_equals_an_event_loop_however_batches_fall(spark):
    rng = random.Random(2)
    rows, seq = [], 0
    for entry in range(160):
        ms = rng.randrange(0, 900_000)
        rows.append((ms, seq, entry % 2, entry, False))
        if rng.random() < 0.6:
            rows.append((ms + rng.randrange(0, 400_000), seq + 1, entry % 2, entry, True))
        seq += 2
    df = spark.createDataFrame(rows, "ms long, seq long, owner long, entry long, ack boolean")
    end = max(r[0] for r in rows) + 3_600_000
    for batches, most in ((1, 20), (5, 20)):
        got = timers.run_timed(spark, df, "owner", timers.Redelivery(most=most, last=3), "owner bigint, entry bigint, delivery int, at_ms bigint, dead boolean", "t", batches).collect()
        want = [(o, *x) for o in (0, 1) for x in plain_redelivery([(r[0], r[1], r[3], r[4]) for r in rows if r[2] == o], end, 30_000, 60_000, most, 3)]
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert any(x[4] for x in want) and any(x[2] == 2 for x in want)


def plain_pump(total, budget, start, ends, window=3, period=1000):
    """Every tick in turn; ends are times, one call each."""
    out, cursor = [], 0
    for tick in range(timers.next_tick(start + 1, period), max([start, *ends]) + 2 * period, period):
        terminal = sum(e < tick for e in ends)
        if terminal >= total or terminal >= budget:
            return [*out, ("COMPLETED" if terminal >= total else "BUDGET_EXHAUSTED", None, tick)]
        while cursor - terminal < window and cursor < total and cursor < budget:
            out.append(("RELEASED", cursor, tick))
            cursor += 1
    return out


def test_pump_equals_a_loop_over_ticks(spark):
    rng = random.Random(4)
    rows, want = [], []
    for batch in range(12):
        total, budget, start = rng.randrange(1, 9), rng.choice([3, 6, 99]), rng.randrange(5000)
        ends = sorted(start + rng.randrange(1, 20_000) for _ in range(total if batch % 3 else max(0, total - 1)))
        rows.append((start, -1, batch, "start", total, budget, None))
        rows += [(e, k, batch, "end", None, None, 1) for k, e in enumerate(ends)]
        want += [(batch, *x) for x in plain_pump(total, budget, start, ends)]
    df = spark.createDataFrame(rows, "ms long, seq long, batch long, what string, total long, budget long, calls long")
    for batches in (1, 4):
        got = timers.run_timed(spark, df, "batch", timers.Pump(), "batch bigint, what string, place bigint, at_ms bigint", "p", batches).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {w[1] for w in want} == {"RELEASED", "COMPLETED", "BUDGET_EXHAUSTED"}


def test_cache_equals_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(100_000), k, rng.randrange(3), rng.choice("ab"), rng.random() < 0.7, rng.random() < 0.7) for k in range(300)]
    df = spark.createDataFrame(rows, "ms long, seq long, owner long, item string, usable boolean, admitted boolean")
    kept, want = {}, {}
    for ms, seq, owner, item, usable, admitted in sorted(rows):
        there = kept.get((owner, item), 0) > ms
        want[seq] = "HIT" if there and usable else "ABORT" if there else "MISS"
        if want[seq] != "HIT":
            kept.pop((owner, item), None)
            if admitted:
                kept[owner, item] = ms + 4000
    for batches in (1, 4):
        got = cache.run_timed(spark, df, "owner", cache.ExpiringCache(4000), "owner bigint, seq bigint, outcome string", "c", batches).collect()
        assert {r["seq"]: r["outcome"] for r in got} == want
    assert set(want.values()) == {"HIT", "ABORT", "MISS"}


def test_purge_rewrites_only_what_has_expired(spark, tmp_path):
    path = f"{tmp_path}/cache"
    rows = spark.range(3000).select("id", F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("kb"), (F.col("id") / 3).cast("long").alias("expires"))
    rows = rows.withColumn("expires", F.when(F.col("kb") == "v0", F.lit(0)).when(F.col("kb") == "v2", F.lit(9999)).otherwise(F.col("expires")))
    rows.repartition(4).write.partitionBy("kb").parquet(path)
    size = lambda v: sum(os.path.getsize(os.path.join(path, f"kb={v}", f)) for f in os.listdir(f"{path}/kb={v}")) if os.path.isdir(f"{path}/kb={v}") else 0
    files = lambda v: sorted(f for f in os.listdir(f"{path}/kb={v}") if f.endswith("parquet"))
    before, untouched = size("v1"), files("v2")
    report = {r["kb"]: (r["before"], r["after"]) for r in cache.purge(spark, path, ["kb"], "expires", F.lit(800), F.lit(False)).collect()}
    assert report == {"v0": (1000, 0), "v1": (1000, 199), "v2": (1000, 1000)}
    assert size("v0") == 0 and size("v1") < before and files("v2") == untouched
    left = spark.read.schema("id long, expires long, kb string").parquet(path)
    assert sorted(r["id"] for r in left.collect()) == sorted(i for i in range(3000) if i % 3 == 2 or i % 3 == 1 and i // 3 > 800)


def test_counters_come_from_the_run_that_writes(spark, tmp_path):
    rows, seen = cache.counted(spark.range(100), {"even": F.col("id") % 2 == 0, "big": F.col("id") >= 90})
    rows.write.parquet(f"{tmp_path}/out")
    assert {r["metric"]: r["n"] for r in cache.counter_rows(spark, seen).collect()} == {"even": 50, "big": 10}
    spark.range(30).write.parquet(f"{tmp_path}/in1")
    listener = cache.StreamCounters("seen")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in*").observe("seen", F.count_if(F.col("id") % 3 == 0).alias("third"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
        assert listener.totals == {"third": 10}
    finally:
        spark.streams.removeListener(listener)


# --- places


def test_dense_order_with_ties_and_gaps(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 5, 5, 5, rng.randrange(10**9)]), k * 17) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(7)
    got = {r["id"]: r["place"] for r in order.dense_order(df, ["k", "id"]).collect()}
    want = {i: p for p, (_, _, i) in enumerate(sorted((k is not None, k or 0, i) for k, i in rows))}
    assert got == want
    assert order.dense_order(df.limit(0), ["k"]).count() == 0


def test_misaligned_needs_all_names_in_one_neighbour(spark):
    texts = ["김류 강선", "x", "이원익", "김류", "강선", "y"]
    names = [[], ["김류", "강선"], ["이원익", "강선"], ["강선"], ["이원익"], []]
    df = spark.createDataFrame([(10 * i, i, n, t) for i, (n, t) in enumerate(zip(names, texts, strict=True))], "id long, place long, names array<string>, text string")
    got = {r["id"] for r in order.misaligned(df, "place", "names", "text").collect()}
    want = set()
    for i, n in enumerate(names):
        miss = [x for x in n if x not in texts[i] and x[1:] not in texts[i] or (len(x) < 3 and x not in texts[i])]
        if miss and any(all(x in texts[j] for x in miss) for j in range(max(0, i - 2), min(6, i + 3)) if j != i):
            want.add(10 * i)
    assert got == want and 10 in want


def test_prefix_repeats(spark):
    keys = ["a", "b", "a", None, "c", "b", None, "a", "d"]
    df = spark.createDataFrame(list(enumerate(keys)), "place long, k string")
    got = {r["size"]: (r["n"], r["repeats"]) for r in order.prefix_repeats(df, "place", "k", F.array(*[F.lit(s).cast("long") for s in (1, 3, 6, 9)])).collect()}
    for s in (1, 3, 6, 9):
        some = [k for k in keys[:s] if k]
        assert got[s] == (len(some), len(some) - len(Counter(some)))


def test_a_table_folds_as_its_stream_runs(spark):
    """Batch and stream share their steps: a hot key over several Arrow batches, keys without a due tick, a row that only moves the time."""
    rng = random.Random(8)
    rows = [(rng.randrange(0, 600_000), 2 * k + a, 0 if k % 4 else k % 7, k, bool(a)) for k in range(300) for a in (0, 1) if not a or rng.random() < 0.5]
    df = spark.createDataFrame([*rows, (700_000, None, 3, None, None)], "ms long, seq long, owner long, entry long, ack boolean")
    schema = "owner bigint, entry bigint, delivery int, at_ms bigint, dead boolean"
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted(tuple(r) for r in timers.fold_timed(df, "owner", timers.Redelivery(most=20, last=3), schema).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sorted(tuple(r) for r in timers.run_timed(spark, df, "owner", timers.Redelivery(most=20, last=3), schema, "t").collect()) and len(got) > 100
    assert timers.fold_timed(df.limit(0), "owner", timers.Redelivery(), schema).count() == 0


def test_pump_of_a_table_equals_a_loop_over_ticks(spark):
    rng = random.Random(5)
    rows, want = [], []
    for batch in range(12):
        total, budget, start = rng.randrange(1, 9), rng.choice([3, 6, 99]), rng.randrange(5000)
        ends = sorted(start + rng.randrange(1, 20_000) for _ in range(total if batch % 3 else max(0, total - 1)))
        rows.append((start, -1, batch, "start", total, budget, None))
        rows += [(e, k, batch, "end", None, None, 1) for k, e in enumerate(ends)]
        want += [(batch, *x) for x in plain_pump(total, budget, start, ends)]
    df = spark.createDataFrame(rows, "ms long, seq long, batch long, what string, total long, budget long, calls long")
    got = timers.fold_timed(df, "batch", timers.Pump(), "batch bigint, what string, place bigint, at_ms bigint").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_a_reader_takes_few_entries_at_a_time(spark, tmp_path):
    """A part far larger than a row group: groups are bounded in bytes, ranges meet few of them, and each entry is read once."""
    body = F.concat(*[F.sha2((F.col("id") * 7 + k).cast("string"), 512) for k in range(4)])
    log.append_log(spark.range(40_000), f"{tmp_path}/log", 1, F.lit(0), ["id"], body)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/log/part=0/*.parquet")]
    assert max(f.metadata.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 3 * log.GROUP_BYTES
    assert sum(f.num_row_groups for f in files) >= 5
    reader = log._GroupReader({"path": f"{tmp_path}/log", "group": "g", "chunk": "15001"})
    batches = [b for r in reader.partitions({}, reader.latestOffset()) for b in reader.read(r)]
    assert [o for b in batches for o in b.column(1).to_pylist()] == list(range(40_000)) and max(b.num_rows for b in batches) <= 10_000

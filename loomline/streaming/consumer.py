"""Consumer groups over a log: an entry counts as done once its outcome is written, and then only once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.registry import load, query
from loomline.sources import log, sinks


def consume(spark: SparkSession, path: str, group: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most: int = 0) -> None:
    """Read what the group hasn't finished, batch by batch, until the log's end, and write ``process(entries)`` (with part and offset) to ``out``.

    A batch writes a folder of its own, which a replay from the same checkpoint overwrites. A consumer with a new checkpoint
    starts at the group's acknowledged position and skips entries that another run's outcomes hold already, so each has one
    outcome however often runs die between writing and acknowledging. Only outcomes from that position on are looked at.
    """
    run = "r" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = batch.persist()
        done = outcomes(spark, out)
        if done is not None:
            since = [(F.col("part") == int(p)) & (F.col("offset") < n) for p, n in log.acknowledged(path, group).items()]
            done = done.filter(~((F.col("run") == run) & (F.col("batch") >= batch_id)))
            done = done.filter(~reduce(lambda a, b: a | b, since)) if since else done
            entries = entries.join(done.select("part", "offset"), ["part", "offset"], "left_anti")
        process(entries).write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")
        log.acknowledge(path, group, {str(r["part"]): r["end"] for r in batch.groupBy("part").agg((F.max("offset") + 1).alias("end")).collect()})
        batch.unpersist()

    stream = log.read_group(spark, path, group, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()


def outcomes(spark: SparkSession, out: str) -> DataFrame | None:
    """All outcomes with their run and batch; None where nothing was written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.option("basePath", out).parquet(out)


def skip_terminal(entries: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Entries whose job has no outcome yet, one a job: what a redelivered or doubled entry leaves to do."""
    todo = entries.dropDuplicates([key])
    return todo if done is None else todo.join(done.select(key), key, "left_anti")


# --- queries


@query("log_redelivered", "SELECT event_id AS id, event_type = 'error' AS dead FROM events")
def log_redelivered(spark, d):
    """Every event is in the log twice, the second time after all first ones; a job that has its outcome, good or dead, is skipped."""
    base = sinks.scratch(spark, "log")
    path, out = f"{base}/log", f"{base}/outcomes"
    events = load(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("dead")))

    def work(entries: DataFrame) -> DataFrame:
        jobs = entries.select("part", "offset", F.from_json("body", "id bigint, dead boolean").alias("e")).select("part", "offset", "e.*")
        return skip_terminal(jobs, outcomes(spark, out), "id")

    for _ in range(2):
        log.append_log(events, path, 3, F.col("user_id"), ["ts", "event_id"], body)
        consume(spark, path, "workers", work, out, f"{base}/checkpoint")
    return outcomes(spark, out).select("id", "dead")


@query(
    "log_consume",
    """SELECT 'event' AS kind, event_id AS id, user_id AS owner, event_type = 'error' AS failed FROM events UNION ALL SELECT 'order', o_orderkey, o_custkey, o_orderstatus = 'P' FROM orders""",
)
def log_consume(spark, d):
    """Events, then orders go into a log of two parts; one consumer of a group reads the first lot in small batches, another goes on after its position."""
    base = sinks.scratch(spark, "log")
    path, out = f"{base}/log", f"{base}/outcomes"

    def judged(entries: DataFrame) -> DataFrame:
        e = F.from_json("body", "kind string, id bigint, owner bigint, status string")
        return entries.select("part", "offset", e.alias("e")).select("part", "offset", "e.kind", "e.id", "e.owner", F.col("e.status").isin("error", "P").alias("failed"))

    def body(kind: str, key: str, owner: str, status: str):
        return F.to_json(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(owner).alias("owner"), F.col(status).alias("status")))

    events, orders = load(spark, d, "events"), load(spark, d, "orders")
    log.append_log(events, path, 2, F.col("user_id"), ["ts", "event_id"], body("event", "event_id", "user_id", "event_type"))
    consume(spark, path, "judges", judged, out, f"{base}/first", most=max(1, events.count() // 4))
    log.append_log(orders, path, 2, F.col("o_custkey"), ["o_orderdate", "o_orderkey"], body("order", "o_orderkey", "o_custkey", "o_orderstatus"))
    consume(spark, path, "judges", judged, out, f"{base}/second")
    return outcomes(spark, out).select("kind", "id", "owner", "failed")

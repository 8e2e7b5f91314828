"""Stateful operators over events in time order, and a stream read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.plans.registry import load, query
from loomline.sources import sinks

from . import processors, state


def _millis(column: str = "ts"):
    """Milliseconds since 1970, rounded half away from zero as the SQL's epoch_ms does."""
    us = F.unix_micros(F.col(column).cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def stream_ingest(spark, d):
    """The events file read as a stream to its end, events of finished jobs skipped, the rest appended once."""
    base = sinks.scratch(spark, "stream")
    done = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    events = load(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    processors.ingest(stream, f"{base}/out", f"{base}/checkpoint", ["event_id"], done, ts="ts").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "event_type")


@query(
    "tenant_daily_charge",
    """SELECT event_id, sum(calls) OVER w <= 20 AS accepted FROM (SELECT *, 1 + event_id % 3 AS calls, strftime(ts, '%Y-%m-%d') AS day FROM events) WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def tenant_daily_charge(spark, d):
    """A charge stands when the day's running total, refused charges included, stays within the limit. A window holds one tenant's day."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", (1 + F.col("event_id") % 3).alias("calls"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", (F.sum("calls").over(w) <= 20).alias("accepted"))


_RESERVE_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k FROM events)"


def reserved(df: DataFrame, key: str, limit: int) -> DataFrame:
    """``reserved``: among the first ``limit`` of its key and day. A refused reservation is rolled back, so ranks decide.

    A task ranks no more than its own first ``limit`` rows of a key and day; all rows are then compared with the last one reserved.
    """
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    at = F.struct("ts", "event_id")
    first = df.select(F.col(key).alias("_key"), day.alias("_day"), at.alias("_at")).withColumn("_k", F.row_number().over(Window.partitionBy("_key", "_day").orderBy("_at"))).filter(F.col("_k") <= limit)
    last = first.groupBy("_key", "_day").agg(F.max("_at").alias("_last"))
    out = df.join(last, F.col(key).eqNullSafe(F.col("_key")) & day.eqNullSafe(F.col("_day")), "left")
    return out.withColumn("reserved", F.coalesce(at <= F.col("_last"), F.lit(False))).drop("_key", "_day", "_last")


@query("quota_reserve", f"WITH {_RESERVE_SQL} SELECT event_id, k <= 10 AS reserved FROM r")
def quota_reserve(spark, d):
    return reserved(load(spark, d, "events"), "event_type", 10).select("event_id", "reserved")


@query("quota_allocate", f"WITH {_RESERVE_SQL} SELECT event_id, CASE WHEN event_type = 'purchase' AND k <= 5 THEN 'upper' ELSE 'base' END AS model, event_type = 'purchase' AND k > 5 AS downgraded FROM r")
def quota_allocate(spark, d):
    """Hard rows (purchases) take the upper model while it has quota for the day, else the base one."""
    rows = reserved(load(spark, d, "events"), "event_type", 5)
    hard = F.col("event_type") == "purchase"
    return rows.select("event_id", F.when(hard & F.col("reserved"), "upper").otherwise("base").alias("model"), (hard & ~F.col("reserved")).alias("downgraded"))


@query(
    "quality_promotion",
    "SELECT event_id, CASE WHEN value < 20 AND user_id % 4 <> 0 THEN round(value * 2, 6) ELSE value END AS value, value < 20 AS retried FROM events",
)
def quality_promotion(spark, d):
    """A rejected result (value under 20) is tried once more by the upper model; where that fails (every fourth user) the first stays."""
    again = F.when((F.col("value") < 20) & (F.col("user_id") % 4 != 0), F.round(F.col("value") * 2, 6))
    return load(spark, d, "events").select("event_id", F.coalesce(again, F.col("value")).alias("value"), (F.col("value") < 20).alias("retried"))


_LIMITS = state.RateLimits()


def _bucket_step(s: dict, row: dict) -> tuple[dict, dict]:
    s, granted, wait = state.acquire(s, row["ms"], _LIMITS)
    if granted:
        s, _ = state.feedback(s, row["ms"], row["event_type"] == "error", 0, _LIMITS)
    return s, {"event_id": row["event_id"], "granted": granted, "wait_ms": int(wait), "rpm": float(s["rpm"])}


# The folds as recursions over each key's k-th event: state as columns, the next event joined at every step.
_BUCKET_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM (SELECT *, CAST(floor(epoch_ms(ts) / 2160) AS BIGINT) AS ms FROM events)),
r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS granted, 0::BIGINT AS wait_ms, 20::DOUBLE AS rpm, (20 * 10 / 60)::DOUBLE AS tokens, ms AS ts, 0::BIGINT AS until, 0 AS streak FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, granted, CASE WHEN ms < until THEN until - ms WHEN granted THEN 0 ELSE ceil((1 - full_to) * 60000 / rpm) END::BIGINT, new_rpm, CASE WHEN slowed THEN 0 WHEN granted THEN full_to - 1 ELSE full_to END,
CASE WHEN slowed THEN ms + pause ELSE seen END, CASE WHEN slowed THEN ms + pause ELSE until END, CASE WHEN slowed OR (granted AND streak >= 2) THEN 0 WHEN granted THEN streak + 1 ELSE streak END
FROM (SELECT *, CASE WHEN slowed THEN greatest(2, floor(rpm * 0.5)) WHEN granted AND streak >= 2 THEN least(60, rpm + 1) ELSE rpm END AS new_rpm, ceil(60000 / greatest(2, floor(rpm * 0.5)))::BIGINT AS pause
FROM (SELECT *, granted AND event_type = 'error' AS slowed FROM (SELECT *, ms >= until AND full_to >= 1 AS granted
FROM (SELECT e.user_id, e.k, e.event_id, e.event_type, e.ms, r.rpm, r.until, r.streak, greatest(e.ms, r.ts) AS seen, CASE WHEN e.ms > r.ts THEN least(greatest(1, r.rpm * 10 / 60), r.tokens + (e.ms - r.ts) * r.rpm / 60000) ELSE r.tokens END AS full_to
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))))
SELECT event_id, granted, wait_ms, rpm FROM r WHERE k > 0"""


@query("token_bucket", _BUCKET_SQL)
def token_bucket(spark, d):
    """Adaptive token bucket per user over events compressed in time (a day to 40 s); errors throttle, others feed the increase."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(_millis() / 2160).alias("ms"))
    return state.ordered_fold(e, "user_id", ["ms", "event_id"], _bucket_step, "event_id long, granted boolean, wait_ms long, rpm double")


def _sliding_step(s: dict, row: dict) -> tuple[dict, dict]:
    s, said = state.sliding_admission(s, row["ms"], 3, 40)
    return s, {"event_id": row["event_id"], "admitted": said}


_SLIDING_SQL = """WITH RECURSIVE e AS (SELECT event_id, event_type, ms, ms // 86400000 AS day, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) AS k FROM (SELECT *, CAST(floor(epoch_ms(ts) / 100) AS BIGINT) AS ms FROM events)),
r AS (SELECT DISTINCT event_type, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS admitted, 0::BIGINT AS day, 0 AS n, []::BIGINT[] AS log FROM e
UNION ALL SELECT event_type, k, event_id, CASE WHEN n >= 40 THEN 'DAY' WHEN len(log) >= 3 THEN 'MINUTE' ELSE 'OK' END, day, CASE WHEN n < 40 AND len(log) < 3 THEN n + 1 ELSE n END, CASE WHEN n < 40 AND len(log) < 3 THEN list_append(log, ms) ELSE log END
FROM (SELECT e.event_type, e.k, e.event_id, e.ms, e.day, CASE WHEN r.day = e.day THEN r.n ELSE 0 END AS n, list_filter(r.log, lambda t: t > e.ms - 60000) AS log FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1))
SELECT event_id, admitted FROM r WHERE k > 0"""


@query("sliding_admission", _SLIDING_SQL)
def sliding_admission(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", F.floor(_millis() / 100).alias("ms"))
    return state.ordered_fold(e, "event_type", ["ms", "event_id"], _sliding_step, "event_id long, admitted string")


def _breaker_step(s: dict, row: dict) -> tuple[dict, dict]:
    failed = None if row["event_type"] == "signup" else row["event_type"] in ("error", "click", "purchase")
    s, said = state.breaker(s, row["ms"], failed)
    return s, {"event_id": row["event_id"], "circuit": said}


_BREAKER_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'signup' THEN (event_type IN ('error', 'click', 'purchase'))::INT END AS failed, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM (SELECT *, CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) AS ms FROM events)),
r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS circuit, []::INT[] AS last, 0::BIGINT AS until FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, CASE WHEN ms < until THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN ms >= until AND trips THEN [] ELSE seen END, CASE WHEN ms < until THEN until WHEN trips THEN ms + 30000 ELSE 0 END
FROM (SELECT *, len(seen) = 10 AND list_sum(seen) >= 5 AS trips FROM (SELECT e.user_id, e.k, e.event_id, e.ms, r.until, CASE WHEN e.ms < r.until OR e.failed IS NULL THEN r.last ELSE list_append(r.last, e.failed)[-10:] END AS seen
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT event_id, circuit FROM r WHERE k > 0"""


@query("circuit_breaker", _BREAKER_SQL)
def circuit_breaker(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(_millis() / 1000).alias("ms"))
    return state.ordered_fold(e, "user_id", ["ms", "event_id"], _breaker_step, "event_id long, circuit string")


@query(
    "ttl_cache",
    """WITH p AS (SELECT user_id, ts AS stored_at FROM events WHERE event_type = 'purchase') SELECT e.event_id, EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND p.stored_at < e.ts AND p.stored_at > e.ts - INTERVAL 3 DAY) AS hit FROM events e WHERE event_type = 'view'""",
)
def ttl_cache(spark, d):
    """A view hits if its user's latest purchase before it is under three days old: one ordered pass per user and no range join."""
    e = load(spark, d, "events")
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.withColumn("us", ms)
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).over(w)
    rows = rows.withColumn("last", last).filter("event_type = 'view'")
    return rows.select("event_id", F.coalesce(F.col("last") > F.col("us") - 3 * 86_400_000_000, F.lit(False)).alias("hit"))


@query(
    "batch_pump",
    """WITH o AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS flying FROM orders GROUP BY 1),
    k AS (SELECT *, greatest(0, least(3 - flying, total - done - flying, 8 - done - flying)) AS k FROM o), j AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT o_custkey, o_orderkey FROM j JOIN k USING (o_custkey) WHERE pos >= done + flying AND pos < done + flying + k""",
)
def batch_pump(spark, d):
    """Next jobs of each batch: from its cursor, as many as the window of three, the rest of the batch and the budget of eight allow."""
    o = load(spark, d, "orders")
    sums = o.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("flying"))
    at = F.col("done") + F.col("flying")
    k = F.greatest(F.lit(0), F.least(3 - F.col("flying"), F.col("total") - at, 8 - at))
    jobs = o.select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"))
    jobs = jobs.filter(F.col("pos") < 8)  # no cursor passes the budget: of a large batch no task ranks more
    return jobs.join(sums, "o_custkey").filter((F.col("pos") >= at) & (F.col("pos") < at + k)).select("o_custkey", "o_orderkey")

"""A result cache as tables and state: what a request finds, what expires, what a purge leaves, and counters of the run itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomline.plans.registry import load, query
from loomline.sources import sinks
from loomline.streaming.timers import Timed, fold_timed, run_timed  # noqa: F401

from .order import dense_order
from .replay import replay

DAY_MS = 86_400_000


# --- expiry


def request(entries: dict[str, int], key: str, at: int, usable: bool, admitted: bool, ttl: int) -> str:
    """HIT, ABORT or MISS; ``entries`` (key -> when it expires) is changed.

    A stored value that can't be used any more is dropped, so that it doesn't cost again; after that and after a miss the new
    value is stored if it is admitted.
    """
    there = entries.get(key, at) > at
    if there and usable:
        return "HIT"
    entries.pop(key, None)
    if admitted:
        entries[key] = at + ttl
    return "ABORT" if there else "MISS"


class ExpiringCache(Timed):
    """Rows have ms, seq, item, usable and admitted. State: a map of item to expiry; a timer drops what has expired."""

    def __init__(self, ttl: int, clock: str = "event"):
        self.ttl, self.clock = ttl, clock

    def init(self, handle) -> None:
        self.handle = handle
        # by the machine's clock the store drops entries itself, even of keys that no row comes for
        self.entries = handle.getMapState("entries", "item string", "expires bigint", self.ttl if self.clock == "processing" else None)

    def _fresh(self):
        return {"entries": {}, "kept": {}}

    def _load(self):
        kept = {k[0]: v[0] for k, v in self.entries.iterator()}
        return {"entries": dict(kept), "kept": kept}

    def _store(self, state) -> None:
        for k in state["kept"].keys() - state["entries"].keys():
            self.entries.removeKey((k,))
        for k, v in state["entries"].items():
            if state["kept"].get(k) != v:
                self.entries.updateValue((k,), (v,))

    def _next(self, state):
        return min(state["entries"].values(), default=None) if self.clock == "event" else None

    def _run(self, state, upto):
        for k in [k for k, v in state["entries"].items() if v <= upto]:
            del state["entries"][k]
        return []

    def _take(self, state, row):
        return [(row["seq"], request(state["entries"], row["item"], row["ms"], row["usable"], row["admitted"], self.ttl))]

    def _row(self, key, out) -> Row:
        return Row(owner=key[0], seq=out[0], outcome=out[1])


_CACHE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS item, value < 80 AS usable, event_type <> 'error' AS admitted, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, item, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS expires FROM e
UNION ALL SELECT e.user_id, e.item, e.k, e.event_id, CASE WHEN r.expires <= e.ms THEN 'MISS' WHEN e.usable THEN 'HIT' ELSE 'ABORT' END, CASE WHEN r.expires > e.ms AND e.usable THEN r.expires WHEN e.admitted THEN e.ms + 432000000 ELSE 0 END
FROM r JOIN e ON e.user_id = r.user_id AND e.item = r.item AND e.k = r.k + 1)
SELECT user_id AS owner, event_id AS seq, outcome FROM r WHERE k > 0"""


@query("cache_outcomes", _CACHE_SQL)
def cache_outcomes(spark, d):
    """Each event asks its user's cache for its type: entries live five days, a value of 80 or more finds its entry unusable, errors aren't stored."""
    e = load(spark, d, "events")
    rows = e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), F.col("user_id").alias("owner"), F.col("event_type").alias("item"), F.coalesce(F.col("value") < 80, F.lit(False)).alias("usable"), (F.col("event_type") != "error").alias("admitted"))
    return fold_timed(rows, "owner", ExpiringCache(5 * DAY_MS), "owner bigint, seq bigint, outcome string")


# --- purge


def purge(spark: SparkSession, path: str, versions: list[str], expires: str, now: Column, current: Column) -> DataFrame:
    """Delete what has expired from a cache table partitioned by its versions; gives (versions, before, after) a partition.

    A partition without live rows goes, unless it is of a ``current`` version; one with some is written anew without the expired
    ones, through a staged copy that then replaces it in one commit. Others aren't touched. The driver sees one row a version.
    """
    table = spark.read.parquet(path)
    live = F.coalesce(F.col(expires) > now, F.lit(False))
    per = table.groupBy(*versions).agg(F.count("*").alias("before"), F.count_if(live).alias("after"), F.max(current).alias("_current")).collect()
    spared = [r for r in per if 0 < r["after"] < r["before"]]
    if spared:
        which = spark.createDataFrame([tuple(r[v] for v in versions) for r in spared], table.select(*versions).schema)
        stage = sinks.scratch(spark, "purged")
        table.filter(live).join(F.broadcast(which), versions, "left_semi").write.partitionBy(*versions).parquet(stage)
        staged = spark.read.schema(table.schema).parquet(stage)
        staged.repartition(*versions, F.pmod(F.xxhash64(expires), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*versions).parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in per:
        if r["after"] == 0 and not r["_current"]:
            where = fs_path("/".join([path, *[f"{v}={r[v]}" for v in versions]]))
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return spark.createDataFrame([(*[r[v] for v in versions], r["before"], r["after"]) for r in per], [*versions, "before", "after"])


@query(
    "cache_purge",
    """WITH c AS (SELECT sale_id, status AS kb, priority AS prompt, sold_at + INTERVAL 30 DAY AS expires FROM sales WHERE sold_at IS NOT NULL AND status IS NOT NULL AND priority IS NOT NULL)
    SELECT kb, prompt, count(*) AS entries FROM c WHERE expires > TIMESTAMP '2024-04-15' GROUP BY ALL""",
)
def cache_purge(spark, d):
    """Sales as entries that live thirty days, under versions of two kinds; what a purge in April leaves on disk."""
    path = sinks.scratch(spark, "cache")
    rows = load(spark, d, "sales").filter("sold_at is not null and status is not null and priority is not null")
    rows.select("sale_id", F.col("status").alias("kb"), F.col("priority").alias("prompt"), F.expr("sold_at + interval 30 days").alias("expires")).write.partitionBy("kb", "prompt").parquet(path)
    purge(spark, path, ["kb", "prompt"], "expires", F.expr("timestamp_ntz'2024-04-15 00:00:00'"), F.lit(False))
    return spark.read.schema("sale_id bigint, expires timestamp_ntz, kb string, prompt int").parquet(path).groupBy("kb", "prompt").agg(F.count("*").alias("entries"))


# --- counters


def counted(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` that counts for how many rows each condition holds while it is written, and where the counts will be; no second pass."""
    seen = Observation()
    return df.observe(seen, *[F.count_if(c).alias(n) for n, c in counters.items()]), seen


def counter_rows(spark: SparkSession, seen: Observation) -> DataFrame:
    """(metric, n) once the run is over."""
    return spark.createDataFrame(sorted((k, v) for k, v in seen.get.items()), "metric string, n bigint")


class StreamCounters(StreamingQueryListener):
    """Sums of the counters called ``name`` that a stream's batches observe (``df.observe(name, ...)``)."""

    def __init__(self, name: str):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None: ...
    def onQueryIdle(self, event) -> None: ...
    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for k, v in (row.asDict() if row else {}).items():
            self.totals[k] = self.totals.get(k, 0) + v


def click_items(spark, d) -> DataFrame:
    """Clicks in order of time as requests: the properties are the text, their digits its slots."""
    c = load(spark, d, "clicks").select("ts", "click_id", "kind", "value", "props")
    rows = dense_order(c, ["ts", "click_id", "props", "kind", "value"], "pos")
    grade = F.when(F.coalesce("value", F.lit(0.0)) < 5, "REJECTED").when(F.col("value") < 20, "DEGRADED").otherwise("VERIFIED")
    masked = F.regexp_replace("props", "[0-9]+", "#")
    return rows.select("pos", F.md5(F.coalesce("props", F.lit(""))).alias("l1_key"), F.when(masked != F.col("props"), F.md5(masked)).alias("template_hash"), grade.alias("grade"), (F.col("kind") != "error").alias("stores"))


@query(
    "observed_replay",
    """WITH items AS (SELECT row_number() OVER (ORDER BY ts NULLS FIRST, click_id NULLS FIRST, props NULLS FIRST, kind NULLS FIRST, value NULLS FIRST) - 1 AS pos, md5(coalesce(props, '')) AS k, CASE WHEN regexp_replace(props, '[0-9]+', '#', 'g') <> props THEN md5(regexp_replace(props, '[0-9]+', '#', 'g')) END AS th,
      CASE WHEN coalesce(value, 0) < 5 THEN 'REJECTED' WHEN value < 20 THEN 'DEGRADED' ELSE 'VERIFIED' END AS grade, kind <> 'error' AS stores FROM clicks),
    r AS (SELECT *, min(pos) FILTER (grade <> 'REJECTED') OVER (PARTITION BY k) AS a FROM items), r1 AS (SELECT *, coalesce(pos > a, false) AS hit FROM r),
    r2 AS (SELECT *, min(pos) FILTER (th IS NOT NULL AND NOT hit AND stores AND grade = 'VERIFIED') OVER (PARTITION BY th) AS p0 FROM r1), r3 AS (SELECT *, CASE WHEN th IS NOT NULL THEN p0 END AS p FROM r2),
    o AS (SELECT *, CASE WHEN coalesce(pos > p, false) AND coalesce(a <= p, false) THEN 'L1' WHEN coalesce(pos > p, false) THEN 'L2' WHEN hit THEN 'L1' ELSE 'LLM' END AS outcome FROM r3)
    SELECT unnest(['cache.hit.L1', 'cache.hit.L2', 'cache.miss', 'gate.DEGRADED', 'gate.REJECTED', 'gate.VERIFIED']) AS metric,
      unnest([count(*) FILTER (outcome = 'L1'), count(*) FILTER (outcome = 'L2'), count(*) FILTER (outcome = 'LLM'), count(*) FILTER (grade = 'DEGRADED'), count(*) FILTER (grade = 'REJECTED'), count(*) FILTER (grade = 'VERIFIED')]) AS n FROM o""",
)
def observed_replay(spark, d):
    """A replay of the clicks through both cache levels is written; the counters come from that run. Templates do meet here, so all three outcomes occur."""
    outcome = {f"cache.{name}": F.col("outcome") == value for name, value in (("hit.L1", "L1"), ("hit.L2", "L2"), ("miss", "LLM"))}
    grades = {f"gate.{g}": F.col("grade") == g for g in ("VERIFIED", "DEGRADED", "REJECTED")}
    rows, seen = counted(replay(click_items(spark, d)), outcome | grades)
    rows.write.parquet(sinks.scratch(spark, "replayed"))
    return counter_rows(spark, seen)

"""Enrichment by a remote service: bounded calls in flight, retries with backoff, and answers that are kept."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.shipping import ship

ANSWER = "key string, answer string, error string, attempts int"


class Transient(Exception):
    """A failure that may pass: it is tried again. Any other exception is final."""


def post_json(url: str, timeout: float = 10) -> Callable[[str], str]:
    """A call that posts the request's JSON text and gives the response's text; 429, 5xx and connection errors are transient."""

    def call(body: str) -> str:
        asked = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Transient(f"HTTP {e.code}") from e
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Transient(str(e)) from e

    return call


def attempt(call: Callable[[str], str], request: str, attempts: int, wait_s: float, again: Callable[[str], str | None]) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts). Transient failures wait ``wait_s`` doubled each time; ``again`` may turn an answer down by giving the next request."""
    error = None
    for n in range(1, attempts + 1):
        try:
            answer = call(request)
        except Transient as e:
            error = str(e)
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:400], n
        else:
            changed = again(answer)
            if changed is None:
                return answer, None, n
            request, error = changed, "answer turned down"
        if n < attempts:
            time.sleep(wait_s * 2 ** (n - 1))
    return None, (error or "")[:400], attempts


def _ask(batches: Iterator[pa.RecordBatch], call, in_flight: int, attempts: int, wait_s: float, again) -> Iterator[pa.RecordBatch]:
    names = ["key", "answer", "error", "attempts"]

    def batch(rows: list) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    with ThreadPoolExecutor(in_flight) as pool:
        open_: dict = {}
        for b in batches:
            done: list = []
            for key, request in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                while len(open_) >= in_flight:
                    for f in wait(open_, return_when=FIRST_COMPLETED).done:
                        done.append((open_.pop(f), *f.result()))
                open_[pool.submit(attempt, call, request, attempts, wait_s, again)] = key
            yield batch(done)
        yield batch([(key, *f.result()) for f, key in open_.items()])


def _accept(_: str) -> None:
    return None


def enrich(requests: DataFrame, call: Callable[[str], str], kept: str, in_flight: int = 8, attempts: int = 2, wait_s: float = 2.0, again: Callable[[str], str | None] = _accept, rounds: int = 8, tasks: int | None = None) -> DataFrame:
    """(key, answer, error, attempts) for ``requests`` (key, request string); a key is asked once, however often it occurs.

    An answer may be empty; a failure has no answer but an error. Answers are kept in the table ``kept`` and never asked for
    again, over calls and runs; failures are asked again by the next call. Work goes in ``rounds``, each kept when it is over, so
    that a lost task or a run that dies asks again for its round only. All tasks together have ``tasks`` x ``in_flight`` calls open.
    """
    spark = requests.sparkSession
    ship(spark)
    wanted = requests.filter("key is not null").groupBy(F.col("key").cast("string").alias("key")).agg(F.min("request").alias("request"))
    n = tasks or spark.sparkContext.defaultParallelism
    for k in range(rounds):
        todo = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        known = kept_answers(requests, kept)
        todo = todo.join(known.select("key"), "key", "left_anti") if known is not None else todo
        asked = todo.repartition(n, "key").select("key", "request").mapInArrow(lambda b: _ask(b, call, in_flight, attempts, wait_s, again), ANSWER)
        asked.write.mode("append").parquet(kept)
    rows = spark.read.schema(ANSWER).parquet(kept)
    # a key that failed before it was answered has rows of either kind
    best = F.max(F.struct(F.col("error").isNull().alias("good"), "attempts", "answer", "error"))
    return wanted.select("key").join(rows.groupBy("key").agg(best.alias("b")), "key").select("key", "b.answer", "b.error", "b.attempts")


def kept_answers(like: DataFrame, kept: str) -> DataFrame | None:
    """The answers kept so far, without failures."""
    spark = like.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(ANSWER).parquet(kept).filter("error is null").dropDuplicates(["key"])


def entities_request(text: str, min_score: float) -> str:
    return json.dumps({"text": text, "min_score": min_score})

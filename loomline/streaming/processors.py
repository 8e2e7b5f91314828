"""Streaming twins: the step functions behind transformWithState, ingestion, retries and dead letters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.functions import routing


class StepProcessor(StatefulProcessor):
    """A state machine per key: rows of a micro-batch go through ``step`` by their ``order`` column; state is one JSON value with a time to live."""

    def __init__(self, step: Callable[[dict, dict], tuple[dict, dict]], order: str, fields: list[str], ttl_ms: int | None = None):
        self.step, self.order, self.fields, self.ttl_ms = step, order, fields, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", "json string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = json.loads(self.value.get()[0]) if self.value.exists() else {}
        for row in sorted((r.asDict() for r in rows), key=lambda r: r[self.order]):
            state, out = self.step(state, row)
            yield Row(**{f: out[f] for f in self.fields})
        self.value.update((json.dumps(state),))

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StepProcessor, schema: str, mode: str = "None") -> DataFrame:
    """Needs the RocksDB state store provider; keys are spread over the shuffle partitions."""
    return stream.groupBy(key).transformWithState(processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], terminal: DataFrame | None = None, ts: str | None = None, late: str = "1 day"):
    """At-least-once consumption made idempotent: a micro-batch appends the rows whose key is neither done nor was seen before.

    Seen keys are state, so a batch costs what it holds, whatever was written earlier; with ``ts`` only those of the last ``late`` are
    kept. A batch writes a folder of its own and overwrites it when replayed from the checkpoint.
    """
    fresh = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if ts else stream.dropDuplicates(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if terminal is None else batch.join(terminal.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_failures(stream: DataFrame, done_path: str, dead_path: str, checkpoint: str, message: str = "message", delivery: str = "delivery"):
    """Each failed row gets its class and outcome; dead letters go to a place of their own with their message cut."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("error_class", routing.error_class(F.col(message))).withColumn("outcome", routing.failure_outcome(F.col("error_class"), F.col(delivery)))
        dead = rows.filter("outcome.dead_letter").withColumn(message, F.substring(message, 1, 400))
        rows.filter("not outcome.dead_letter").write.mode("overwrite").parquet(f"{done_path}/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts per UTC day and key; the watermark bounds the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), *keys).count()

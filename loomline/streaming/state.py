"""Keyed state machines as pure step functions: state and event in, state and outcome out.

The same steps run over batches (ordered_fold) and over streams (StepProcessor).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.functions.shipping import ship


@dataclass(frozen=True)
class RateLimits:
    """Bounds of an adaptive rate limit, in requests a minute."""

    init: float = 20
    least: float = 2
    most: float = 60
    burst_s: float = 10
    factor: float = 0.5
    need: int = 3
    step: float = 1


def acquire(state: dict, now_ms: int, limits: RateLimits) -> tuple[dict, bool, int]:
    """Token bucket: (state, granted, wait in ms). A cooldown is a hard wait; tokens refill with the time since the last look."""
    rpm = max(limits.least, min(limits.most, state.get("rpm", limits.init)))
    cap = max(1.0, rpm * limits.burst_s / 60)
    tokens, ts, until = state.get("tokens", cap), state.get("ts", now_ms), state.get("cooldown_until", 0)
    if now_ms > ts:
        tokens, ts = min(cap, tokens + (now_ms - ts) * rpm / 60000), now_ms
    granted, wait = False, 0
    if now_ms < until:
        wait = until - now_ms
    elif tokens >= 1:
        tokens, granted = tokens - 1, True
    else:
        wait = math.ceil((1 - tokens) * 60000 / rpm)
    return state | {"rpm": rpm, "tokens": tokens, "ts": ts, "cooldown_until": until}, granted, wait


def feedback(state: dict, now_ms: int, throttled: bool, hint_ms: int, limits: RateLimits) -> tuple[dict, int]:
    """Additive increase after enough successes, multiplicative decrease and a cooldown on a throttle: (state, cooldown in ms)."""
    rpm = max(limits.least, min(limits.most, state.get("rpm", limits.init)))
    if throttled:
        rpm = max(limits.least, math.floor(rpm * limits.factor))
        cooldown = hint_ms if hint_ms > 0 else math.ceil(60000 / rpm)
        return state | {"rpm": rpm, "tokens": 0.0, "ts": now_ms + cooldown, "cooldown_until": now_ms + cooldown, "streak": 0}, cooldown
    streak = state.get("streak", 0) + 1
    if streak >= limits.need:
        rpm, streak = min(limits.most, rpm + limits.step), 0
    return state | {"rpm": rpm, "streak": streak}, 0


def sliding_admission(state: dict, now_ms: int, per_minute: int | None, per_day: int | None) -> tuple[dict, str]:
    """OK, MINUTE or DAY: at most so many admitted in the last 60 s and in the UTC day; only the admitted count."""
    day = now_ms // 86_400_000
    count = state.get("count", 0) if state.get("day") == day else 0
    log = [t for t in state.get("log", []) if t > now_ms - 60_000]
    kept = {"day": day, "count": count, "log": log}
    if per_day is not None and count >= per_day:
        return kept, "DAY"
    if per_minute is not None and len(log) >= per_minute:
        return kept, "MINUTE"
    return {"day": day, "count": count + 1, "log": [*log, now_ms]}, "OK"


def breaker(state: dict, now_ms: int, failed: bool | None, window: int = 10, share: float = 0.5, open_ms: int = 30_000) -> tuple[dict, str]:
    """CLOSED or OPEN for this call: opens when the last ``window`` counted outcomes hold ``share`` failures; None is ignored."""
    if now_ms < state.get("open_until", 0):
        return state, "OPEN"
    last = list(state.get("last", []))
    if failed is not None:
        last = [*last, failed][-window:]
    if len(last) == window and sum(last) >= share * window:
        return {"last": [], "open_until": now_ms + open_ms}, "CLOSED"
    return {"last": last, "open_until": 0}, "CLOSED"


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Callable[[dict, dict], tuple[dict, dict]], schema: str) -> DataFrame:
    """Rows folded per key in order: ``step(state, row)`` gives the next state and the output row.

    Keys are dealt by hash and sorted within the partition, and rows stream through with one key's state in memory: no
    group is gathered, however many rows a key has.
    """
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, first = {}, None, True
        for b in batches:
            out = []
            for row in b.to_pylist():
                if first or row[key] != last:
                    state, last, first = {}, row[key], False
                state, result = step(state, row)
                out.append(result)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], arrow.field(n).type) for n in names], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

"""Sum-of-squares online packing of token sequences into windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release, small_batches, texts_of
from .fasttok import MOST_PIECES, piece_encoder


class SumOfSquares:
    """Open windows by fill level; a piece goes where the sum over levels of the squared number of open windows grows least.

    ``gain[h]`` is the change when a window leaves level h (infinite without one; level 0 is a new window) and
    ``cost[h]`` when one arrives; a full window is closed and counts no more. Ties go to the lowest level.
    """

    def __init__(self, size: int):
        self.size = size
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.gain = np.full(size + 1, np.iinfo(np.int64).max // 4)
        self.gain[0] = 0
        self.cost = np.ones(size + 1, np.int64)
        self.cost[size] = 0

    def _count(self, h: int) -> None:
        n = len(self.open[h])
        self.gain[h] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.cost[h] = 2 * n + 1

    def place(self, length: int, piece) -> list | None:
        """Put a piece in; gives back the window if that fills it."""
        h = int(np.argmin(self.gain[: self.size - length + 1] + self.cost[length:]))
        window = []
        if h:
            window = self.open[h].pop()
            self._count(h)
        window.append(piece)
        if h + length == self.size:
            return window
        self.open[h + length].append(window)
        self._count(h + length)
        return None

    def rest(self) -> list[tuple[int, list]]:
        """(fill, window) of the windows still open, fullest first."""
        return [(h, w) for h in range(self.size, 0, -1) for w in self.open[h]]


def close_up(rest: list[tuple[int, list]], size: int) -> list[list]:
    """Fill the fullest windows with pieces of the emptiest, cutting pieces as needed: at most one window stays partial."""
    fills, windows = [f for f, _ in rest], [list(w) for _, w in rest]
    i, j = 0, len(windows) - 1
    while i < j:
        gap = size - fills[i]
        if not gap:
            i += 1
        elif not windows[j]:
            j -= 1
        else:
            doc, start, length = windows[j].pop()
            take = min(gap, length)
            windows[i].append((doc, start, take))
            fills[i] += take
            fills[j] -= take
            if take < length:
                windows[j].append((doc, start + take, length - take))
    return [w for w in windows if w]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, key: str = "doc_id", text: str = "text", most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``. Whole windows of a long document are sequences of their own; what is left of
    each document is placed by sum of squares among its task's open windows, and the windows open at the end fill one
    another, so each task pads one window at most. Nothing is shuffled: a task packs its own partition, in key order,
    and a task run anew gives the same rows. Only open windows are held. A null or empty text is its end id; repeated
    rows are packed each; a null key stays null; a very long text is cut into windows; an empty table gives an empty
    result; extra columns are ignored. A worker remembers the ids of ``most_pieces`` pieces of text; fewer take less memory
    and more time, and give the same rows.
    """
    small_batches(docs.sparkSession, size="1m")

    def run(batches):
        release()
        encoder = piece_encoder(tokenizer, False, most_pieces)
        end = np.array([end_id], "<u4").tobytes()
        packer, task = SumOfSquares(size), TaskContext.get().partitionId()
        rows: list[tuple] = []
        made = 0

        def emit(window):
            nonlocal made
            offset, sequence = 0, (task << 32) + made
            made += 1
            for (doc, ids, shift, total), start, length in window:
                rows.append((doc, start, length, zlib.crc32(ids[4 * (start - shift) : 4 * (start - shift + length)]), total, sequence, offset))
                offset += length

        def flush():
            out = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else []
            rows.clear()
            return dict(zip((c.split()[0] for c in _SCHEMA.split(", ")), out, strict=True)) if out else None

        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.encode(texts_of(b["text"])), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    emit([((doc, ids, 0, total), start, size)])
                if whole < total:
                    if window := packer.place(total - whole, ((doc, ids[4 * whole :], whole, total), whole, total - whole)):
                        emit(window)
            if out := flush():
                yield out
        for window in close_up(packer.rest(), size):
            emit(window)
        if out := flush():
            yield out

    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(body.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"), run, _SCHEMA)

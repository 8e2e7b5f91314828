"""Exact deduplication by Grace hashing.

Records are dealt by hash over the cluster and, inside a task, recursively into spill files until a bucket fits an
open-addressing table that compares complete contents. Before the shuffle each task merges equal texts in a bounded
table of the same kind, so a text that a third of all rows share is sent once per task and flush, not once per row.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, fresh_names, map_batches, saved, small_batches

_HEAD = struct.Struct("<Qqqqi")
_NONE = -(1 << 63)  # a null id sorts below all others


class OpenTable:
    """Open addressing with linear probing over a power of two of slots; a slot holds 1 + an entry's number, 0 if free."""

    def __init__(self, bits: int = 8):
        self.slots = [0] * (1 << bits)
        self.mask = (1 << bits) - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.counts: list[int] = []
        self.tops: list[int] = []
        self.at_top: list[int] = []
        self.bytes = 0

    def add(self, h: int, digest: bytes, content: bytes, n: int, top: int, at_top: int) -> None:
        at = h & self.mask
        while k := self.slots[at]:
            if self.hashes[k - 1] == h and self.contents[k - 1] == content:
                k -= 1
                self.counts[k] += n
                if top > self.tops[k]:
                    self.tops[k], self.at_top[k] = top, at_top
                elif top == self.tops[k]:
                    self.at_top[k] += at_top
                return
            at = (at + 1) & self.mask
        self.hashes.append(h)
        self.contents.append(content)
        self.digests.append(digest)
        self.counts.append(n)
        self.tops.append(top)
        self.at_top.append(at_top)
        self.bytes += len(content) + 300
        self.slots[at] = len(self.hashes)
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [0] * (2 * len(self.slots))
        self.mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at]:
                at = (at + 1) & self.mask
            self.slots[at] = k + 1

    def entries(self) -> Iterator[tuple]:
        return zip(self.hashes, self.digests, self.contents, self.counts, self.tops, self.at_top, strict=True)


def grace(records: Iterable[tuple], budget: int, fan_bits: int = 4, depth: int = 0, folder: str | None = None) -> Iterator[tuple]:
    """Merge (hash, digest, content, n, top, at_top) records of equal content, with at most ``budget`` bytes of contents in memory.

    A bucket over the budget is split by the next ``fan_bits`` bits of the hash into spill files, each merged the same
    way. When the bits are used up, the rest differs in content but not in hash, and stays in one table.
    """
    table, files, made = OpenTable(), None, None
    shift = 64 - fan_bits * (depth + 1)
    try:
        for r in records:
            if files is None:
                table.add(*r)
                if table.bytes <= budget or shift < 0 or len(table.hashes) < 2:
                    continue
                made = folder or tempfile.mkdtemp(prefix="grace-")
                files = [open(os.path.join(made, f"{depth}-{r[0] >> shift if depth else 0}-{i}-{id(table)}"), "w+b", buffering=1 << 16) for i in range(1 << fan_bits)]  # noqa: SIM115
                for e in table.entries():
                    _spill(files, e, shift, fan_bits)
                table = OpenTable()
            else:
                _spill(files, r, shift, fan_bits)
        if files is None:
            yield from table.entries()
            return
        for f in files:
            f.seek(0)
            yield from grace(_unspill(f), budget, fan_bits, depth + 1, made)
            f.close()
            os.unlink(f.name)
    finally:
        for f in files or ():
            if not f.closed:
                f.close()
                os.unlink(f.name)
        if made and made != folder:
            os.rmdir(made)


def _spill(files: list, r: tuple, shift: int, bits: int) -> None:
    h, digest, content, n, top, at_top = r
    f = files[(h >> shift) & ((1 << bits) - 1)]
    f.write(_HEAD.pack(h, n, top, at_top, len(content)))
    f.write(digest)
    f.write(content)


def _unspill(f) -> Iterator[tuple]:
    while head := f.read(_HEAD.size):
        h, n, top, at_top, size = _HEAD.unpack(head)
        digest = f.read(32)
        yield h, digest, f.read(size), n, top, at_top


_CLASS = "digest binary, content binary, n long, top long, at_top long"


def _rows(entries: Iterable[tuple], most_bytes: int = 1 << 24) -> Iterator[dict]:
    out, size = [], 0
    for e in entries:
        out.append(e[1:])
        size += len(e[2]) + 64
        if size >= most_bytes or len(out) >= 20000:
            yield _columns(out)
            out, size = [], 0
    if out:
        yield _columns(out)


def _columns(rows: list[tuple]) -> dict:
    d, c, n, t, a = zip(*rows, strict=True)
    return {"digest": pa.array(d, pa.binary()), "content": pa.array(c, pa.binary()), "n": pa.array(n, pa.int64()), "top": pa.array(t, pa.int64()), "at_top": pa.array(a, pa.int64())}


def content_classes(docs: DataFrame, content: Column, key: str = "doc_id", budget: int = 48 << 20) -> DataFrame:
    """One row per distinct content: digest (SHA-256), n (rows), top (largest key, null if all are null), at_top (rows with that key)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), content.alias("content"), F.unhex(F.sha2(content, 256)).alias("digest"))

    def combine(batches):
        table = OpenTable()
        for b in batches:
            for k, c, d in zip(b["k"].to_pylist(), b["content"].to_pylist(), b["digest"].to_pylist(), strict=True):
                table.add(int.from_bytes(d[:8], "big"), d, c, 1, _NONE if k is None else k, 1)
                if table.bytes > budget:
                    yield from _rows(table.entries())
                    table = OpenTable()
        yield from _rows(table.entries())

    def merge(batches):
        records = (
            (int.from_bytes(d[:8], "big"), d, c, n, t, a)
            for b in batches
            for d, c, n, t, a in zip(*(b[x].to_pylist() for x in ("digest", "content", "n", "top", "at_top")), strict=True)
        )
        for out in _rows(grace(records, budget)):
            yield out | {"content": pa.nulls(len(out["digest"]), pa.binary())}

    partial = map_batches(rows, combine, _CLASS)
    merged = map_batches(partial.repartition("digest"), merge, _CLASS)
    return merged.select("digest", "n", F.when(F.col("top") != _NONE, F.col("top")).alias("top"), "at_top")


def _body(text: str, normalise) -> Column:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.encode(normalise(body) if normalise else body, "UTF-8")


def _checked_classes(docs: DataFrame, body: Column, key: str, budget: int) -> tuple[DataFrame, int]:
    """Saved classes, known to have a digest each of their own, and the number of all rows."""
    classes = saved(content_classes(docs, body, key, budget), "classes")
    doubled = classes.agg(F.count("*").alias("classes"), F.count_distinct("digest").alias("digests"), F.sum("n").alias("n")).first()
    if doubled["classes"] != doubled["digests"]:
        raise ValueError("two different texts have one SHA-256 digest")
    return classes, doubled["n"] or 0


def keep_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=None, budget: int = 48 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts, that with the largest key (nulls lowest).

    Rows are met with the classes' digests and keys, a row at most for each class; rows that repeat both are one, and of a
    group without any key one row stays. A null text counts as empty; very long texts are compared whole; an empty table
    stays empty; columns may have any names.
    """
    body = _body(text, normalise)
    classes, _ = _checked_classes(docs, body, key, budget)
    digest, own, top = fresh_names(docs, "digest", "own", "top")
    stay = classes.select(F.col("digest").alias(digest), F.col("top").alias(top), F.col("at_top"))
    rows = docs.withColumn(digest, F.unhex(F.sha2(body, 256))).withColumn(own, F.col(key).cast("long"))
    named = stay.filter(F.col(top).isNotNull())
    # the larger key alone tells most rows apart, so a group's rows are spread by key
    kept = rows.join(named, (rows[own] == named[top]) & (rows[digest] == named[digest]), "left_semi")
    if stay.filter(F.col(top).isNull() | (F.col("at_top") > 1)).limit(1).count():
        nameless = stay.filter(F.col(top).isNull())
        kept = kept.unionByName(rows.filter(F.col(own).isNull()).join(nameless, digest, "left_semi")).dropDuplicates([digest])
    return kept.drop(digest, own)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=None, budget: int = 48 << 20) -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column before comparing (default: no change); a null text counts as empty. The row with
    the largest key stays; repeated rows of that key and text are one document and all count as kept. Rows with a null
    key lose to any other; if a whole group has none, its rows have a null keep_id and are kept. Very long texts are
    one record each. An empty table gives an empty result; extra columns are ignored.
    """
    body = _body(text, normalise)
    classes, total = _checked_classes(docs, body, key, budget)
    rows = docs.select(F.col(key), F.unhex(F.sha2(body, 256)).alias("digest"))
    out = attach_by_key(rows, classes, "digest", "n", total)
    return out.select(
        key,
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col(key).cast("long").eqNullSafe(F.col("top")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

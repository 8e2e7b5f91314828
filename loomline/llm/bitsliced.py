"""Exact top-k search by inner product over a bit-sliced index.

Components are whole numbers floor(scale * x). A block of at most 2^16 vectors is indexed as bitmaps: slice (d, b) has a bit for
each vector whose component d, shifted to be positive, has bit b. A query's scores are bitmaps too, made by adding the slices of
each dimension at the places of the bits of the query's component, through carry-save adders over 64 vectors a word; a negative
component adds complements. The best rows of a block come from the most significant slice downward; rows equal at the boundary
are resolved by vec_id. All arithmetic is on whole numbers, so scores are exact.

The index is a table of blocks. Queries are blocks of ``QUERIES`` rows; each pair of blocks is a row of an equi join, and a
task hands on the k best of each query and pair only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, map_batches, small_batches

#: Vectors of an index block, and queries of a query block.
ROWS, QUERIES = 1 << 16, 256
#: Largest size of a whole component: 2^20. Larger ones raise an error, as sums might pass 63 bits.
LIMIT = 1 << 20


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>), a row a vec_id; rows with a null id, a null vector or a null or non-finite component are left out.

    Of rows that repeat a vec_id the one with the least array counts.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.min(whole).alias("v"))


def _matrix(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(sizes, default=0)), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    if out.size and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT}")
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def build_block(ids: np.ndarray, v: np.ndarray) -> dict:
    """Bit slices of vectors in ascending order of id: ``slices`` has shape (dims, bits, words); components are shifted by ``low``."""
    low = int(v.min(initial=0))
    shifted = (v - low).T
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    slices = np.stack([_words((shifted >> b) & 1 == 1) for b in range(bits)], axis=1) if v.shape[1] else np.zeros((0, bits, -(-len(ids) // 64)), np.uint64)
    return {"ids": ids, "low": low, "slices": slices}


def _add_up(weighted: dict[int, list[np.ndarray]]) -> None:
    """Carry-save adders: of each weight's bitmaps three become one of that weight and one of the next, until two are left at most."""
    w = min(weighted, default=0)
    while w <= max(weighted, default=-1):
        stack = weighted.setdefault(w, [])
        while len(stack) > 2:
            a, b, c = stack.pop(), stack.pop(), stack.pop()
            half = a ^ b
            stack.insert(0, half ^ c)
            weighted.setdefault(w + 1, []).append(a & b | half & c)
        w += 1


def score_slices(block: dict, flipped: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(score bitmaps from the least significant on, what to add to their number) of one query against a block."""
    slices, low = block["slices"], block["low"]
    dims, bits, words = slices.shape
    q = np.pad(q, (0, max(0, dims - len(q))))[:dims]
    top = (1 << bits) - 1
    grouped: dict[int, list[np.ndarray]] = {}
    for d in np.flatnonzero(q):
        from_, size = (slices, int(q[d])) if q[d] > 0 else (flipped, -int(q[d]))
        for b in range(size.bit_length()):
            if size >> b & 1:
                grouped.setdefault(b, []).append(from_[d])
    _add_up(grouped)  # all slices of a dimension at once
    single: dict[int, list[np.ndarray]] = {}
    for w, stack in grouped.items():
        for wide in stack:
            for b in range(bits):
                single.setdefault(w + b, []).append(wide[b])
    _add_up(single)
    # the last two bitmaps of each weight, by rippling the carry
    out, carry = [], None
    for w in range(max(single, default=-1) + 1):
        stack = single.get(w, []) + ([] if carry is None else [carry])
        carry = None
        if len(stack) == 3:
            half = stack[0] ^ stack[1]
            out.append(half ^ stack[2])
            carry = stack[0] & stack[1] | half & stack[2]
        elif len(stack) == 2:
            out.append(stack[0] ^ stack[1])
            carry = stack[0] & stack[1]
        else:
            out.append(stack[0] if stack else np.zeros(words, np.uint64))
    if carry is not None:
        out.append(carry)
    positive, negative = int(q[q > 0].sum()), int(-q[q < 0].sum())
    # q * v is q * (u + low) for q > 0 and |q| * (top - u) - |q| * (top + low) for q < 0
    return out, positive * low - negative * (top + low)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(scores: list[np.ndarray], there: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among the rows of ``there`` (all, if fewer), ties at the boundary to the smaller place."""
    sure, tied, found = np.zeros_like(there), there, 0
    for s in reversed(scores):
        ones = tied & s
        n = _count(ones)
        if found + n > k:
            tied = ones
        else:
            sure, found, tied = sure | ones, found + n, tied & ~s
            if found == k:
                break
    return np.concatenate([_places(sure), _places(tied)[: k - found]])


def top_of_block(block: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in a block, in no order; a query's own vec_id is no candidate."""
    ids, flipped = block["ids"], ~block["slices"]
    there = _words(np.ones(len(ids), bool))
    out: list[tuple] = []
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        scores, shift = score_slices(block, flipped, q)
        others, own = there, np.searchsorted(ids, qid)
        if own < len(ids) and ids[own] == qid:
            others = there.copy()
            others[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        at = select_top(scores, others, k)
        value = np.zeros(len(at), np.int64)
        for w, s in enumerate(scores):
            value += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        out.append((np.full(len(at), qid), ids[at], value + shift))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def build_index(vectors: DataFrame, parts: int) -> DataFrame:
    """The index as a table of blocks (block long, ids, slices binary, low long, bits, dims int); every row of ``vectors`` is in one."""

    def blocks(batches: Iterator[dict]):
        parts_ = [(b["vec_id"].to_numpy(), _matrix(b["v"])) for b in batches]
        if not parts_:
            return
        dims = max(v.shape[1] for _, v in parts_)
        ids = np.concatenate([i for i, _ in parts_])
        v = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for _, v in parts_])
        order = np.argsort(ids, kind="stable")
        for k, lo in enumerate(range(0, len(ids), ROWS)):
            own = order[lo : lo + ROWS]
            b = build_block(ids[own], v[own])
            number = TaskContext.get().partitionId() + k * parts
            yield {"block": pa.array([number], pa.int64()), "ids": pa.array([b["ids"].astype("<i8").tobytes()], pa.binary()), "slices": pa.array([b["slices"].tobytes()], pa.binary()), "low": pa.array([b["low"]], pa.int64()), "bits": pa.array([b["slices"].shape[1]], pa.int32()), "dims": pa.array([dims], pa.int32())}

    return map_batches(vectors.repartition(parts), blocks, "block long, ids binary, slices binary, low long, bits int, dims int")


def exact_top_k(vectors: DataFrame, query: F.Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which ``query`` holds, its k highest inner products with all other rows.

    Ties go to the smaller vec_id; all others, if fewer than k. Vectors of unlike length are filled up with zeros; see
    ``usable`` for what takes no part. An empty table gives no rows, other columns are ignored. The number of pairs is queries
    times rows, as any exact search over all rows; blocks bound what a task holds, and each pair of blocks is independent.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    rows = tables.keep(tables.save(usable(vectors, scale), "vectors"))
    index = tables.keep(tables.save(build_index(rows, max(1, -(-rows.count() * 9 // (8 * ROWS)))), "slices"))
    asked = rows.filter(query)
    groups = max(1, -(-asked.count() // QUERIES))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    asked = asked.groupBy(number.alias("group")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    last = index.agg(F.max("block")).first()[0] or 0
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    left, right = index.withColumn("group", upto(groups - 1)), asked.withColumn("block", upto(last))
    pairs = left.join(right.hint("merge"), ["group", "block"]).select("ids", "slices", "low", "bits", "dims", "queries")

    def best(batches: Iterator[dict]):
        for b in batches:
            for i in range(len(b["low"])):
                ids = np.frombuffer(b["ids"][i].as_py(), "<i8")
                dims, bits = b["dims"][i].as_py(), b["bits"][i].as_py()
                slices = np.frombuffer(b["slices"][i].as_py(), np.uint64).reshape(dims, bits, -1 if dims else -(-len(ids) // 64))
                some = b["queries"].slice(i, 1).flatten()
                found = top_of_block({"ids": ids, "low": b["low"][i].as_py(), "slices": slices}, some.field(0).to_numpy(), _matrix(some.field(1)), k)
                yield {n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)}

    found = map_batches(pairs, best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact n-gram Jaccard join over size-banded tiles with bitmap bounds.

Documents are sets of word shingles; equal sets are one class, known by its smallest document. A pair at or over the
threshold has sizes in one band tile and differs in at most D shingles, D being known for the tile. Each set is cut by
hash into D + slack parts; a differing shingle spoils one part, so such a pair agrees in at least ``slack`` parts, and in
one that isn't empty if either set has fewer than ``slack`` empty parts. A set that has more is cut again under the next
seed, until it has fewer. Documents that agree in a part of a tile are candidates; bit counts of hashed bitmaps bound
their overlap from above, and what passes is decided by intersecting the sorted shingle arrays.

Candidates form stars, not all pairs: within a block of a task, then over all blocks, a part's documents are compared
with its first one. Documents of parts where such a comparison fails and its ends stay in different components are joined
once more by prefixes of their rarest shingles, which finds every other pair that can reach the threshold, so
components are exact.

Shingles and bitmaps are made from the texts where these lie, only for the documents a step needs; what is shuffled is
part keys, pairs, and the bitmaps or shingles of the documents of pairs that are still possible.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, attach_by_key, connected_components, fresh_names, map_batches, saved, small_batches, texts_of
from .textvec import mix, shingle_sets

_U = np.uint64
_BAND = 0.7
_SEEDS = 64
#: Part keys of a document, about: keys' bits and partitions are chosen by it.
_KEYS = 256
#: Words of the sketch of a set: 64 bits each, flipped by each of its shingles.
_WORDS = 4
#: Slices of the rounds that come before all pairs are compared: a component's likeliest pairs in a round, at most.
_ROUNDS = (1, 8, 64)


class Tiles:
    """Size bands and the numbers of parts, for a threshold of ``num`` / ``den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def of(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(tile, parts, slack) of each tile that a set of ``size`` belongs to: its own band's, and larger ones whose least size it can match."""
        out, low, k = [], 1, 0
        while low * self.num <= size * self.den:
            high = max(low, int(low / _BAND))
            if high >= size:
                differ = 2 * high * (self.den - self.num) // (self.den + self.num)
                parts = self._parts(differ, -(-low * self.num // self.den))
                out.append((k, parts, parts - differ))
            low, k = high + 1, k + 1
        return tuple(out)

    @staticmethod
    def _parts(differ: int, least: int) -> int:
        """The least number of parts of which sets of the tile's ``least`` size mostly fill more than ``differ``."""
        if not differ:
            return 1
        parts = differ + 1
        while parts < 4 * (differ + 1):
            empty = math.exp(-least / parts)
            spread = math.sqrt(parts * empty * max(0.0, 1 - (1 + least / parts) * empty))
            if parts * (1 - empty) - spread >= differ + 1:
                break
            parts += max(1, parts // 50)
        return parts


def part_keys(flat: np.ndarray, lens: np.ndarray, tile: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each part that isn't empty, its set, number of such parts of each set) of sets of hashes, ascending in each set."""
    doc = np.repeat(np.arange(len(lens)), lens)
    part = ((flat >> _U(32)) * parts.astype(_U)[doc]) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))))
    sums = np.add.reduceat(mix(flat ^ _U(0x5851F42D4C957F2D)), starts)
    where = part[starts] + tile.astype(_U)[doc[starts]] * _U(0xDA942042E4DD58B5) + _U(seed) * _U(0x2545F4914F6CDD1D)
    return mix(mix(where) + sums), doc[starts], np.bincount(doc[starts], minlength=len(lens))


def all_keys(sets: list[np.ndarray], tiles: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) over all tiles and seeds; the sets aren't empty."""
    keys, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    work = [(i, *t) for i, s in enumerate(sets) for t in tiles.of(len(s))]
    for seed in range(_SEEDS):
        if not work:
            break
        again = []
        at = 0
        while at < len(work):  # in portions, as very long texts have many shingles
            size, end = 0, at
            while end < len(work) and (end == at or size < 1 << 19):
                size += len(sets[work[end][0]])
                end += 1
            some = work[at:end]
            lens = np.array([len(sets[w[0]]) for w in some])
            flat = np.concatenate([sets[w[0]] if not seed else np.sort(mix(sets[w[0]] + _U(seed))) for w in some])
            number, tile, parts, slack = (np.array(c) for c in zip(*some, strict=True))
            k, d, full = part_keys(flat, lens, tile, parts, seed)
            keys.append(k)
            owners.append(number[d])
            again += [w for w, e, s in zip(some, parts - full, slack, strict=True) if e >= s]
            at = end
        work = again
    for number, tile, _, _ in work:  # two sets that leave too many parts empty under every seed meet by each shingle they share
        keys.append(mix(sets[number] + _U(_SEEDS + tile) * _U(0x2545F4914F6CDD1D)))
        owners.append(np.full(len(sets[number]), number))
    return np.concatenate(keys), np.concatenate(owners)


def bitmap(s: np.ndarray) -> bytes:
    """A hashed bitmap whose width, a power of two of at least 64 bits, is twice the set's size or more."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """At most so many shingles are in both sets: each bit that differs stands for one at least in just one of them."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def _enough(both, na, nb, num: int, den: int):
    return den * both >= num * (na + nb - both)


def _bounds(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray) -> np.ndarray:
    """``overlap_bound`` of many pairs, those of like widths at once."""
    out = np.zeros(len(a), np.int64)
    widths = np.array([len(x) << 32 | len(y) for x, y in zip(a, b, strict=True)], np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        x, y = (np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1) for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
        out[at] = (na[at] + nb[at] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """64-bit words in which each shingle flips one bit: where two sets' sketches differ, a shingle is in just one of them."""
    odd = np.bincount(((s >> _U(8)) % _U(64 * _WORDS)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class _Block:
    """The part keys of a block of documents; equal sets send their keys once."""

    def __init__(self, tiles: Tiles, bits: int):
        self.tiles, self.bits, self.seen, self.keys, self.docs, self.size = tiles, bits, set(), [], [], 0

    def add(self, ids: list[int], sets: list[np.ndarray]) -> None:
        new = []
        for i, s in enumerate(sets):
            if (g := _digest(s)) not in self.seen:
                self.seen.add(g)
                new.append(i)
        if new:
            k, d = all_keys([sets[i] for i in new], self.tiles)
            self.keys.append(k >> _U(64 - self.bits))
            self.docs.append(np.array([ids[i] for i in new], np.int64)[d])
            self.size += len(k)

    def flush(self, most: int = 1 << 16) -> Iterator[dict]:
        """A row a key: (key, doc); further documents of the key in this block come as (key, doc, hub)."""
        if self.keys:
            keys, docs = np.concatenate(self.keys), np.concatenate(self.docs)
            self.__init__(self.tiles, self.bits)
            order = np.lexsort((docs, keys))
            keys, docs = keys[order].view(np.int64), docs[order]
            del order
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            hub = docs[first][np.cumsum(first) - 1]
            keep = np.flatnonzero(first | (hub != docs))
            keep = keep[np.argsort(docs[keep], kind="stable")]  # a document's rows together are smaller on disk
            for i in range(0, len(keep), most):
                at = keep[i : i + most]
                yield {"key": pa.array(keys[at]), "doc": pa.array(docs[at]), "hub": pa.array(hub[at], mask=first[at])}


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if not column.null_count else column.fill_null(-(1 << 62)).to_numpy()


def _sizes(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc, n, digest of the set) of every row."""

    def read(batches):
        for b in batches:
            sets = shingle_sets(texts_of(b["_text"]), shingle)
            yield {"doc": b["_key"], "n": pa.array([len(s) for s in sets], pa.int32()), "digest": pa.array([_digest(s) for s in sets], pa.binary())}

    return map_batches(rows, read, "doc long, n int, digest binary")


def _part_members(rows: DataFrame, reps: DataFrame, count: int, shingle: int, tiles: Tiles, block: int) -> DataFrame:
    """(key, doc, hub): the documents of each part that more than one of ``reps`` has, each with the part's first document.

    Copies of a representative are left out where they lie, but for the few that the broadcast bits let pass; those are
    in its class anyway. Keys are cut to as many bits as keep chance meetings rare among so many; those only cost a comparison.
    The number of partitions follows the number of keys, as they compress so well that partitions of a size in bytes hold many.
    """
    shared, width = _bloom(reps, count)
    partitions = min(1 << 16, max(1, -(-_KEYS * count >> 19)))
    bits = min(64, max(32, 2 * int(_KEYS * count).bit_length() - 10))

    def emit(batches):
        held = _Block(tiles, bits)
        for b in batches:
            ids, some = _passing(b["_key"], shared.value, width)
            sets = shingle_sets(texts_of(b["_text"].take(pa.array(some))), shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            held.add([int(ids[some[i]]) for i in full], [sets[i] for i in full])
            if held.size >= block:
                yield from held.flush()
        yield from held.flush()

    def gather(batches):
        key, hub = None, None
        for b in batches:
            settled = np.asarray(b["hub"].is_valid())
            if settled.any():
                at = pa.array(np.flatnonzero(settled))
                yield {c: v.take(at) for c, v in b.items()}
            if not settled.all():
                at = pa.array(np.flatnonzero(~settled))
                keys, docs = b["key"].take(at).to_numpy(), b["doc"].take(at).to_numpy()
                first = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
                hubs = np.concatenate(([0 if hub is None else hub], docs[first]))[np.cumsum(first)]
                key, hub = int(keys[-1]), int(hubs[-1])
                more = np.flatnonzero(~first & (docs != hubs))
                if len(more):
                    yield {"key": pa.array(keys[more]), "doc": pa.array(docs[more]), "hub": pa.array(hubs[more])}

    schema = "key long, doc long, hub long"
    emitted = map_batches(rows.filter("_key is not null"), emit, schema)
    # what a block has already settled is spread by document, so that no part's copies meet in one task
    dealt = emitted.repartition(partitions, F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("doc", "key")))
    return map_batches(dealt.sortWithinPartitions("key", "doc"), gather, schema)


def _merged(rows: DataFrame, fill, merge, dtype, length: int, chunk: int = 1 << 16) -> np.ndarray:
    """One vector over all of ``rows``: ``fill(batches)`` makes a task's, ``merge`` combines two. Chunks are merged on the cluster; only the whole comes to the driver."""

    def cut(batches):
        own = fill(batches)
        some = [i for i in range(0, length, chunk) if own[i : i + chunk].any()]
        yield {"at": pa.array(some, pa.int64()), "part": pa.array([own[i : i + chunk].tobytes() for i in some], pa.binary())}

    def combine(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["at"].to_pylist(), b["part"].to_pylist(), strict=True):
                v = np.frombuffer(x, dtype)
                parts[i] = merge(parts[i], v) if i in parts else v
        yield {"at": pa.array(list(parts), pa.int64()), "part": pa.array([v.tobytes() for v in parts.values()], pa.binary())}

    schema = "at long, part binary"
    out = np.zeros(length, dtype)
    for r in map_batches(map_batches(rows, cut, schema).repartition("at"), combine, schema).collect():
        v = np.frombuffer(r["part"], dtype)
        out[r["at"] : r["at"] + len(v)] = v
    return out


def _bloom(ids: DataFrame, count: int):
    """A bit per hashed id of the column doc, broadcast: 8 bits an id, 32 MB at most; beyond that it passes more, never less."""
    bits = min(28, max(16, int(8 * count).bit_length()))

    def fill(batches):
        out = np.zeros(1 << bits, bool)
        for b in batches:
            out[_slot(b["doc"].to_numpy(), bits)] = True
        return np.packbits(out)

    return ids.sparkSession.sparkContext.broadcast(_merged(ids.select("doc"), fill, np.bitwise_or, np.uint8, 1 << (bits - 3))), bits


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - bits)).astype(np.int64)


def _passing(keys: pa.Array, bloom: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, places of those that may be in the filter)."""
    ids = _ids(keys)
    slot = _slot(ids, width)
    return ids, np.flatnonzero((bloom[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)


class _Texts:
    """The rows (_key, _text), from which steps build what they need of some documents, and the one text that counts of each key."""

    def __init__(self, rows: DataFrame, shingle: int, chosen: DataFrame | None):
        self.rows, self.shingle, self.chosen = rows.filter("_key is not null"), shingle, chosen

    def build(self, ids: DataFrame, make, schema: str) -> DataFrame:
        """(doc, n, ...) with ``make(sets)`` giving the other columns, of the documents in ``ids``; a few others come too."""
        shared, width = _bloom(ids, ids.count())
        shingle, several = self.shingle, self.chosen is not None

        def read(batches):
            for b in batches:
                _, some = _passing(b["_key"], shared.value, width)
                sets = shingle_sets(texts_of(b["_text"].take(pa.array(some))), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    sets = [sets[i] for i in full]
                    out = {"doc": b["_key"].take(pa.array(some[full])), "n": pa.array([len(s) for s in sets], pa.int32())} | make(sets)
                    yield out | {"digest": pa.array([_digest(s) for s in sets], pa.binary())} if several else out

        built = map_batches(self.rows, read, f"doc long, n int, {schema}{', digest binary' if several else ''}")
        return built.join(self.chosen, ["doc", "digest"], "left_semi").drop("digest").dropDuplicates(["doc"]) if several else built

    def fold(self, ids: DataFrame, update, dtype, length: int) -> np.ndarray:
        """One vector to which ``update(vector, set)`` adds each document in ``ids``; a few others come too."""
        shared, width = _bloom(ids, ids.count())
        shingle = self.shingle

        def fill(batches):
            out = np.zeros(length, dtype)
            for b in batches:
                _, some = _passing(b["_key"], shared.value, width)
                for s in shingle_sets(texts_of(b["_text"].take(pa.array(some))), shingle):
                    update(out, s)
            return out

        return _merged(self.rows, fill, np.add, dtype, length)


def _sketches(sets: list[np.ndarray]) -> dict:
    words = np.stack([sketch(s) for s in sets])
    return {"bits": pa.array([bitmap(s) for s in sets], pa.binary())} | {f"w{k}": pa.array(np.ascontiguousarray(words[:, k])) for k in range(_WORDS)}


_SKETCHES = "bits binary, " + ", ".join(f"w{k} long" for k in range(_WORDS))


def _ends(pairs: DataFrame) -> DataFrame:
    """(doc): the documents in pairs (a, b). Each end is made distinct by itself, so that no row is made for an end of a pair."""
    return pairs.select(F.col("a").alias("doc")).distinct().unionByName(pairs.select(F.col("b").alias("doc")).distinct()).distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, texts: _Texts, num: int, den: int, tables: Tables) -> DataFrame:
    """Saved pairs (a, b) that reach the threshold: bounded by bitmaps first, then decided by the shingles themselves."""

    def bounded(batches):
        for b in batches:
            na, nb = (b[c].to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            both = np.minimum(_bounds(b["bits_a"].to_pylist(), na, b["bits_b"].to_pylist(), nb), np.minimum(na, nb))
            at = pa.array(np.flatnonzero(_enough(both, na, nb, num, den)))
            yield {c: b[c].take(at) for c in ("a", "b")}

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["shingles_a"].to_pylist(), b["shingles_b"].to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.searchsorted(v, u)
                keep.append(_enough(int((v[np.minimum(at, len(v) - 1)] == u).sum()), len(u), len(v), num, den))
            at = pa.array(np.flatnonzero(keep))
            yield {c: b[c].take(at) for c in ("a", "b")}

    def beside(df, of, *columns):
        for end in "ab":
            df = df.join(of.select(F.col("doc").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return df

    near = tables.save(map_batches(beside(pairs, sketches, "n", "bits"), bounded, "a long, b long"), "near")
    ids = _ends(near)
    sets = tables.save(texts.build(ids, lambda sets: {"shingles": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())}, "shingles binary"), "sets")
    links = tables.save(map_batches(beside(near, sets, "shingles"), exact, "a long, b long"), "links")
    tables.drop(near, sets)
    return links


def _prefixes(ids: DataFrame, texts: _Texts, num: int, den: int, counters: int = 20) -> DataFrame:
    """(token, place, doc, n) of the prefix tokens that more than one document in ``ids`` has.

    Shingles are ordered by how many of these documents have them (hashed counters, so about) and by hash. Sets that
    reach the threshold share a shingle among the first n - ceil(threshold x n) + 1 of each; what comes before the first
    shared one is in one set only, which bounds the overlap. Texts that share a body but differ in more places
    than the threshold allows thus seldom meet: their rarest shingles, their own, fill the prefix.
    """

    def slots(s: np.ndarray) -> np.ndarray:
        return (s >> _U(64 - counters)).astype(np.int64)

    def count(out, s):
        np.add.at(out, slots(s), 1)

    counts = ids.sparkSession.sparkContext.broadcast(texts.fold(ids, count, np.int32, 1 << counters))

    def first(sets):
        out = []
        for s in sets:
            k = len(s) - -(-num * len(s) // den) + 1
            out.append(s[np.lexsort((s, counts.value[slots(s)]))[:k]])
        return {"tokens": pa.array([x.view(np.int64) for x in out], pa.list_(pa.int64()))}

    def shared(batches):
        """Rows are sorted by token; the last of a batch is held back until the next token is seen."""
        held, twice = None, False
        for b in batches:
            cols = {c: v.to_numpy() for c, v in b.items()}
            if held is not None:
                cols = {c: np.concatenate((held[c], v)) for c, v in cols.items()}
            same = cols["token"][1:] == cols["token"][:-1]
            some = np.concatenate((same, [False])) | np.concatenate(([twice], same))
            twice = bool(same[-1]) if len(same) else twice
            held = {c: v[-1:] for c, v in cols.items()}
            at = np.flatnonzero(some[:-1])
            if len(at):
                yield {c: pa.array(v[at]) for c, v in cols.items()}
        if twice:
            yield {c: pa.array(v) for c, v in held.items()}

    tokens = texts.build(ids, first, "tokens array<long>").join(ids, "doc", "left_semi").select("doc", "n", F.posexplode("tokens").alias("place", "token")).select("token", "place", "doc", "n")
    return map_batches(tokens.repartition("token").sortWithinPartitions("token"), shared, "token long, place int, doc long, n int")


def _differ():
    return sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(_WORDS)), F.lit(0)).cast("long")


def _can_reach(num: int, den: int):
    """Whether prefix rows x and y of one token can belong to a link: by what stands before the token in each, and by the sketches."""
    ahead = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")).cast("long")
    both = (F.col("x.n") + F.col("y.n")).cast("long")
    differ = _differ()
    return (F.col("x.component") != F.col("y.component")) & (ahead * (num + den) >= both * num) & (differ * (den + num) <= both * (den - num))


def _star_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of each token's first document with its others, where they can link."""
    hubs = rows.groupBy("token").agg(F.min(F.struct("doc", *[c for c in rows.columns if c not in ("token", "doc")])).alias("h")).select("token", "h.*")
    x, y = hubs.alias("x"), rows.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & _can_reach(num, den)
    return x.join(y, meet).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _prefix_pairs(rows: DataFrame, num: int, den: int, most: int = 1000) -> DataFrame:
    """Distinct pairs (a, b, differ) across components that share a prefix token and can link; ``differ`` is where their sketches do.

    A token that more than ``most`` documents have is split: each document stands in one of its slices on one side and in
    all of them on the other, so no task compares more than a slice of it with the whole.
    """
    sizes = rows.groupBy("token").agg(F.count("*").alias("k")).select("token", F.ceil(F.col("k") / most).cast("int").alias("slices"))
    split = rows.join(sizes, "token")
    x = split.withColumn("slice", F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int")).alias("x")
    y = split.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.doc") < F.col("y.doc")) & _can_reach(num, den)
    return x.join(y, meet).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), _differ().alias("differ")).distinct()


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = named.toDF("a", "_a"), named.toDF("b", "_b")
    return pairs.join(a, "a").join(b, "b").filter("_a <> _b").select(*pairs.columns)


def _likeliest(pairs: DataFrame, named: DataFrame, slices: int) -> DataFrame:
    """Of each component the pairs (a, b) whose sketches differ least: one for each of ``slices`` parts of the documents at their other ends."""
    a, b = named.toDF("a", "_a"), named.toDF("b", "_b")
    known = pairs.join(a, "a").join(b, "b").select("_a", "_b", F.struct("differ", "a", "b").alias("p"))
    ends = known.select(F.col("_a").alias("own"), F.col("p.b").alias("other"), "p").unionByName(known.select(F.col("_b").alias("own"), F.col("p.a").alias("other"), "p"))
    best = ends.groupBy("own", F.pmod(F.xxhash64("other"), F.lit(slices)).alias("slice")).agg(F.min("p").alias("p"))
    return best.select("p.a", "p.b").distinct()


def _merge_components(named: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """``named`` (doc, component) after the components that ``links`` (a, b) join became one, under their smallest name; both are dropped."""
    a, b = named.toDF("a", "_a"), named.toDF("b", "_b")
    edges = links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    with Tables(named.sparkSession) as own:
        merged = connected_components(edges, own).toDF("component", "_to")
        out = tables.save(named.join(merged, "component", "left").select("doc", F.coalesce("_to", "component").alias("component")), "named")
    tables.drop(named, links)
    return out


def _named_classes(texts: _Texts, one: DataFrame, classes: DataFrame, total: int, tiles: Tiles, block: int, tables: Tables) -> DataFrame:
    """(digest, size, component) of each class of equal sets."""
    num, den = tiles.num, tiles.den
    members = tables.save(_part_members(texts.rows, classes.select(F.col("rep").alias("doc")), classes.count(), texts.shingle, tiles, block), "members")
    ends = F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")
    pairs = tables.save(members.select(*ends).distinct(), "pairs")
    ids = tables.save(_ends(pairs), "ids")
    # a document is named after its class at first
    named = tables.save(attach_by_key(one.join(ids, "doc", "left_semi"), classes, "digest", "size", total).select("doc", F.col("rep").alias("component")), "named")
    sketches = tables.save(texts.build(ids, _sketches, _SKETCHES), "sketches")
    tables.drop(ids)
    named = _merge_components(named, _verified(_apart(pairs, named), sketches, texts, num, den, tables), tables)

    # documents of parts whose ends are still in different components: a link not yet found has both its ends among them
    still = tables.save(_apart(pairs, named), "still")
    tables.drop(pairs)
    open_parts = members.select("key", *ends).join(still, ["a", "b"], "left_semi").select("key").distinct()
    inside = tables.save(members.join(open_parts, "key", "left_semi").select(F.explode(F.array("hub", "doc")).alias("doc")).distinct(), "open")
    tables.drop(members)
    tokens = tables.save(_prefixes(inside, texts, num, den).join(sketches.drop("n", "bits"), "doc"), "tokens")
    star = tables.save(_star_pairs(tokens.join(named, "doc"), num, den).join(still, ["a", "b"], "left_anti"), "star")
    named = _merge_components(named, _verified(star, sketches, texts, num, den, tables), tables)
    rest = tables.save(_prefix_pairs(tokens.join(named, "doc"), num, den).join(still, ["a", "b"], "left_anti").join(star, ["a", "b"], "left_anti"), "rest")
    tables.drop(tokens, star, still)
    # a group of near copies has pairs with its size squared, and nearly all are within a component once a few have linked it:
    # so while pairs outnumber documents, rounds of the likeliest pairs of each component come first, and all that are still apart only then
    documents = inside.count()
    for slices in _ROUNDS:
        if rest.count() <= documents:
            break
        some = tables.save(_likeliest(rest, named, slices), "likeliest")
        named = _merge_components(named, _verified(some, sketches, texts, num, den, tables), tables)
        before, rest = rest, tables.save(_apart(rest.join(some, ["a", "b"], "left_anti"), named), "rest")
        tables.drop(before, some)
    named = _merge_components(named, _verified(rest.select("a", "b"), sketches, texts, num, den, tables), tables)

    # a class's documents carry one name, that of its smallest
    return classes.join(named.toDF("rep", "component"), "rep", "left").select("digest", "size", F.coalesce("component", "rep").alias("component"))


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text", block: int = 1 << 18) -> DataFrame:
    """key, n_shingles, component_id of every row: documents link when their shingle sets' Jaccard index is num / den or more.

    Words are runs between ASCII blanks, A-Z lower-cased; a text with fewer words than ``shingle`` has its whole sequence as
    its only shingle; an empty or null text has none and links with nothing. component_id is the smallest key that links
    reach; equal sets link whatever their size, and a similarity of just the threshold links. Very long texts are read
    whole. Rows with a null key link with nothing and have a null component; rows that repeat a key are one document, whose
    set is the largest among theirs (ties: by digest). An empty table gives an empty result; extra columns are ignored,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    thin = saved(_sizes(rows, shingle), "sizes")
    with Tables(docs.sparkSession) as tables:
        one = tables.save(thin.filter("doc is not null").groupBy("doc").agg(F.max(F.struct("n", "digest")).alias("s"), F.count("*").alias("copies")).select("doc", "s.n", "s.digest", "copies"), "documents")
        total, most = one.agg(F.count("*"), F.max("copies")).first()
        repeated = (most or 0) > 1
        classes = tables.save(one.filter("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("size")), "classes")
        texts = _Texts(rows, shingle, one.select("doc", "digest") if repeated else None)
        named = saved(_named_classes(texts, one.select("doc", "digest"), classes, total, Tiles(num, den), block, tables), "components")
        keyed = thin.filter("doc is not null")
        if repeated:
            keyed = saved(keyed.select("doc").join(one.select("doc", "n", "digest"), "doc"), "keyed")
    alone = thin.filter("doc is null").unionByName(keyed.filter("n = 0")).withColumn("component", F.col("doc"))
    linked = attach_by_key(keyed.filter("n > 0"), named, "digest", "size", total)
    return linked.select("doc", "n", "component").unionByName(alone.select("doc", "n", "component")).select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_each(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest key; rows with a null key all stay.

    Rows that repeat the smallest key of a component all stay, as they are one document. Null, empty and very long texts,
    ties and empty tables as in ``jaccard_components``; columns may have any names.
    """
    found = jaccard_components(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle, num, den, "key", "text")
    # a table of known size, so that the planner may broadcast it if it is small and shuffles if it isn't
    drop = saved(found.filter("component_id <> key").select("key").distinct(), "dropped")
    own = fresh_names(docs, "dropped")[0]
    return docs.join(drop.toDF(own), F.col(key).cast("long") == F.col(own), "left_anti")

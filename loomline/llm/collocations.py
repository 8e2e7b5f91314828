"""Phrase collocation mining: counts of word n-grams from suffix arrays of shards, merged by key, then exact scores.

Texts become shards, arrays of at most about ``SHARD`` word ids with breaks between pieces. Words that reach the least count get
numbers that hold in all shards; the others break a run of words. The positions of a shard are sorted by their next words by prefix
doubling in numpy; neighbours that share n words form the intervals, an n-gram and its count each. An n-gram's key is its numbers,
packed into whole numbers of 64 bits: exact, and much smaller than its text. Each task sums its shards' counts by key before it
hands them on; then they are summed over all tasks, and only what reaches the least count is spelled out, once. A shard is a row of
some megabytes, so tables of shards have small row groups: a task holds a few shards, however many its part of the input makes.

Most n-grams are rare, so a round for each n leaves out what can't reach the least count: n-grams whose first or last n - 1 words
don't. These reach the shards as Bloom filters of at most 2^29 bits, sized by the number of entries; a false entry, or a filter
too full to help, costs rows, never results, as the least count is applied to exact sums.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, map_batches, small_batches

#: Words of a shard, but for the last batch of texts; most bits of a filter, as a power of two; most words that are numbered at once.
SHARD, FILTER_BITS, WORDS = 1 << 19, 29, 1 << 23
#: Keys and counts that a task gathers before it sums them.
GATHERED = 1 << 20
#: Bytes that end a piece become line ends, the other blank a space: fixed values. bytes.lower() folds A-Z only.
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_BREAK = b"."


# --- suffix arrays


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words (ids above 0) in order of the ``depth`` or more ids that follow them, by prefix doubling."""
    rank = ids.astype(np.int64)
    length = 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-length] = rank[length:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        if 2 * length >= depth:
            return order[ids[order] > 0]
        ordered = key[order]
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) if len(ordered) else rank
        length *= 2


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(words up to the next break, words shared with the position before in ``order``), both at most ``depth``."""
    padded = np.append(ids, np.zeros(depth, ids.dtype))
    left, shared = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
    on, same = np.ones(len(order), bool), np.ones(len(order), bool)
    same[:1] = False
    for k in range(depth):
        w = padded[order + k]
        on &= w > 0
        same[1:] &= on[1:] & (w[1:] == w[:-1])
        left += on
        shared += same
    return left, shared


def intervals(order: np.ndarray, left: np.ndarray, shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, count) of each n-gram: the intervals of ``order`` within which neighbours share n words."""
    whole = left >= n
    first = np.flatnonzero(whole & (shared < n))
    counts = np.add.reduceat(whole.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return order[first], counts


# --- shards


def _shards(batches: Iterator[dict], seed: int):
    """Batches of (text as bytes, lang) to shards; ids start at 1, 0 is a break."""
    vocab: dict[str, defaultdict] = {}
    lines: list[np.ndarray] = []
    size, numbers = 0, count(1)

    def flush():
        ids = np.concatenate(lines)
        counts = np.bincount(ids)
        words, langs = [], []
        at = np.empty(sum(map(len, vocab.values())), np.int64)
        hashes = np.empty(len(at), np.uint64)
        for lang, own in vocab.items():
            own.pop(_BREAK, None)
            for w, i in own.items():
                at[len(words)] = i
                hashes[i - 1] = xxhash.xxh3_64_intdigest(w, xxhash.xxh32_intdigest(lang) + (seed << 32))
                words.append(w)
                langs.append(lang)
        order = np.argsort(at[: len(words)])
        return {
            "ids": pa.array([ids.astype("<i4").tobytes()], pa.large_binary()).cast(pa.binary()),
            "words": pa.array([[words[i] for i in order]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            "langs": pa.array([[langs[i] for i in order]], pa.list_(pa.string())),
            "hashes": pa.array([hashes[: len(words)].view(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([counts[1 : len(words) + 1]], pa.list_(pa.int64())),
        }

    for b in batches:
        by_lang: dict[str, list[bytes]] = {}
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            own = vocab.get(lang)
            if own is None:
                own = vocab[lang] = defaultdict(numbers.__next__)
                own[_BREAK] = 0
            tokens = b"\n".join(texts).lower().translate(_BREAKS).replace(b"\n", b" . ").split()
            lines.append(np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens)))
            lines.append(np.zeros(1, np.int32))
            size += len(tokens)
        if size >= SHARD:
            yield flush()
            vocab, lines, size, numbers = {}, [], 0, count(1)
    if size:
        yield flush()


def make_shards(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(ids binary, words, langs, hashes, counts): arrays of word ids of the texts, and of each id its word, lang, hash under ``seed`` and count."""
    rows = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return map_batches(rows, lambda b: _shards(b, seed), "ids binary, words array<string>, langs array<string>, hashes array<bigint>, counts array<bigint>")


# --- filters


def _spots(hashes, bits: int):
    """Two places of a hash in a filter of 2^bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def make_filter(hashes: DataFrame, column: str = "h", most: int = FILTER_BITS) -> tuple[np.ndarray, int]:
    """(bitmap, bits): a Bloom filter with two probes of a column of 64-bit hashes, 16 bits an entry up to 2^``most`` bits.

    It is built by Spark in pieces of 4 kB; the driver gets the bitmap only, 64 MB at most, to hand on.
    """
    n = hashes.count()
    bits = min(most, max(16, (16 * n - 1).bit_length() if n else 0))
    h, mask = F.col(column), F.lit((1 << bits) - 1).cast("long")
    spots = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("p"))
    pieces = spots.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        at = (r["k"] - 1) * 4096
        piece = np.frombuffer(bytes(r["b"]), np.uint8)[: len(out) - at]
        out[at : at + len(piece)] = piece
    return out, bits


def _inside(filter_: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    bitmap, bits = filter_
    found = np.ones(len(hashes), bool)
    for spot in _spots(hashes, bits):
        found &= (bitmap[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


# --- counts by number


def _numbers(hashes: np.ndarray, known: np.ndarray, first: int) -> np.ndarray:
    """The number of each hash that ``known``, ascending, holds: its place there, counted from ``first``; else 0."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + first, 0)


def _renumber(batches: Iterator[dict], known, first: int, last: bool):
    """Shards in whose ids the words of ``known`` stand as their negative numbers; after the ``last`` part as the positive ones, others as breaks, lone words left out."""
    for b in batches:
        for i in range(len(b["ids"])):
            ids = np.frombuffer(b["ids"][i].as_py(), "<i4")
            hashes = b["hashes"].slice(i, 1).flatten()
            new = _numbers(hashes.to_numpy(), known.value, first)
            new = np.append(0, np.where(new > 0, -new, np.arange(1, len(new) + 1)))
            ids = np.where(ids > 0, new[np.maximum(ids, 0)], ids)
            if last:
                ids = _without_lone(np.maximum(-ids, 0))
            kept = pa.array([[] if last else hashes.to_numpy()], pa.list_(pa.int64()))
            yield {"ids": pa.array([ids.astype("<i4").tobytes()], pa.binary()), "hashes": kept}


def _without_lone(ids: np.ndarray) -> np.ndarray:
    """Runs of two or more words, one break or more between them."""
    before, after = np.append(0, ids[:-1]), np.append(ids[1:], 0)
    return ids[((ids > 0) & ((before > 0) | (after > 0))) | ((ids == 0) & (before > 0))]


def numbered(shards: DataFrame, words: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, int]:
    """(saved runs (ids) of numbers in all shards, saved (lang, phrase, a, number) of ``words``, how many); ``shards`` is dropped.

    Numbers are places in the ascending hashes, of which no two are equal. The hashes are broadcast, 64 MB at most at once: where
    there are more, in parts, each in a pass over the shards.
    """
    sc, total = shards.sparkSession.sparkContext, words.count()
    parts = max(1, -(-total // WORDS))
    first, names = 1, []
    for part in range(parts):
        own = words.filter(F.pmod(F.col("h"), F.lit(parts)) == part)
        known = sc.broadcast(np.sort(own.select("h").toArrow()["h"].to_numpy()))
        last = part == parts - 1
        before, shards = shards, tables.save(map_batches(shards.select("ids", "hashes"), lambda b, k=known, f=first, e=last: _renumber(b, k, f, e), "ids binary, hashes array<bigint>"), "runs", large=True)
        tables.drop(before)

        def name(batches, known=known, first=first):
            for b in batches:
                yield {c: b[c] for c in ("lang", "phrase", "a")} | {"number": _numbers(b["h"].to_numpy(), known.value, first)}

        names.append(tables.save(map_batches(own, name, "lang string, phrase string, a bigint, number bigint"), "names"))
        first += len(known.value)
    named = names[0]
    for more in names[1:]:
        named = named.unionByName(more)
    return shards.select("ids"), named, total


def _keys(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The n numbers of ``bits`` bits from each position of ``at``, in order, as many to a whole number of 63 bits as fit."""
    per, out = 63 // bits, []
    for lo in range(0, n, per):
        x = np.zeros(len(at), np.int64)
        for k in range(lo, min(n, lo + per)):
            x = x << bits | ids[at + k]
        out.append(x)
    return out


def _key_names(n: int, bits: int) -> list[str]:
    return [f"k{i}" for i in range(-(-n // (63 // bits)))]


def _hash(keys: list[np.ndarray]) -> np.ndarray:
    """A hash of keys, for filters."""
    x = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        x = (x ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def _summed(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    keys = [np.concatenate(k) for k in zip(*(k for k, _ in parts), strict=True)]
    counts = np.concatenate([c for _, c in parts])
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(counts)]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first) if len(first) else counts


def _gathered(parts: Iterator[tuple[list[np.ndarray], np.ndarray]]):
    """Keys and counts, summed by key whenever ``GATHERED`` are held; what is still over half of that is handed on."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[1])
        if size >= GATHERED:
            held = [_summed(held)]
            size = len(held[0][1])
            if 2 * size >= GATHERED:
                yield held[0]
                held, size = [], 0
    if held:
        yield _summed(held)


def _grams(batches: Iterator[dict], filters: list, n: int, bits: int):
    """(keys, counts) of each shard's n-grams whose pairs, and whose first and last n - 1 words, are in the filters (of 2, 3... words)."""
    for b in batches:
        for ids in b["ids"].to_pylist():
            ids = np.frombuffer(ids, "<i4").astype(np.int64)
            if n > 2:
                at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                linked = np.zeros(len(ids), bool)
                linked[at] = _inside(filters[0].value, _hash(_keys(ids, at, 2, bits)))
                ids = _without_lone(np.insert(ids, np.flatnonzero((ids > 0) & ~linked) + 1, 0))
            order = suffix_array(ids, n)
            first, counts = intervals(order, *common_prefixes(ids, order, n), n)
            if n > 3:
                whole = np.all([_inside(filters[n - 3].value, _hash(_keys(ids, first + k, n - 1, bits))) for k in (0, 1)], axis=0)
                first, counts = first[whole], counts[whole]
            yield _keys(ids, first, n, bits), counts


def _count(batches: Iterator[dict], filters: list, n: int, bits: int):
    names = _key_names(n, bits)
    for keys, counts in _gathered(_grams(batches, filters, n, bits)):
        for lo in range(0, len(counts), 1 << 17):
            yield {c: k[lo : lo + (1 << 17)] for c, k in zip(names, keys, strict=True)} | {"a": counts[lo : lo + (1 << 17)]}


def _spelled(counted: DataFrame, names: DataFrame, n: int, bits: int) -> DataFrame:
    """(lang, words, phrase, a) of keys of n words."""
    per, mask = 63 // bits, F.lit((1 << bits) - 1).cast("long")
    keys = _key_names(n, bits)
    number = [F.shiftright(f"k{k // per}", bits * (min(n, (k // per + 1) * per) - 1 - k)).bitwiseAND(mask) for k in range(n)]
    each = counted.select(*keys, "a", F.posexplode(F.array(*number)).alias("at", "number")).join(names.select("lang", "phrase", "number"), "number")
    named = each.groupBy(*keys, "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "phrase"))).alias("w"))
    return named.select("lang", F.lit(n).alias("words"), F.array_join("w.phrase", " ").alias("phrase"), "a")


# --- scores


def phrase_counts(docs: DataFrame, tables: Tables, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, a) of the phrases of 1 to ``longest`` words with a count of at least ``least``, (lang, n) of all words)."""
    spark = docs.sparkSession
    small_batches(spark, size="1m")
    for seed in count():
        shards = tables.save(make_shards(docs, seed), "shards", large=True)
        each = shards.select(F.explode(F.arrays_zip("langs", "words", "hashes", "counts")).alias("w"))
        every = each.groupBy(F.col("w.langs").alias("lang"), F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"), F.min("w.hashes").alias("h"))
        every = tables.save(every, "words")
        single = every.filter(F.col("a") >= least)
        alone = single.select("h").distinct()
        if every.join(alone, "h", "left_semi").count() == alone.count():
            break
        tables.drop(shards, every)  # a frequent word shares its hash with another word: all are hashed anew
    totals = tables.save(every.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    runs, names, total = numbered(shards, single, tables)
    tables.drop(every)
    bits, filters = max(1, total.bit_length()), []
    phrases = [names.select("lang", F.lit(1).alias("words"), "phrase", "a")]
    for n in range(2, longest + 1):
        keys = _key_names(n, bits)
        counted = map_batches(runs, lambda b, n=n: _count(b, filters, n, bits), ", ".join(f"{k} bigint" for k in [*keys, "a"]))
        counted = tables.save(counted.groupBy(*keys).agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "counted")
        phrases.append(_spelled(counted, names, n, bits))
        if n < longest:
            hashes = map_batches(counted.select(*keys), lambda b: ({"h": _hash([k.to_numpy() for k in x.values()]).view(np.int64)} for x in b), "h bigint")
            filters.append(spark.sparkContext.broadcast(make_filter(hashes)))
    out = phrases[0]
    for more in phrases[1:]:
        out = out.unionByName(more)
    return tables.save(out, "phrases"), totals


def _part(phrase: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each lang its ``top`` phrases by score.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times or more; one goes when a longer candidate holds
    it and occurs as often. Its score is floor(1000 a n / (l r)) at the cut where that is lowest, in decimals of 38 digits
    (counts below 10^15, words of a lang below 10^19). Ranks go by score, a, then phrase in byte order.

    Null texts are empty, a null lang is ``und``; very long texts are cut into no parts, repeated rows count each; an empty
    table gives no rows; other columns of any name are ignored.
    """
    with Tables(docs.sparkSession) as tables:
        counts, totals = phrase_counts(docs, tables, least, longest)
        tables.keep(counts)
        tables.keep(totals)
    several = counts.filter("words > 1")
    # what a longer candidate holds, with the most frequent such candidate's count
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda k: _part(F.col("phrase"), k, m))))
    inner = several.filter("words > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = several.join(inner, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _part(F.col("phrase"), 1, F.col("k"))).withColumn("right", _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    known = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(F.broadcast(totals) if totals.count() < 10000 else totals, "lang")
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = number(1000 * F.col("a"), 18) * number(F.col("n"), 19)
    score = F.call_function("div", above, number(F.col("l"), 18) * number(F.col("r"), 19))
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    flat = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

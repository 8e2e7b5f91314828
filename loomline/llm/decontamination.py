"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignment scores the copies.

Seeds are all word n-grams of the items, whatever the corpus holds, so no number of copies can thin them out. Each seed found in a
text opens a window of about the item's length. Phrases in common open many: a window that shares too few words with the
item for any alignment to pass is left there, and the best local alignment of words in the others tells copies, also
edited ones, from phrases in common. Items of few words are matched exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.shipping import ship

from .common import map_batches, release, small_batches, texts_of
from .textvec import ALNUM, ngrams, word_hashes

_BLOOM = 22
#: Items with fewer words are too short for a share of a match to tell anything: their whole sequence must occur.
LEAST_WORDS = 8
# Scripts without blanks (Thai to Khmer, kana, Han): each character stands alone in an exact match; their punctuation is blank.
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def spaced(text: str) -> str:
    """``text`` with blanks around each character of a script without blanks, and for its punctuation."""
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", _MARKS.sub(" ", text))


def tokens_of(texts: Sequence[str]) -> list[np.ndarray]:
    """Words, and single characters where the script has no blanks."""
    words, at = word_hashes([spaced(t) for t in texts], ALNUM)
    return [words[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Exact:
    """Short items by the hash of their first tokens, at most ``LEAST_WORDS``, for each number of those."""

    tokens: list[np.ndarray]

    def __post_init__(self):
        by: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, t in enumerate(self.tokens):
            k = min(len(t), LEAST_WORDS)
            by[k][int(ngrams(t[:k], k)[0])].append(i)
        self.heads = {k: (np.array(sorted(h), np.uint64), dict(h)) for k, h in by.items()}

    def hits(self, text: str, tokens: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item number, 1.0, first word, end word) of the first occurrence of each item; words as in ``word_hashes``."""
        first: dict[int, int] = {}
        for k, (hashes, owners) in self.heads.items():
            runs = ngrams(tokens, k)
            found = np.searchsorted(hashes, runs)
            found[found == len(hashes)] = 0
            for place in np.flatnonzero(hashes[found] == runs).tolist():
                for item in owners[int(runs[place])]:
                    m = len(self.tokens[item])
                    if item not in first and np.array_equal(tokens[place : place + m], self.tokens[item]):
                        first[item] = place
        if not first:
            return []
        words = text.lower().encode("utf-8", "surrogatepass").translate(ALNUM).split()
        of = np.repeat(np.arange(len(words)), [len(spaced(w.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass").split()) for w in words])
        return [(i, 1.0, int(of[at]), int(of[at + len(self.tokens[i]) - 1]) + 1) for i, at in first.items()]


@dataclass
class Seeds:
    """The items' words and the sorted hashes of their seeds, with the items and places each seed stands for."""

    ids: list
    words: list[np.ndarray]
    n: int
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash in owners, and the end
    owners: np.ndarray  # (item number, place)
    short_ids: list
    short: Exact

    def __post_init__(self):
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.maybe = np.zeros(1 << _BLOOM, bool)
        self.maybe[(self.hashes >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, place in item, place in runs)."""
        if not len(self.hashes):
            return
        at = np.flatnonzero(self.maybe[(runs >> np.uint64(64 - _BLOOM)).astype(np.int64)])
        found = np.searchsorted(self.hashes, runs[at])
        found[found == len(self.hashes)] = 0
        good = self.hashes[found] == runs[at]
        for place, k in zip(at[good].tolist(), found[good].tolist(), strict=True):
            for item, start in self.owners[self.first[k] : self.first[k + 1]].tolist():
                yield item, start, place


def most_matches(bag: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> int:
    """The words an item and a window share, repeats counted: no alignment matches more."""
    words, counts = bag
    at = np.searchsorted(words, window)
    at[at == len(words)] = 0
    return int(np.minimum(np.bincount(at[words[at] == window], minlength=len(words)), counts).sum())


def align(item: np.ndarray, window: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """(score, end in item, end in window) of the best local alignment, ends exclusive; the first best end on ties.

    A row of the Smith-Waterman matrix at a time: gaps along the row are a running maximum, as they cost the same per word.
    """
    step = -gap * np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        here = np.maximum(row + gap, 0)
        here[1:] = np.maximum(here[1:], row[:-1] + np.where(window == w, match, mismatch))
        here = np.maximum.accumulate(here + step) - step
        row = np.maximum(here, 0)
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def text_hits(words: np.ndarray, seeds: Seeds, least: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, first word, end word) of the best alignment with each item that reaches ``least``.

    The score is the alignment's share of a perfect match of the whole item.
    """
    windows: dict[int, list[list[int]]] = {}
    for item, start, place in seeds.hits(ngrams(words, seeds.n)):
        m = len(seeds.words[item])
        slack = m // 4 + 4
        lo, hi = max(0, place - start - slack), min(len(words), place - start + m + slack)
        spans = windows.setdefault(item, [])
        if spans and lo <= spans[-1][1] - m:  # seeds come in order of place: the same copy
            spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
        elif not spans or spans[-1] != [lo, hi]:
            spans.append([lo, hi])
    out = []
    for item, spans in windows.items():
        best = (0.0, 0, 0)
        words_of = seeds.words[item]
        for lo, hi in spans:
            if most_matches(seeds.bags[item], words[lo:hi]) / len(words_of) < least:
                continue
            score, end_i, end_w = align(words_of, words[lo:hi])
            share = score / (2 * len(words_of))
            if share >= least and share > best[0]:
                _, _, back = align(words_of[:end_i][::-1], words[lo : lo + end_w][::-1])
                best = (share, lo + end_w - back, lo + end_w)
        if best[0] >= least:
            out.append((item, *best))
    return out


def _slices(benchmark: DataFrame, key: str, text: str, most_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items, id and text, in slices whose texts hold about ``most_bytes``; items without id or text are left out."""
    items = benchmark.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_item")).filter("_id is not null and _item is not null")
    size = items.agg(F.sum(F.octet_length("_item")).alias("n")).first()["n"] or 0
    n = -(-size // most_bytes) if size else 0
    for k in range(n):
        got = items.filter(F.pmod(F.xxhash64("_id", "_item"), F.lit(n)) == k).distinct().orderBy("_id", "_item").collect()
        if got:
            yield [(r["_id"], r["_item"]) for r in got]


def find_seeds(items: list[tuple[object, str]], n: int) -> Seeds:
    """Seeds of one slice: every n-gram of every item of ``LEAST_WORDS`` or more, and the shorter ones whole; those without a word are no evidence."""
    hashes, at = word_hashes([t for _, t in items], ALNUM)
    long = [(i, hashes[a:b]) for (i, _), a, b in zip(items, at[:-1], at[1:], strict=True) if b - a >= LEAST_WORDS]
    rest = [x for x, a, b in zip(items, at[:-1], at[1:], strict=True) if b - a < LEAST_WORDS]
    short = [(i, t) for (i, _), t in zip(rest, tokens_of([t for _, t in rest]), strict=True) if len(t)]
    words = [w for _, w in long]
    none = np.zeros(0, np.uint64)
    every = np.concatenate([none, *(ngrams(w, n) for w in words)])
    owner = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([np.full(len(w) - n + 1, i), np.arange(len(w) - n + 1)], 1) for i, w in enumerate(words))])
    order = np.argsort(every, kind="stable")
    uniq, first = np.unique(every[order], return_index=True)
    return Seeds([i for i, _ in long], words, n, uniq, np.append(first, len(every)), owner[order], [i for i, _ in short], Exact([t for _, t in short]))


def batch_hits(texts: list[str], seeds: Seeds, least: float) -> Iterator[list[tuple[object, float, int, int]]]:
    """Per text (item id, score, first word, end word) of its copies."""
    words, at = word_hashes(texts, ALNUM)
    for t, i, j in zip(texts, at[:-1], at[1:], strict=True):
        found = [(seeds.ids[item], *rest) for item, *rest in text_hits(words[i:j], seeds, least)]
        if seeds.short_ids:
            wide = spaced(t)
            tokens = words[i:j] if wide == t else word_hashes([wide], ALNUM)[0]
            found += [(seeds.short_ids[item], *rest) for item, *rest in seeds.short.hits(t, tokens)]
        yield found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = 3, most_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item copied in it: key, item_id, score, first_word, end_word (exclusive), best copy.

    The benchmark is broadcast in slices of at most ``most_bytes`` of text, one pass of the corpus each, so it may be of
    any size. Items of under 8 words are copied where their whole word sequence occurs, or their characters in scripts
    without blanks. Documents are scanned whole where they lie; nothing of theirs is shuffled. Null and empty texts match
    nothing; repeated rows repeat; rows with a null key are reported with it; equal items are reported each; of copies with one
    score the first counts. Very long texts are searched whole; an empty table on either side gives an empty result;
    extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    schema = f"{key} long, {item_key} long, score double, first_word long, end_word long"
    out = None
    for items in _slices(benchmark, item_key, item_text, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(find_seeds(items, n))

        def run(batches, shared=shared):
            seeds = shared.value
            for b in batches:
                found = []
                for k, hits in zip(b["_key"].to_pylist(), batch_hits(texts_of(b["_text"]), seeds, least), strict=True):
                    found += [(k, *hit) for hit in hits]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield {c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in zip((key, item_key, "score", "first_word", "end_word"), cols, strict=True)}

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = 3, most_bytes: int = 16 << 20, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, in which no test item is copied. Rows go or stay where they lie.

    Null and empty texts stay; repeated rows go or stay alike; very long texts are searched whole; an empty table stays
    empty, and without items all rows stay.
    """
    small_batches(docs.sparkSession, size="1m")
    ship(docs.sparkSession)
    out, column = docs, docs.columns.index(text)
    for items in _slices(benchmark, item_key, item_text, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(find_seeds(items, n))

        def run(batches, shared=shared):
            for b in batches:
                clean = [not hits for hits in batch_hits(texts_of(b.column(column)), shared.value, least)]
                if b.num_rows:
                    yield b.filter(pa.array(clean, pa.bool_()))
            release()

        out = out.mapInArrow(run, docs.schema)
    return out

"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)) with x_i = 1 for each hashed term that
occurs. The pairwise part learns what two terms mean together, which additive weights cannot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.shipping import ship

from .common import map_batches, release, small_batches, texts_of
from .textvec import ALNUM, word_hashes

BITS = 18


def term_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms of all texts, each text's distinct ones; index of each text's first and the end)."""
    words, at = word_hashes(texts, ALNUM)
    terms = (words >> np.uint64(64 - BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pairs = np.unique(doc << BITS | terms)
    return (pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1))


@dataclass
class Model:
    """Weights of the chosen terms; ``row`` maps a hashed term to its weights, -1 if it was not chosen."""

    row: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = self.row[terms]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        doc, rows = doc[rows >= 0], rows[rows >= 0]
        return _fm(self.w0, self.w, self.v, doc, rows, len(at) - 1)[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*term_sets(texts)), -30, 30)))


def _fm(w0, w, v, doc, rows, n):
    """(raw scores, sum of v per document)."""
    sums = np.zeros((n, v.shape[1]))
    linear = np.bincount(doc, w[rows], n)
    squares = np.bincount(doc, (v[rows] ** 2).sum(1), n)
    for f in range(v.shape[1]):
        sums[:, f] = np.bincount(doc, v[rows, f], n)
    return w0 + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def telling_pairs(terms: list[np.ndarray], y: np.ndarray, df: np.ndarray, most_terms: int = 2048, least: int = 10, level: float = 38.6) -> np.ndarray:
    """The terms of pairs whose rate of positives differs from either term's own: chi-square against both over ``level``,
    one chance in a thousand among all pairs of 2048. Pairs are counted among the ``most_terms`` terms that divide the
    documents best, by a matrix product over blocks of documents; pairs in fewer than ``least`` documents tell nothing.
    """
    size, n = len(df), len(y)
    some = np.argsort(-df * (n - df), kind="stable")[:most_terms]
    some = np.sort(some[df[some] >= least])
    at = np.full(size, -1, np.int64)
    at[some] = np.arange(len(some))
    both, hits = (np.zeros((len(some), len(some)), np.float32) for _ in range(2))
    for positive, out in ((True, hits), (False, both)):
        docs = np.flatnonzero(y > 0.5) if positive else np.flatnonzero(y <= 0.5)
        for i in range(0, len(docs), 1024):
            part = [r[r >= 0] for r in (at[terms[k]] for k in docs[i : i + 1024])]
            x = np.zeros((len(part), len(some)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1
            out += x.T @ x
    both += hits
    rate = np.diag(hits) / np.maximum(np.diag(both), 1)
    found = np.zeros(len(some), bool)
    for i in range(0, len(some), 256):
        k, h = both[i : i + 256], hits[i : i + 256]
        chi = [np.maximum(np.abs(h - k * p) - 0.5, 0) ** 2 / (k * p * (1 - p) + 0.5) for p in (rate[i : i + 256, None], rate[None, :])]
        told = (k >= least) & (np.minimum(*chi) > level)
        found[i : i + 256] |= told.any(1)
        found |= told.any(0)
    return some[found]


def fit(terms: list[np.ndarray], labels: np.ndarray, most_terms: int = 4096, factors: int = 4, steps: int = 2000, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, about ``steps`` batches of 256 documents.

    Terms are those whose presence tells most about the label (chi-square), and those of which a pair tells what neither of
    its terms does; the rest is noise that long texts would add up. Without any document all scores are next to 0.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    y = np.asarray(labels, float)
    n, pos = len(y), float(y.sum())
    row = np.full(size, -1, np.int32)
    if not n:  # without labels nothing is known to be toxic
        return Model(row, -20.0, np.zeros(0), np.zeros((0, factors)))
    prior = (pos + 0.5) / (n + 1)
    df, hit = np.zeros(size), np.zeros(size)
    for i in range(0, n, 1024):
        part = terms[i : i + 1024]
        df += np.bincount(np.concatenate(part), minlength=size)
        hit += np.bincount(np.concatenate(part), np.repeat(y[i : i + 1024], [len(t) for t in part]), minlength=size)
    expected = df * prior
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - prior) * (1 - df / (n + 1)), 1e-9)
    chi[df < 5] = 0
    chosen = np.argsort(-chi, kind="stable")[:most_terms]
    chosen = chosen[chi[chosen] > 10.83]  # the 0.1 % level of chi-square with one degree of freedom
    chosen = np.union1d(chosen, telling_pairs(terms, y, df))
    row[chosen] = np.arange(len(chosen), dtype=np.int32)
    w0, w, v = float(np.log(prior / (1 - prior))), np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), factors))
    g0, gw, gv = 1e-6, np.full(len(chosen), 1e-6), np.full((len(chosen), factors), 1e-6)
    known = [r[r >= 0] for r in (row[t] for t in terms)]
    for _ in range(-(-steps // max(1, n // 256))):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            rows = np.concatenate([known[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(known[i]) for i in part])
            raw, sums = _fm(w0, w, v, doc, rows, len(part))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            uniq, back = np.unique(rows, return_inverse=True)
            dw = np.bincount(back, err[doc], len(uniq)) + decay * w[uniq]
            dv = np.empty((len(uniq), factors))
            for f in range(factors):
                dv[:, f] = np.bincount(back, err[doc] * (sums[doc, f] - v[rows, f]), len(uniq))
            dv += decay * v[uniq]
            d0 = err.sum()
            g0 += d0 * d0
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w0 -= rate * d0 / np.sqrt(g0)
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= rate * dv / np.sqrt(gv[uniq])
    return Model(row, w0, w, v)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % of


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", most_rows: int = 20000, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled documents for which ``usable`` holds; at most ``most_rows`` of them, those whose key hashes lowest.

    The labels are cut to that bound before they meet the documents, so they can be broadcast. Null labels, null keys
    and labels without a document are left out; repeated labels of a key count once, the larger one; without labels all are civil.
    The driver gives the memory of the fit back.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y")).orderBy(F.xxhash64("_key"), "_key").limit(most_rows)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "_key")

    def features(batches):
        for b in batches:
            terms, at = term_sets(texts_of(b["_text"]))
            yield {"k": b["_key"], "y": b["_y"], "terms": pa.array([terms[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())}

    got = map_batches(rows.select("_key", "_y", "_text"), features, "k long, y int, terms binary").toArrow()
    found = sorted(zip(got["k"].to_pylist(), got["terms"].to_pylist(), got["y"].to_pylist(), strict=True))
    del got
    model = fit([np.frombuffer(t, np.int32) for _, t, _ in found], np.array([y for _, _, y in found], float))
    del found
    release()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted (1 from a score of 0.5 on) for every whole text; an empty or null text scores the base rate.

    Rows are independent: repeated rows repeat, null keys stay null, very long texts are scored whole, an empty table gives
    an empty result, extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(texts_of(b["_text"]))
            yield {key: b[key], "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, run, f"{key} long, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that score under 0.5. Nothing is shuffled.

    Null and empty texts have the base rate, as in ``score``; repeated rows go or stay alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession, size="1m")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.scores(texts_of(b.column(at))) < 0.5))
        release()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

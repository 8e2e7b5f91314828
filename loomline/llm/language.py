"""Language identification of mixed documents by expectation-maximisation.

Each language is a distribution over hashed character trigrams. A document is a mixture: its proportions maximise the
likelihood of its trigrams, and the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts_of

BITS = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around each letter, lower-cased; all that is no letter is one blank. Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    return (h[letter] >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # trigram x language

    def mixture(self, text: str, rounds: int = 20, penalty: float = 1.0) -> tuple[str, float, dict[str, float]]:
        """(language, its share, shares of the chosen set); 'und' and 0 for a text without letters.

        Starting from the best single language, languages join in order of their share in the full mixture while twice
        the gain in log-likelihood exceeds the penalty: ``penalty`` x log of the number of trigrams, a third of them
        counted, as neighbours overlap. Ties go to the first language in alphabetical order.
        """
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return "und", 0.0, {}
        counts = np.bincount(grams, minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        n, logs = counts[seen].astype(float), self.logp[seen]
        top = logs.max(1, keepdims=True)
        like = np.exp(logs - top)
        single = n @ logs
        share = _em(like, n, np.full(len(self.languages), 1 / len(self.languages)), rounds)
        first = int(np.argmax(single))
        order = [first] + [int(k) for k in np.argsort(-share, kind="stable") if k != first and share[k] > 0.01]
        base, best, shares = float(n @ top[:, 0]), float(single[first]), np.array([1.0])
        chosen, cost = [first], penalty * np.log(max(2.0, n.sum() / 3))
        for k in order[1:]:
            trial = [*chosen, k]
            start = np.maximum(share[trial], 0.01)
            p = _em(like[:, trial], n, start / start.sum(), rounds // 2)
            gained = base + float(n @ np.log(like[:, trial] @ p + 1e-300)) - best
            if 2 * gained / 3 <= cost:
                break
            chosen, best, shares = trial, best + gained, p
        at = int(np.argmax(shares))
        return self.languages[chosen[at]], float(shares[at]), {self.languages[k]: float(s) for k, s in zip(chosen, shares, strict=True)}


def _em(like: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
    total = n.sum()
    for _ in range(rounds):
        r = like * p
        new = (n / (r.sum(1) + 1e-300)) @ r / total
        if np.abs(new - p).max() < 1e-4:
            return new
        p = new
    return p


def train(docs: DataFrame, usable: Column, most_rows: int = 20000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Trigram distributions from documents for which ``usable`` holds, with a language and a text; at most ``most_rows``, those whose key hashes lowest.

    Only keys and languages are looked at to choose them. Each task sums its rows to one vector a language.
    """
    small_batches(docs.sparkSession)
    named = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    picked = named.select(F.col(key).cast("long").alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(most_rows)
    rows = named.select(F.col(key).cast("long").alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_key")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b["_lang"].to_pylist(), texts_of(b["_text"]), strict=True):
                sums.setdefault(k, np.zeros(1 << BITS, np.int64))
                sums[k] += np.bincount(trigrams(t), minlength=1 << BITS)
        if sums:
            yield {"lang": pa.array(list(sums)), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())}

    # the sample is bounded, and so is the number of tasks that sum it
    got = map_batches(rows.select("_lang", "_text").repartition(8), count, "lang string, counts binary").toArrow()
    sums: dict[str, np.ndarray] = {}
    for k, c in zip(got["lang"].to_pylist(), got["counts"].to_pylist(), strict=True):
        sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)))
    counts = np.stack([sums[k] for k in languages], 1).astype(float)
    # smoothed towards the distribution over all languages, so that a rare language knows what is common
    together = counts.sum(1, keepdims=True) + 0.5
    smooth = (counts + 200 * together / together.sum()) / (counts.sum(0) + 200)
    return Model(languages, np.log(smooth))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, languages (share of each in the chosen set) for every whole text.

    ``und`` and 0 where the text is null or has no letter. Of equal shares the language first in the alphabet
    is named. Rows are independent: repeated rows repeat, null keys stay null, very long texts are read whole, an empty
    table gives an empty result, extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [shared.value.mixture(t) for t in texts_of(b["_text"])]
            yield {
                key: b[key],
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([min(1.0, max(0.0, f[1])) for f in found], pa.float64()),
                "languages": pa.array([" ".join(f"{k}:{v:.3f}" for k, v in f[2].items()) for f in found], pa.string()),
            }

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, run, f"{key} long, lang_pred string, score double, languages string")

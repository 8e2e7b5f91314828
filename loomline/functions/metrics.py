"""chrF and BLEU: n-gram statistics of a row in an Arrow function, sums and scores in built-in expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

CHRF_ORDER, CHRF_BETA, BLEU_ORDER = 6, 2, 4


def _matches(hyp: np.ndarray, ref: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """For each order n-grams in hyp, in ref, in both. An n-gram is numbered from the number of its first n - 1 items and the last one, so numbers are exact."""
    alphabet, items = np.unique(np.concatenate([hyp, ref]), return_inverse=True)
    h, r = a, b = items[: len(hyp)], items[len(hyp) :]
    out = []
    for n in range(1, longest + 1):
        if n > 1:
            a, b = a[:-1] * len(alphabet) + h[n - 1 :], b[:-1] * len(alphabet) + r[n - 1 :]
            grams = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
            a, b = grams[: len(a)], grams[len(a) :]
        size = max(a.max(initial=-1), b.max(initial=-1)) + 1
        out.append((len(a), len(b), int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum())))
    return out


def _chars(text: str) -> np.ndarray:
    return np.frombuffer("".join(text.split()).encode("utf-32-le"), np.uint32)


def _words(hyp: str, ref: str) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    h, r = (np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in (hyp, ref))
    return h, r


def chrf_counts(hyp: str, ref: str) -> list[int]:
    """For each order: n-grams in the hypothesis, in the reference, in both; blanks are left out."""
    return [x for counts in _matches(_chars(hyp), _chars(ref), CHRF_ORDER) for x in counts]


def bleu_counts(hyp: str, ref: str, tokens: str) -> list[int]:
    """Length of hypothesis and reference, then for each order n-grams matched and in the hypothesis."""
    h, r = (_chars(hyp), _chars(ref)) if tokens == "char" else _words(hyp, ref)
    return [len(h), len(r)] + [x for total, _, both in _matches(h, r, BLEU_ORDER) for x in (both, total)]


def _stats(count):
    @F.arrow_udf(ArrayType(LongType()))
    def stats(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return pa.array([None if h is None or r is None else count(h, r) for h, r in zip(hyp.to_pylist(), ref.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return stats


chrf_stats = _stats(chrf_counts)
bleu_char_stats = _stats(lambda h, r: bleu_counts(h, r, "char"))
bleu_word_stats = _stats(lambda h, r: bleu_counts(h, r, "word"))


def summed(stats: Column, size: int) -> Column:
    """Element-wise sum of a group's statistics: partial sums are small arrays' elements, combined before the shuffle."""
    return F.array(*[F.sum(stats[i]) for i in range(size)])


def chrf_score(s: Column) -> Column:
    """0 to 100: the F-score (beta 2) of precision and recall averaged over the orders that both sides have."""
    orders = F.array_compact(
        F.array(*[F.when((s[3 * n] > 0) & (s[3 * n + 1] > 0), F.struct((s[3 * n + 2] / s[3 * n]).alias("p"), (s[3 * n + 2] / s[3 * n + 1]).alias("r"))) for n in range(CHRF_ORDER)])
    )
    mean = lambda f: F.aggregate(orders, F.lit(0.0), lambda a, x: a + x[f]) / F.size(orders)
    p, r, b = mean("p"), mean("r"), CHRF_BETA**2
    return F.when(F.size(orders) == 0, 0.0).when(p + r == 0, 0.0).otherwise(100 * (1 + b) * p * r / (b * p + r))


def bleu_score(s: Column, effective: bool = False) -> Column:
    """0 to 100, with exponential smoothing of empty orders; ``effective`` counts only orders that the hypothesis has."""
    logs, smooth, orders = F.lit(0.0), F.lit(1.0), F.lit(0)
    for n in range(BLEU_ORDER):
        both, total = s[2 + 2 * n], s[3 + 2 * n]
        smooth = F.when((total > 0) & (both == 0), smooth * 2).otherwise(smooth)
        logs = logs + F.when(total == 0, 0.0).when(both == 0, F.log(100.0 / (smooth * total))).otherwise(F.log(100.0 * both / total))
        orders = orders + F.when(total > 0, 1).otherwise(0)
    over = orders if effective else F.lit(BLEU_ORDER)
    brevity = F.when(s[0] < s[1], F.exp(1 - s[1] / s[0])).otherwise(1.0)
    none = (s[0] == 0) | (orders == 0) | (s[2] == 0) | (~F.lit(effective) & (orders < BLEU_ORDER))
    return F.when(none, 0.0).otherwise(brevity * F.exp(logs / over))


def chrf_of(s: list[int]) -> float:
    """The same score of one row's statistics, in Python."""
    ps = [(s[3 * n + 2] / s[3 * n], s[3 * n + 2] / s[3 * n + 1]) for n in range(CHRF_ORDER) if s[3 * n] and s[3 * n + 1]]
    if not ps:
        return 0.0
    p, r, b = math.fsum(x for x, _ in ps) / len(ps), math.fsum(x for _, x in ps) / len(ps), CHRF_BETA**2
    return 100 * (1 + b) * p * r / (b * p + r) if p + r else 0.0

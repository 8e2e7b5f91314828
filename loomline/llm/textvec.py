"""Vectorised word and shingle hashes: numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 19
_powers: list[np.ndarray] = []

#: ``[^\x20\x09-\x0D]+`` words, A-Z lower-cased.
PLAIN = bytes(range(256)).lower()
#: Words of letters and digits, lower-cased: ASCII punctuation and control characters count as blanks too.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(_SEGMENT + (1 << 16), n)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=_U))
    return _powers


def _hash_segment(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], _BLANK[a], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(a))
    total = np.zeros(len(a) + 1, _U)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))), starts


def word_hashes(texts: Sequence[str], table: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, index of each text's first word and the end)."""
    parts = [(t.lower() if table is ALNUM else t).encode("utf-8", "surrogatepass").translate(table) for t in texts]
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    buffer = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = min(at + _SEGMENT, len(buffer))
        while end < len(buffer):  # a segment ends at a blank; very long words stay whole
            blank = np.flatnonzero(_BLANK[buffer[end : end + 4096]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(end + 4096, len(buffer))
        h, s = _hash_segment(buffer[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _fold(state: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(state * _U(0xA24BAED4963EE407) + more)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, one per starting word (the last n-1 runs are left out)."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = mix(hashes[: len(hashes) - n + 1] + _U(n))
    for j in range(1, n):
        out = _fold(out, hashes[j : len(hashes) - n + 1 + j])
    return out


def shingle_sets(texts: Sequence[str], n: int, table: bytes = PLAIN) -> list[np.ndarray]:
    """Per text the sorted distinct ``n``-word shingles; a shorter text's whole sequence is its only one; none without words."""
    words, at = word_hashes(texts, table)
    runs = ngrams(words, n)
    out = []
    for i in range(len(texts)):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo >= n:
            s = np.sort(runs[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            out.append(ngrams(words[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, _U))
    return out

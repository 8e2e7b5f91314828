"""Secret scanning: assignment, access-key and hex patterns, and a token-efficiency test for random strings.

Ordinary words and code take few tokens for their length under a vocabulary learnt from text; random strings take many.
A run of key characters whose characters per token fall under a threshold is reported, unless it is a digest or an
identifier of a known form.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts_of

# The base patterns, each with the least length of what it finds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # leftmost matches of [0-9a-f]+ are whole runs, so the least length can stand in the pattern
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

# Whole runs of key characters, of letters alone too: words take few tokens, so the ratio keeps them out. Runs joined by dots are
# one run and its parts.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{4,11}(?:\.[A-Za-z0-9+/_=-]{4,11}){2,}(?![A-Za-z0-9+/_=.-])")
#: Runs shorter than this count only with capitals, small letters and digits in them, and at a lower ratio.
LONG, MIXED = 12, re.compile(r"(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])")
# Known digests and identifiers: hex strings of a digest's length in one case, UUIDs, digests named by their function in hex or base64
# of their length, decimal numbers and dates.
_DIGESTS = "|".join(f"[0-9{c}]{{{n}}}" for c in ("a-f", "A-F") for n in (32, 40, 56, 64, 96, 128))
_WORD = r"(?:[A-Za-z][a-z]{0,18}|[A-Z]{1,19})(?![A-Za-z])"
_KNOWN = re.compile(
    rf"{_DIGESTS}|[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|[0-9_+/=-]+|"
    + "|".join(rf"{name}[-=_]?(?:[0-9a-f]{{{bits // 4}}}|[0-9A-F]{{{bits // 4}}}|[A-Za-z0-9+/]{{{-(-bits // 6)}}}={{0,2}})" for name, bits in (("md5", 128), ("sha1", 160), ("sha256", 256), ("sha384", 384), ("sha512", 512)))
)
# Slugs: two or more words, each in one case but for a capital at the start; random if the words themselves tokenize badly.
_SLUG = re.compile(rf"[/=_+-]*{_WORD}([/=_+-]+({_WORD}|[0-9]{{1,6}}))+[/=_+-]*")
_LETTERS = re.compile("[A-Za-z]+")
# A single word, in one case but for a capital at the start, must tokenize worse to count as random.
_ONE_WORD = re.compile(rf"[/=_+-]*{_WORD}[/=_+-]*")


@lru_cache(maxsize=2)
def vocabulary(file: str, pattern: str):
    """A tiktoken encoding from a file of ranks, one a worker process."""
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order of start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def merged_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What ``spans`` cover, as ranges in order that don't overlap."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def is_random(run: str, encode, most_chars_per_token: float, most_of_words: float, most_of_short: float = 1.7, most_of_slugs: float = 1.8) -> bool:
    """Whether a run of key characters tokenizes as badly as random strings do, and is no known digest or identifier.

    A slug goes by its words of three letters or more, each tokenized apart, as its separators take tokens of their own.
    """
    if len(run) < LONG:
        return MIXED.match(run) is not None and len(run) / len(encode(run)) <= most_of_short and not _KNOWN.fullmatch(run)
    if len(run) / len(encode(run)) > most_chars_per_token or _KNOWN.fullmatch(run):
        return False
    if _ONE_WORD.fullmatch(run):
        return len(run) / len(encode(run)) <= most_of_words
    if _SLUG.fullmatch(run):
        words = [w for w in _LETTERS.findall(run) if len(w) > 2]
        letters = sum(map(len, words))
        return letters >= 10 and letters / sum(len(encode(w)) for w in words) <= most_of_slugs
    return True


def random_spans(text: str, taken: list[tuple[int, int, str]], encode, most_chars_per_token: float, most_of_words: float, most_of_short: float = 1.7, most_of_slugs: float = 1.8) -> list[tuple[int, int, str]]:
    """Runs of key characters that overlap no span of ``taken`` and are random; of a dotted run the whole, where most of its parts mix letters and digits and it is random without its dots."""
    out, at = [], 0
    covered = merged_spans(taken)
    dotted = [m.span() for m in _DOTTED.finditer(text) if 2 * sum(not p.isalpha() and not p.isdigit() for p in m.group().split(".")) > m.group().count(".") + 1 and is_random(m.group().replace(".", ""), encode, most_chars_per_token, most_of_words, most_of_short, most_of_slugs)]
    runs = sorted([*dotted, *(m.span() for m in _RUN.finditer(text))], key=lambda x: (x[0], -x[1]))
    whole, last = set(dotted), 0
    for s, e in runs:
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        if s < last or at < len(covered) and covered[at][0] < e:
            continue
        if (s, e) in whole or is_random(text[s:e], encode, most_chars_per_token, most_of_words, most_of_short, most_of_slugs):
            out.append((s, e, "random"))
            last = e
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, ranks: str, pattern: str, most_chars_per_token: float = 2.0, most_of_words: float = 1.6, most_of_short: float = 1.7, most_of_slugs: float = 1.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, n_random, base_sha256, spans for every whole text.

    Spans are code points with an exclusive end, by start, then kind. A run of 12 or more key characters is ``random`` at
    ``most_chars_per_token`` or less, one that reads as a word at ``most_of_words`` or less, as words joined (a slug) at
    ``most_of_slugs`` or less over its words, one of 8 to 11 characters of three kinds at ``most_of_short`` or less. A null or empty text has none,
    and an empty table no rows. Rows are independent: repeated rows repeat, null keys stay null, very long texts are
    scanned whole in time that grows with their length, extra columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encode = vocabulary(ranks, pattern).encode_ordinary
        for b in batches:
            rows = []
            for t in texts_of(b["_text"]):
                base = base_spans(t)
                found = random_spans(t, base, encode, most_chars_per_token, most_of_words, most_of_short, most_of_slugs)
                spans = sorted([*base, *found], key=lambda x: (x[0], KINDS.index(x[2])))
                kinds = [k for _, _, k in spans]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield {
                    key: b[key],
                    **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, cols, strict=False)},
                    "base_sha256": pa.array(cols[4], pa.string()),
                    "spans": pa.array(cols[5], pa.string()),
                }

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, run, f"{key} long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")

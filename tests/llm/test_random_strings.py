"""Random strings by shape: how many are found, what is left alone, and the spans against a scan character by character."""

import random
import re
import string

import public_tokenizers
import pytest

from loomline.llm import secrets

L, U, D = string.ascii_lowercase, string.ascii_uppercase, string.digits
B = L + U + D
KEY = set(B + "+/_=-")


@pytest.fixture(scope="module")
def encode():
    return secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary


SHAPES = {
    "five groups of five capitals": (lambda r: "-".join(r(U, 5) for _ in range(5)), 0.97), "five groups of capitals and digits": (lambda r: "-".join(r(U + D, 5) for _ in range(5)), 0.99),
    "four groups of four small letters": (lambda r: "-".join(r(L, 4) for _ in range(4)), 0.9), "two groups of twelve": (lambda r: f"{r(L, 12)}-{r(L, 12)}", 0.7), "named like a digest": (lambda r: "md5" + r(B, 30), 0.99),
    "eight mixed": (lambda r: r(B, 8), 0.65), "eleven mixed": (lambda r: r(B, 11), 0.7), "twelve mixed": (lambda r: r(B, 12), 0.99), "dotted": (lambda r: ".".join(r(B, 10) for _ in range(4)), 0.97),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_recall_by_shape(encode, shape):
    make, least = SHAPES[shape]
    rng = random.Random(shape)
    texts = [f"see {make(lambda a, k: ''.join(rng.choices(a, k=k)))} here" for _ in range(200)]
    assert sum(bool(secrets.random_spans(t, secrets.base_spans(t), encode, 2.0, 1.6)) for t in texts) / 200 >= least


@pytest.mark.parametrize("known", ["md5-" + "0f" * 16, "sha256=" + "Ab1+" * 10 + "xyz=", "550e8400-e29b-41d4-a716-446655440000", "2024-01-31-2024-02-01", "the-quick-brown-fox-jumps", "README_first_thing", "well-known-and-long-slug-2024", "www.example.com.path.name", "iPhone12S", "version.10.2.13.build", "internationalization"])
def test_known_forms_and_words_are_left_alone(encode, known):
    assert secrets.random_spans(f"a {known} b", secrets.base_spans(known), encode, 2.0, 1.6) == []


def plain_spans(text, encode):
    """Every maximal run of key characters, found character by character; dotted runs first."""
    runs, i = [], 0
    while i < len(text):
        if text[i] in KEY:
            j = i
            while j < len(text) and text[j] in KEY:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    out, k = [], 0
    while k < len(runs):
        m = k
        while m + 1 < len(runs) and runs[m + 1][0] == runs[m][1] + 1 and text[runs[m][1]] == ".":
            m += 1
        parts = [text[a:b] for a, b in runs[k : m + 1]]
        s, e = runs[k][0], runs[m][1]
        edge = (s == 0 or text[s - 1] != ".") and (e == len(text) or text[e] != ".")
        mixed = sum(not p.isalpha() and not p.isdigit() for p in parts)
        if len(parts) > 2 and edge and all(4 <= len(p) <= 11 for p in parts) and 2 * mixed > len(parts) and secrets.is_random("".join(parts), encode, 2.0, 1.6):
            out.append((s, e, "random"))
        else:
            out += [(a, b, "random") for a, b in runs[k : m + 1] if b - a >= 8 and secrets.is_random(text[a:b], encode, 2.0, 1.6)]
        k = m + 1
    return out


def test_spans_match_a_plain_scan(encode):
    rng = random.Random(7)
    word = lambda: rng.choice(["hello", "the", "Running", "x", "state-of-the-art", "a.b.c", "3.14", "é", "end."])
    for _ in range(300):
        bits = [rng.choice([word, lambda: "".join(rng.choices(B, k=rng.randrange(3, 30))), lambda: ".".join("".join(rng.choices(B, k=rng.randrange(3, 13))) for _ in range(rng.randrange(2, 5))), lambda: "".join(rng.choices(B + "+/_=-.", k=25))])() for _ in range(12)]
        text = re.sub("AKIA", "akia", rng.choice([" ", ", ", " ... "]).join(bits))
        assert secrets.random_spans(text, [], encode, 2.0, 1.6) == plain_spans(text, encode)

"""Exact tokenization through the tokenizers library, remembering the ids of pieces between blanks.

A tokenizer that never joins characters across certain blanks gives a text the same ids as its pieces one by one. The
ids of frequent pieces are kept, so only pieces not seen before go through the merges.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import islice

import numpy as np

#: Ids remembered in a worker: of at most so many pieces when a batch begins, some 180 bytes each, unless an encoder is given
#: another number. Over that, the earliest half stays, as frequent ones come early.
MOST_PIECES = 900_000
_SINGLE_BLANK = re.compile(r"(?<=\S)(?= \S)")
#: Marks that the tokenizers' patterns part from letters before them, also in runs; the apostrophe isn't one.
_MARKS = ".,!?;:"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: itself if printable, else the next one from U+0100 on. By code point of Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
#: Latin letters are in NFC and have simple lower cases, but for the dotted capital I; others take the tokenizer's whole way.
_LATIN_END, _DOTTED = "\u0250", "\u0130"


class _Words(dict):
    """Ids of single words by text, each as it is encoded after ``prefix``.

    A word of Latin letters is one piece for the tokenizers' patterns, so it goes to the merges directly.
    """

    def __init__(self, tokenizer, prefix: str, lower: bool, most: int):
        super().__init__()
        self.tokenizer, self.prefix, self.lower, self.most, self.merge = tokenizer, prefix, lower, most, tokenizer.model.tokenize
        self.start = prefix.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def forget(self) -> None:
        if len(self) > self.most:
            kept = dict(islice(self.items(), self.most // 2))
            self.clear()
            self.update(kept)

    def learn(self, words: set[str]) -> None:
        others = []
        merge, start, lower = self.merge, self.start, self.lower
        for w in words:
            if w in self:
                continue
            if not w.isalpha():
                others.append(w)
                continue
            if w.isascii():
                low = letters = w.lower() if lower else w
            elif max(w) < _LATIN_END and _DOTTED not in w:
                low = w.lower() if lower else w
                letters = low.encode().decode("latin-1").translate(_BYTE_LETTERS)
            else:
                others.append(w)
                continue
            if low is w or (found := self.get(low)) is None:
                self[low] = found = array("I", [k.id for k in merge(start + letters)]).tobytes()
            self[w] = found
        if others:
            encoded = self.tokenizer.encode_batch_fast([self.prefix + w for w in others], add_special_tokens=False)
            for w, e in zip(others, encoded, strict=True):
                self[w] = array("I", e.ids).tobytes()


def _ends_in_letter(word: str) -> bool:
    """Whether a word still ends in a letter once it is composed and lower-cased; else a mark of its last letter joins what follows."""
    return word[-1].isascii() or unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, file: str, blanks_dropped: bool, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        # a text that may hold a token's own spelling, such as an end mark's, is encoded whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.hint = re.match(r"[\W\d_]*", os.path.commonprefix(added)).group()  # what is alike in either case
        self.blanks_dropped = blanks_dropped
        self.spaced = _Words(self.tokenizer, "" if blanks_dropped else " ", blanks_dropped, most)
        self.bare = self.spaced if blanks_dropped else _Words(self.tokenizer, "", False, most)
        #: Pieces that follow a space, words and others alike; None marks one that no split gives apart.
        self.known: dict[str, bytes | None] = self.spaced

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that follow a space. A word and the marks after it are encoded apart, and so are lines."""
        spaced, bare = self.spaced, self.bare
        words, marks, ended, others = set(), set(), [], []
        for p in pieces:
            if p.isalpha():
                words.add(p)
                continue
            word = p.rstrip(_MARKS)
            if word.isalpha() and _ends_in_letter(word):
                mark = p[len(word) :]
                words.add(word)
                marks.add(mark)
                ended.append((p, word, mark))
            else:
                others.append((p, self._lines(p)))
        for _, steps in others:
            words.update(w for own, w in steps if own is spaced)
            marks.update(w for own, w in steps if own is not spaced)
        if spaced is bare:
            words |= marks
        spaced.learn(words)
        bare.learn(marks)
        for p, word, mark in ended:
            spaced[p] = spaced[word] + bare[mark]
        for p, steps in others:
            spaced[p] = b"".join([own[w] for own, w in steps])

    def _lines(self, piece: str) -> list[tuple[_Words, str]]:
        out: list[tuple[_Words, str]] = []
        for i, line in enumerate(piece.split("\n")):
            own = self.bare if i else self.spaced
            if i:
                out.append((self.bare, "\n"))
            word = line.rstrip(_MARKS)
            if word.isalpha() and _ends_in_letter(word):
                out.append((own, word))
                if len(word) < len(line):
                    out.append((self.bare, line[len(word) :]))
            elif line and not (line[0].isspace() or line[-1].isspace()):
                out.append((own, line))
            else:  # an empty line or a blank at an edge: blanks join
                return [(self.spaced, piece)]
        return out

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        self.spaced.forget()
        self.bare.forget()
        whole = [i for i, t in enumerate(texts) if self.added and self.hint in t and self.added.search(t)]
        if whole:
            apart = set(whole)
            rest = [t for i, t in enumerate(texts) if i not in apart]
            out = self.encode(rest) if rest else []
            for i in whole:
                out.insert(i, self._plain(texts[i]))
            return out
        gc.disable()  # nothing here is cyclic, and each pass would walk all pieces
        try:
            return self._word_level(texts) if self.blanks_dropped else self._byte_level(texts)
        finally:
            gc.enable()

    def _unknown(self, parts: list[list[str]]) -> set[str]:
        known = self.known
        return {p for some in parts for p in some if p not in known}

    def _word_level(self, texts: Sequence[str]) -> list[bytes]:
        """Blanks end a token and are dropped: split at each space and line feed; other blanks stay inside a piece."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        get = self.known.get
        found = [list(map(get, p)) for p in parts]
        lacking = [k for k, f in enumerate(found) if None in f]
        self._learn({p for k in lacking for p, ids in zip(parts[k], found[k], strict=True) if ids is None})
        for k in lacking:
            found[k] = [get(p) if ids is None else ids for p, ids in zip(parts[k], found[k], strict=True)]
        return list(map(b"".join, found))

    def _byte_level(self, texts: Sequence[str]) -> list[bytes]:
        """A space between two other characters starts a token: split before it.

        Pieces are known without their space. A piece that is empty or has a blank at either end shows that the text has
        longer runs of blanks; such a text is split only before single spaces, by a pattern.
        """
        parts = [t.split(" ") for t in texts]
        firsts = [p.pop(0) for p in parts]
        new = self._unknown(parts)
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        self._learn(new - odd)
        self.known.update(dict.fromkeys(odd))
        get = self.known.__getitem__
        out = []
        for t, first, p in zip(texts, firsts, parts, strict=True):
            if p and (not first or first[-1].isspace()):
                out.append(self._by_pattern(t))
                continue
            try:
                rest = b"".join(map(get, p))
            except TypeError:  # a piece that is None
                out.append(self._by_pattern(t))
            else:
                out.append((self._plain(first) if first else b"") + rest)
        return out

    def _by_pattern(self, text: str) -> bytes:
        first, *rest = _SINGLE_BLANK.split(text)
        new = {p[1:] for p in rest if p[1:] not in self.known}
        self._learn({p for p in new if not p[-1].isspace()})
        return self._plain(first) + b"".join(self._plain(p) if p[-1].isspace() else self.known[p[1:]] for p in rest)


@lru_cache(maxsize=4)
def piece_encoder(file: str, blanks_dropped: bool, most: int = MOST_PIECES) -> PieceEncoder:
    """One encoder a file and worker process."""
    return PieceEncoder(file, blanks_dropped, most)

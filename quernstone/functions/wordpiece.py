"""WordPiece: basic tokenisation, then the longest known pieces from the left, for all words of a batch together.

Words of a batch advance side by side: of each, the substrings at its place, longest first, are looked up by hash among the
vocabulary's sorted hashes, and what is found is compared with the piece itself.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

CONTINUED, LONGEST = "##", 200
_BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


@functools.cache
def _classes() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Characters that go, that are white space, that stand alone, and marks."""
    gone, space, alone, marks = [], [], [], []
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        kind = unicodedata.category(c)
        if kind == "Zs" or c in "\t\n\r":
            space.append(k)
        elif kind in ("Cc", "Cf", "Co", "Cs", "Zl", "Zp") or k in (0, 0xFFFD):
            gone.append(k)
        elif kind[0] == "P" or 33 <= k <= 126 and not c.isalnum():
            alone.append(k)
        elif kind == "Mn":
            marks.append(k)
    # blocks of characters that are words each
    for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F)):
        alone.extend(range(lo, hi + 1))
    return tuple(re.compile(f"[{_ranges(sorted(set(x)))}]") for x in (gone, space, alone, marks))


def _ranges(codes: list[int]) -> str:
    out, k = [], 0
    while k < len(codes):
        e = k
        while e + 1 < len(codes) and codes[e + 1] == codes[e] + 1:
            e += 1
        out.append(f"\\U{codes[k]:08x}" + (f"-\\U{codes[e]:08x}" if e > k else ""))
        k = e + 1
    return "".join(out)


def basic(text: str | None, lower: bool = True) -> list[str]:
    """Words: controls go, white space parts, accents and case go, punctuation marks and Chinese characters stand alone."""
    gone, space, alone, marks = _classes()
    t = space.sub(" ", gone.sub("", text or ""))
    if lower:
        t = marks.sub("", unicodedata.normalize("NFD", t.lower()))
    return alone.sub(lambda m: f" {m[0]} ", t).split()


class Pieces:
    """A vocabulary's pieces by hash."""

    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]"):
        self.unknown = vocabulary[unknown]
        self.sides = []
        for inner in (False, True):
            known = {w.removeprefix(CONTINUED) if inner else w: i for w, i in vocabulary.items() if w.startswith(CONTINUED) == inner and (not inner or len(w) > 2)}
            words = [w for w in known if 0 < len(w) <= LONGEST]
            h = self._hash(words)
            order = np.argsort(h, kind="stable")
            self.sides.append((h[order], np.array([known[w] for w in words], np.int64)[order], [words[k] for k in order]))
        self.longest = max([1, *(len(w) for _, _, words in self.sides for w in words)])

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points, a row a word, and lengths."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), max(1, int(size.max(initial=1)))), U64)
        if len(words):
            out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return out, size

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        """Prefix hashes: h(k + 1) = h(k) * base + code + 1."""
        out = np.zeros((len(codes), codes.shape[1] + 1), U64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * U64(_BASE) + codes[:, k] + U64(1)
        return out

    def _hash(self, words: list[str]) -> np.ndarray:
        codes, size = self._codes(words)
        return self._sums(codes)[np.arange(len(words)), size]

    def split(self, words: list[str]) -> list[list[int]]:
        """The ids of each word's pieces; the unknown one's for a word that has no such pieces, or is too long."""
        out: list[list[int]] = [[] for _ in words]
        fit = [k for k, w in enumerate(words) if 0 < len(w) <= LONGEST]
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                out[k] = [self.unknown]
        if not fit:
            return out
        codes, size = self._codes([words[k] for k in fit])
        sums, power = self._sums(codes), np.full(codes.shape[1] + 1, _BASE, U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        at, live = np.zeros(len(fit), np.int64), np.arange(len(fit))
        while len(live):
            piece, length = np.full(len(live), -1, np.int64), np.zeros(len(live), np.int64)
            for n in range(min(self.longest, int((size[live] - at[live]).max())), 0, -1):
                rows = np.flatnonzero((length == 0) & (at[live] + n <= size[live]))
                for inner in (False, True):
                    some = rows[(at[live[rows]] > 0) == inner]
                    held, ids, pieces = self.sides[inner]
                    if not len(some) or not len(held):
                        continue
                    r, a = live[some], at[live[some]]
                    h = sums[r, a + n] - sums[r, a] * power[n]
                    spot = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    for j in np.flatnonzero(held[spot] == h):
                        if pieces[spot[j]] == words[fit[r[j]]][a[j] : a[j] + n]:
                            piece[some[j]], length[some[j]] = ids[spot[j]], n
            for j, k in enumerate(live):
                if length[j]:
                    out[fit[k]].append(int(piece[j]))
                else:
                    out[fit[k]] = [self.unknown]
            at[live] += length
            live = live[(length > 0) & (at[live] < size[live])]
        return out


#: Texts whose words are held together.
HELD = 256


def encoding(vocabulary: dict[str, int], limit: int = 256, pad: bool = False, lower: bool = True):
    """A function from batches of texts to frames of ids and mask. Of a batch only the numbers are held whole, four bytes each."""
    cls, sep = vocabulary["[CLS]"], vocabulary["[SEP]"]
    fill = vocabulary.get("[PAD]", 0)

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, known = Pieces(vocabulary), {}
        for texts in batches:
            rows = []
            for at in range(0, len(texts), HELD):
                each = [basic(t, lower) for t in texts.iloc[at : at + HELD]]
                if len(known) > 1 << 18:
                    known.clear()
                new = list({w for words in each for w in words if w not in known})
                known.update(zip(new, pieces.split(new), strict=True))
                for words in each:
                    ids = [i for w in words for i in known[w]][: limit - 2]
                    ids = [cls, *ids, sep]
                    more = limit - len(ids) if pad else 0
                    rows.append((np.array(ids + [fill] * more, np.int32), np.array([1] * len(ids) + [0] * more, np.int32)))
            yield pd.DataFrame(rows, columns=["ids", "mask"], index=texts.index)

    return encoded


def encoder(vocabulary: dict[str, int], limit: int = 256, pad: bool = False, lower: bool = True):
    """A function from a column of texts to a struct of ids and mask: [CLS], the pieces, [SEP], cut at ``limit`` in all, and
    with ``pad`` filled up to it by [PAD], whose mask is 0. The vocabulary is a file of bounded size, loaded once a task."""
    encoded = encoding(vocabulary, limit, pad, lower)

    # pandas_udf() reads the kinds of its arguments from this
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return encoded(batches)

    return lambda column: F.pandas_udf(encode, "struct<ids: array<int>, mask: array<int>>")(column)


def vocabulary_of(texts, column: str, most: int = 30_000):
    """A DataFrame (piece, id) for texts without a vocabulary of their own: marks, single characters, and the most frequent
    words; ``most`` bounds the words."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    frequent = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    letters = words.select(F.explode(F.array_distinct(F.split("w", ""))).alias("w")).where("w <> ''").distinct()
    return frequent.select("w").union(letters).union(letters.select(F.concat(F.lit(CONTINUED), "w"))).distinct()

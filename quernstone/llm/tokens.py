"""Ids by a public tokenizer, with a bounded memory of what it has said.

A space between two characters that are not white space always begins a new pretoken of a byte-level
BPE, so a text can be cut there and the ids of its parts put together. Parts recur, and most are
words: they are found by a 64-bit hash among those that this worker has met, and only new ones go to
the tokenizer, all of a stretch of text in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .text import U64, buffers, rolling, runs, spans_hash

#: Bytes of remembered parts, about, at which a worker starts anew.
REMEMBERED = 48 << 20
STRETCH = 1 << 20
# white space and control characters; leading bytes of characters that may be white space
_ODD = np.zeros(256, bool)
_ODD[: 0x21] = _ODD[0x7F] = True
_ODD_NEXT = _ODD.copy()
_ODD_NEXT[0x80:0xC3] = _ODD_NEXT[0xE1:0xE4] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True


def part_starts(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the parts of documents begin in b; first: where non-empty documents do."""
    at = np.flatnonzero(b == 0x20)
    at = at[(at > 1) & (at < len(b) - 1)]
    before = b[at - 1]
    ok = ~_ODD_NEXT[b[at + 1]] & ((before < 0x80) & ~_ODD[before] | (before >= 0x80) & _TWO[b[at - 2]])
    at = at[ok]
    # a space at an edge of a document, or right after its first character, stays in its part
    mark = np.zeros(len(b) + 2, bool)
    mark[first] = mark[first + 1] = mark[np.append(first[1:], len(b)) - 1] = True
    at = at[~mark[at] & ~mark[at - 1]]
    mark[:] = False
    mark[at] = mark[first] = True
    return np.flatnonzero(mark)


class PartEncoder:
    """Encodes columns part by part; how texts are cut and parts encoded is for the subclass to say."""

    #: Whether a text's first part differs from the same part elsewhere.
    first_differs = False

    def __init__(self) -> None:
        self.forget()

    def starts(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where parts begin in the bytes b; first: where non-empty texts do."""
        raise NotImplementedError

    def encode_parts(self, parts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each part, and all ids."""
        raise NotImplementedError

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        #: Hash, place in flat and number of ids of each part: many sorted ones, and the latest.
        self.old, self.new = (none.astype(U64), none, none), (none.astype(U64), none, none)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Fills in what is known of sorted distinct keys; says which are."""
        found = np.zeros(len(keys), bool)
        for have, s, m in (self.old, self.new):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                ok = have[at] == keys
                start[ok], n[ok] = s[at[ok]], m[at[ok]]
                found |= ok
        return found

    def _learn(self, keys: np.ndarray, parts: list[bytes], first: np.ndarray) -> None:
        n, ids = self.encode_parts(parts, first)
        self.new = self._merged(self.new, (keys, len(self.flat) + np.cumsum(n) - n, n))
        self.flat = np.concatenate([self.flat, ids])
        if len(self.new[0]) > 1 << 16:
            self.old, self.new = self._merged(self.old, self.new), tuple(x[:0] for x in self.new)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        data, offsets = buffers(column)
        for i, j in runs(offsets, STRETCH):
            if 24 * len(self.old[0]) + self.flat.nbytes > REMEMBERED:
                self.forget()
            b, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(b):
                yield from (np.zeros(0, np.uint32) for _ in range(i, j))
                continue
            first = bounds[:-1][bounds[:-1] < bounds[1:]]
            start = self.starts(b, first)
            end = np.append(start[1:], len(b))
            h = spans_hash(rolling(b), start, end)
            leads = np.zeros(len(start), bool)
            if self.first_differs:
                leads[np.searchsorted(start, first)] = True
                h[leads] ^= U64(0xA0761D6478BD642F)
            keys, some, back = np.unique(h, return_index=True, return_inverse=True)
            place, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            unknown = np.flatnonzero(~self._find(keys, place, n))
            if len(unknown):
                raw = b.tobytes()
                where = some[unknown]
                self._learn(keys[unknown], [raw[x:y] for x, y in zip(start[where].tolist(), end[where].tolist(), strict=True)], leads[where])
                self._find(keys, place, n)
            m = n[back]
            stop = np.cumsum(m)
            out = self.flat[np.repeat(place[back] - (stop - m), m) + np.arange(stop[-1])]
            edges = np.concatenate([[0], stop])[np.searchsorted(start, bounds)].tolist()
            yield from (out[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))


class BpeEncoder(PartEncoder):
    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(self.tokenizer.get_vocab_size())])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def starts(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        return part_starts(b, first)

    def encode_parts(self, parts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts that begin with their only space are encoded together: there, and only there, does an
        id begin with a space."""
        plain = np.array([p.rfind(b" ") == 0 for p in parts], bool)
        ids = self.ids(b"".join(p for p, ok in zip(parts, plain, strict=True) if ok).decode())
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != plain.sum():
            raise ValueError("this tokenizer doesn't begin a new id at each space")
        runs = np.diff(np.append(at, len(ids)))
        other = [self.ids(parts[k].decode()) for k in np.flatnonzero(~plain)]
        # the ids in the order of the parts
        n, place = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        n[plain], place[plain] = runs, at
        n[~plain] = [len(x) for x in other]
        place[~plain] = len(ids) + np.cumsum(n[~plain]) - n[~plain]
        ids = np.concatenate([ids, *other])
        return n, ids[np.repeat(place - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """One encoder a worker process."""
    return BpeEncoder(path)

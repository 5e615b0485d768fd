"""SentencePiece encoding and decoding by batched numpy passes: merges for BPE models, else a Viterbi.

The pieces and scores of a public model are given; nothing is trained. A text is one space and its
characters; a space reads as U+2581 where pieces are matched. No piece has that sign after another
character, so the segmentation of a text is that of its words (a run of spaces and what follows
up to the next). New words of a stretch of text are grouped by length, and words of one length
advance together, by hashes of substrings that probe the sorted piece keys. Words that a worker has
met are remembered by their hashes.

The scores of a BPE model order merges: characters are joined, each time the two neighbours whose
piece has the greatest score, the leftmost of equal ones, until no two make a piece. Each round joins
one pair of every word of a group; words above LONG characters are joined one by one, from a heap.

Scores of other models are log-probabilities: segmentations have the greatest sum; of equal ones, at
each end the longest last piece. For blocks of ends, vectorised maxima keep the best score and its
start; a character that no piece of its own covers counts the least score less 10 a byte.

Such a character is spelled in byte pieces. Decoding is exact for every text: also U+2581 itself,
which is always spelled in bytes (the library reads it as a space).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .text import U64, mix, powers
from .tokens import PartEncoder

SPACE = "▁"
#: Stands for U+2581 in a text while pieces are matched; no piece has it.
TAKEN = 0x10FFFF
#: A word of more characters is merged by itself: a round for each merge of so few words costs more than a heap.
LONG = 128


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class Pieces(PartEncoder):
    first_differs = True

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as f:
            trained = ModelProto.FromString(f.read()).trainer_spec
        #: Whether scores order merges.
        self.merges = trained.model_type == trained.BPE
        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_: list[bytes] = [b""] * size
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        keys, scores, ids = [], [], []
        self.longest = 1
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.bytes_[i], self.byte_ids[value] = bytes([value]), i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)) and SPACE not in name.lstrip(SPACE):
                self.bytes_[i] = name.replace(SPACE, " ").encode()
                keys.append(name)
                scores.append(model.get_score(i))
                ids.append(i)
                self.longest = max(self.longest, len(name))
        lengths = np.array([len(k) for k in keys])
        c = self._sums(_codes(keys)[None])[0]
        end = np.cumsum(lengths)
        h = self._key(c[end - lengths], c[end], end - lengths, lengths)
        order = np.argsort(h)
        self.keys, self.scores, self.ids = h[order], np.array(scores)[order], np.array(ids)[order]
        self.unknown = float(min(scores)) - 10
        # for words merged by themselves: places in the order of merges, equal for equal scores, and ids
        _, place = np.unique(-np.array(scores), return_inverse=True)
        self.named = dict(zip(keys, zip(place.tolist(), ids, strict=True), strict=True))
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_), np.uint8)
        self.sizes = np.array([len(x) for x in self.bytes_])
        self.places = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _sums(w: np.ndarray) -> np.ndarray:
        """Rolling sums of each row of code points."""
        out = np.zeros((w.shape[0], w.shape[1] + 1), U64)
        np.cumsum(mix(w.astype(U64) + U64(77)) * powers(w.shape[1] + 1)[0][: w.shape[1]], axis=1, out=out[:, 1:])
        return out

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, length: np.ndarray | int) -> np.ndarray:
        return mix((b - a) * powers(int(np.max(start)) + 2)[1][start] + np.asarray(length, U64))

    def starts(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        mark = b == 0x20
        mark[1:] &= b[:-1] != 0x20
        mark[first] = True
        # a leading run of spaces belongs to the text's first part, so the word's mark after it stays off
        return np.flatnonzero(mark)

    def encode_parts(self, parts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [(" " if lead else "") + p.decode() for p, lead in zip(parts, first, strict=True)]
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        segment = self.merge if self.merges else self.viterbi
        for length, rows in by_length.items():
            step = max(1, (1 << 18) // length)
            for at in range(0, len(rows), step):
                group = rows[at : at + step]
                for k, ids in zip(group, segment([words[k] for k in group], length), strict=True):
                    out[k] = ids
        return np.array([len(x) for x in out], np.int64), np.concatenate(out)

    def _probe(self, c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that end there in each word, the longest first; -inf for none."""
        gain = np.full((len(c), len(ends), self.longest), -np.inf)
        ids = np.full(gain.shape, -1, np.int32)
        for size in range(1, self.longest + 1):
            e = ends[ends >= size]
            h = self._key(c[:, e - size], c[:, e], e - size, size) if len(e) else np.zeros((len(c), 0), U64)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            held = self.keys[at] == h
            gain[:, len(ends) - len(e) :, self.longest - size] = np.where(held, self.scores[at], -np.inf)
            ids[:, len(ends) - len(e) :, self.longest - size] = np.where(held, self.ids[at], -1)
        return gain, ids

    def viterbi(self, words: list[str], length: int) -> list[np.ndarray]:
        """The ids of words of one length."""
        n = len(words)
        w = _codes(words).reshape(n, length).copy()
        w[w == ord(SPACE)] = TAKEN
        w[w == 0x20] = ord(SPACE)
        c = self._sums(w)
        width = 1 + (w > 0x7F) + (w > 0x7FF) + (w > 0xFFFF)
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1)
        rows, block = np.arange(n), max(1, (1 << 20) // (n * self.longest))
        for first in range(1, length + 1, block):
            ends = np.arange(first, min(first + block, length + 1))
            gain, ids = self._probe(c, ends)
            for j, e in enumerate(ends.tolist()):
                lo = max(0, e - self.longest)
                x = best[:, lo:e] + gain[:, j, self.longest - e + lo :]
                at = x.argmax(1)
                top, found = x[rows, at], ids[rows, j, self.longest - e + lo + at]
                spelled = best[:, e - 1] + self.unknown * width[:, e - 1]
                worse = spelled > top
                best[:, e] = np.where(worse, spelled, top)
                back[:, e] = np.where(worse, e - 1, lo + at)
                piece[:, e] = np.where(worse, -1, found)
        taken: list[list[int]] = [[] for _ in range(n)]
        row, pos = np.arange(n), np.full(n, length)
        while len(row):
            p = piece[row, pos]
            for r, i, e in zip(row.tolist(), p.tolist(), pos.tolist(), strict=True):
                if i >= 0:
                    taken[r].append(i)
                else:
                    taken[r] += self.byte_ids[list(words[r][e - 1].encode())].tolist()[::-1]
            pos = back[row, pos]
            row, pos = row[pos > 0], pos[pos > 0]
        return [np.array(t[::-1], np.uint32) for t in taken]

    def _pieces(self, c: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces [start, end) of rows; -inf and -1 for none."""
        if not len(start):
            return np.zeros(0), np.zeros(0, np.int32)
        h = self._key(c[row, start], c[row, end], start, end - start)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        held = self.keys[at] == h
        return np.where(held, self.scores[at], -np.inf), np.where(held, self.ids[at], -1)

    def merge(self, words: list[str], length: int) -> list[np.ndarray]:
        """The ids of words of one length, by a BPE model's merges."""
        if length > LONG:
            return [self._merge_long(w) for w in words]
        n = len(words)
        w = _codes(words).reshape(n, length).copy()
        w[w == ord(SPACE)] = TAKEN
        w[w == 0x20] = ord(SPACE)
        c = self._sums(w)
        edges: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        # of the words not yet done, which all have as many pieces: their rows, edges and pairs' scores
        row, edge = np.arange(n), np.tile(np.arange(length + 1), (n, 1))
        gain = self._pieces(c, np.repeat(row, length - 1), edge[:, :-2].ravel(), edge[:, 2:].ravel())[0].reshape(n, length - 1)
        while len(row):
            best = gain.argmax(1) if gain.shape[1] else np.zeros(len(row), np.int64)
            more = gain[np.arange(len(row)), best] > -np.inf if gain.shape[1] else np.zeros(len(row), bool)
            for r, e in zip(row[~more].tolist(), edge[~more], strict=True):
                edges[r] = e
            row, edge, gain, best = row[more], edge[more], gain[more], best[more]
            if not len(row):
                break
            pairs, k = gain.shape[1], np.arange(len(row))
            edge = edge[np.arange(pairs + 2) != best[:, None] + 1].reshape(len(row), pairs + 1)
            gain = gain[np.arange(pairs) != best[:, None]].reshape(len(row), pairs - 1)
            for at in (best - 1, best):
                ok = (at >= 0) & (at < pairs - 1)
                i, x = k[ok], at[ok]
                if len(i):
                    gain[i, x] = self._pieces(c, row[i], edge[i, x], edge[i, x + 2])[0]
        sizes = np.array([len(e) - 1 for e in edges])
        start, end = np.concatenate([e[:-1] for e in edges]), np.concatenate([e[1:] for e in edges])
        row = np.repeat(np.arange(n), sizes)
        ids = self._pieces(c, row, start, end)[1]
        spelled = {k: list(words[row[k]][start[k]].encode()) for k in np.flatnonzero(ids < 0).tolist()}
        count = np.ones(len(ids), np.int64)
        count[list(spelled)] = [len(x) for x in spelled.values()]
        out = np.repeat(ids, count)
        at = np.cumsum(count) - count
        for k, x in spelled.items():
            out[at[k] : at[k] + len(x)] = self.byte_ids[x]
        stop = np.cumsum(np.bincount(row, count, n).astype(np.int64))
        return np.split(out.astype(np.uint32), stop[:-1])

    def _merge_long(self, word: str) -> np.ndarray:
        """merge() of one word: an entry of the heap is a pair's place in the order of merges, start and length."""
        text, n = word.replace(SPACE, chr(TAKEN)).replace(" ", SPACE), len(word)
        named, low = self.named, self.longest.bit_length()
        mask, high = (1 << low) - 1, n.bit_length() + low
        heap = [(named[text[i : i + 2]][0] << high) + (i << low) + 2 for i in range(n - 1) if text[i : i + 2] in named]
        heapify(heap)
        # by the start of a piece: its end (0 where none starts) and the start of the one before
        end, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            entry = heappop(heap)
            i, size = (entry >> low) & ((1 << (high - low)) - 1), entry & mask
            mid = end[i]
            if not mid or mid == n or end[mid] != i + size:
                continue
            stop = i + size
            end[i], end[mid], before[stop] = stop, 0, i
            for a, z in ((before[i], stop), (i, end[stop] if stop < n else 0)):
                if a >= 0 and 0 < z - a <= self.longest and (found := named.get(text[a:z])):
                    heappush(heap, (found[0] << high) + (a << low) + z - a)
        taken, i = [], 0
        while i < n:
            if found := named.get(text[i : end[i]]):
                taken.append(found[1])
            else:
                taken += self.byte_ids[list(word[i].encode())].tolist()
            i = end[i]
        return np.array(taken, np.uint32)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The texts of rows of ids: row k is ids[edges[k]:edges[k + 1]]."""
        n = self.sizes[ids]
        stop = np.concatenate([[0], np.cumsum(n)])
        raw = self.flat_bytes[np.repeat(self.places[ids] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        at = stop[edges].tolist()
        return [raw[a + 1 : b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One encoder a worker process."""
    return Pieces(path)


ROWS = "doc_id long, n_ids long, ids array<int>, round_trip boolean"


def _encode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    coder = pieces(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = list(coder.column(part.column("text")))
            edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            same = [a == b for a, b in zip(coder.decode(ids, edges), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edges)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """One row for each row of documents: its ids, and whether decoding them gives the text back.

    A null or empty text has no ids. Repeated rows are encoded alike, other columns ignored. An empty
    table gives no rows.
    """
    return shared.mapped(documents.select("doc_id", "text"), partial(_encode, model=model or default_model()), ROWS)


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(r or [], np.int64) for r in batch.column("ids").to_pylist()]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        texts = pieces(model).decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), edges)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give the empty text."""
    return shared.mapped(encoded.select("doc_id", "ids"), partial(_decode, model=model or default_model()), "doc_id long, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))

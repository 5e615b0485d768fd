"""Suffix-array dedup by prefix-free parsing: bytes under a string of 400 that also starts elsewhere.

Rolling-hash triggers cut the corpus into phrases: the trigger of a start is the least hash among the
200-byte strings that begin in its first 201 bytes (the first of equal ones), so it depends on nothing
but the 400 bytes at hand, and every start has one. Neighbouring starts with the same trigger make a
phrase: the text from the first start to the end of the last one's 400 bytes, overlapping the next
phrase as prefix-free parsing asks. Equal strings of 400 bytes have equal triggers at equal distance.

The dictionary holds each distinct phrase once, with its multiplicity in the parse:

1. Phrases are counted by trigger and content. Where a phrase occurs twice, all its starts repeat.
   A trigger with a single phrase needs nothing more: that is nearly all text.
2. For triggers with several phrases, the suffixes of the distinct phrases are brought into corpus
   order, each cut at 400 bytes and carrying its phrase's multiplicity. Only equality of the first 400
   bytes is asked for, so suffixes are ordered by a 64-bit hash of them, bucket by bucket; neighbours
   that are equal are the repeats.
3. Each text looks up its phrases and suffixes in the mapped arrays and loses the covered bytes.

No text is shuffled, a group of a million copies is one dictionary entry, and no cap is set anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Sorted
from .text import PIECE, U64, buffers, mix, powers, rolling, runs, spans_hash

POSITION = 24
PHRASES = "bucket int, keys binary, phrases binary, counts binary"


class Phrases:
    """The phrases of one stretch of bytes: documents i to j, or a part of one longer document."""

    def __init__(self, b: np.ndarray, bounds: np.ndarray, length: int, top: int):
        self.length = length
        self.c = rolling(b)
        inverse = powers(len(b) + 1)[1]
        gram, span = length // 2, length - length // 2 + 1
        grams = mix((self.c[gram:] - self.c[:-gram]) * inverse[: len(b) + 1 - gram]) if len(b) >= gram else np.zeros(0, U64)
        size = np.diff(bounds)
        ok = np.zeros(len(b) + 1, np.int8)
        long = size >= length
        np.add.at(ok, bounds[:-1][long], 1)
        np.add.at(ok, bounds[1:][long] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
        if not len(starts):
            self.lo = self.hi = np.zeros(0, np.int64)
            self.key = self.phrase = np.zeros(0, U64)
            return
        place = U64((1 << POSITION) - 1)
        v = (grams & ~place) | np.arange(len(grams), dtype=U64)
        pad = -len(v) % span
        v = np.concatenate([v, np.full(pad, ~U64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        trigger = (np.minimum(back[starts], ahead[starts + span - 1]) & place).astype(np.int64)
        new = np.empty(len(starts), bool)
        new[0] = True
        new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
        # documents that touch have a gap of length - 1 starts between them, so a new one is a jump
        at = np.flatnonzero(new)
        self.lo, self.hi = starts[at], starts[np.append(at[1:], len(starts)) - 1]
        # a least hash has small leading bits: mixed again, triggers spread over all buckets
        self.key = mix(grams[trigger[at]])
        content = mix(spans_hash(self.c, self.lo, self.hi + length) ^ (trigger[at] - self.lo).astype(U64))
        high = ~U64(0) << U64(64 - top)
        self.phrase = (self.key & high) | (content >> U64(top))  # in its trigger's bucket

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All starts of these phrases, and the hashes of their first bytes."""
        n = self.hi[which] - self.lo[which] + 1
        s = np.repeat(self.lo[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return s, mix((self.c[s + self.length] - self.c[s]) * powers(len(self.c))[1][s])


def stretches(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(i, j, start, bytes, bounds): documents of at most PIECE bytes together, longer ones in parts
    that overlap by length - 1 bytes."""
    data, offsets = buffers(column)
    for i, j in runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= PIECE:
            yield i, j, 0, data[lo:hi], offsets[i : j + 1] - lo
        else:
            for at in range(0, hi - lo - length + 1, PIECE):
                part = data[lo + at : min(lo + at + PIECE + length - 1, hi)]
                yield i, j, at, part, np.array([0, len(part)])


class Index:
    def __init__(self, texts: DataFrame, length: int):
        spark = texts.sparkSession
        self.length, self.bits = length, shared.bits(texts)
        self.several = Sorted(shared.folder(spark, "repeats-several"), self.bits)
        self.twice = Sorted(shared.folder(spark, "repeats-twice"), self.bits)
        self.suffixes = Sorted(shared.folder(spark, "repeats-suffixes"), self.bits)

    def lookup(self, store: Sorted, h: np.ndarray) -> np.ndarray:
        keys, back = np.unique(h, return_inverse=True)
        return store.find(keys)[0][back]

    def phrases(self, column: pa.Array) -> Iterator[tuple[int, int, int, Phrases]]:
        for i, j, at, b, bounds in stretches(column, self.length):
            yield i, j, at, Phrases(b, bounds, self.length, self.bits)


def _pairs(key: np.ndarray, phrase: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (trigger, phrase) in order, with summed counts."""
    order = np.lexsort((phrase, key))
    key, phrase, n = key[order], phrase[order], n[order]
    first = np.empty(len(key), bool)
    first[:1] = True
    first[1:] = (key[1:] != key[:-1]) | (phrase[1:] != phrase[:-1])
    at = np.flatnonzero(first)
    return key[at], phrase[at], np.add.reduceat(n, at) if len(at) else n


def _count_phrases(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    held: list = []

    def sent() -> pa.RecordBatch:
        k, p, n = _pairs(*map(np.concatenate, zip(*held, strict=True)))
        made = [(b, shared.pack_keys(k[s]), shared.pack(p[s]), shared.narrow(n[s])) for b, s in shared.cut(k, index.bits)]
        held.clear()
        return pa.RecordBatch.from_pylist([dict(zip(("bucket", "keys", "phrases", "counts"), m, strict=True)) for m in made], pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("phrases", pa.binary()), ("counts", pa.binary())]))

    for batch in batches:
        for *_, p in index.phrases(batch.column("text")):
            if len(p.key):
                held.append((p.key, p.phrase, np.ones(len(p.key), np.int64)))
        if sum(len(x[0]) for x in held) >= shared.HELD:
            yield sent()
    if held:
        yield sent()


def _merge_phrases(table: pa.Table, index: Index) -> pa.Table:
    cols = [[f(x.as_buffer()) for x in table.column(c)] for c, f in (("keys", shared.unpack_keys), ("phrases", lambda x: shared.unpack(x, U64)), ("counts", lambda x: shared.widen(bytes(x))))]
    k, p, n = _pairs(*map(np.concatenate, cols))
    b = table.column("bucket")[0].as_py()
    index.twice.write(b, np.sort(p[n > 1]))
    index.several.write(b, shared.distinct(k[1:][k[1:] == k[:-1]])[0])
    return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(k)])})


def _suffix_counts(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for *_, p in index.phrases(batch.column("text")):
        some = np.flatnonzero(index.lookup(index.several, p.key)) if len(p.key) else []
        if len(some):
            _, first = np.unique(p.phrase[some], return_index=True)
            some = np.sort(some[first])
            weight = np.where(index.lookup(index.twice, p.phrase[some]), 2, 1)
            yield p.suffixes(some)[1], np.repeat(weight, p.hi[some] - p.lo[some] + 1)


def _merge_suffixes(table: pa.Table, index: Index) -> pa.Table:
    b, k, n = shared.merge(table)
    index.suffixes.write(b, k[n > 1])
    return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(k)])})


def build(texts: DataFrame, length: int = 400) -> Index:
    index, texts = Index(texts, length), texts.select("text")
    found = shared.mapped(texts, partial(_count_phrases, index=index), PHRASES)
    found.groupBy("bucket").applyInArrow(shared.with_args(_merge_phrases, index=index), "bucket int, n long").agg(F.sum("n")).collect()
    found = shared.mapped(texts, partial(shared.counted, hashes=partial(_suffix_counts, index=index), bucket_bits=index.bits), shared.PACKED)
    found.groupBy("bucket").applyInArrow(shared.with_args(_merge_suffixes, index=index), "bucket int, n long").agg(F.sum("n")).collect()
    return index


def repeated(column: pa.Array, index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the maximal covered runs: their starts and ends, in bytes."""
    found: list = [None] * len(column)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, offsets = buffers(column)
    for i, j, at, p in index.phrases(column):
        if not len(p.key):
            continue
        whole = index.lookup(index.twice, p.phrase)
        lo, hi = p.lo[whole], p.hi[whole]
        some = np.flatnonzero(~whole & index.lookup(index.several, p.key))
        if len(some):
            s, h = p.suffixes(some)
            s = s[index.lookup(index.suffixes, h)]
            lo, hi = np.concatenate([lo, s]), np.concatenate([hi, s])
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], hi[order]
        if not len(lo):
            continue
        place = offsets[i:j] - offsets[i] if j > i + 1 else np.zeros(1, np.int64)
        doc = np.searchsorted(place, lo, "right") - 1
        lo, hi = lo + at - place[doc], hi + at - place[doc] + index.length
        edge = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(doc)], strict=True):
            k = i + int(doc[a])
            old = found[k] or none
            found[k] = (np.concatenate([old[0], lo[a:b]]), np.concatenate([old[1], hi[a:b]]))
    return [joined(*x) if x else none for x in found]


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by ascending start as maximal runs; touching ones are one."""
    reach = np.maximum.accumulate(hi)
    new = np.empty(len(lo), bool)
    new[0] = True
    new[1:] = lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return lo[at], reach[np.append(at[1:], len(lo)) - 1]


def left(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))


def whole_characters(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without characters that they cover in part."""
    out = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array([x for x, _ in out], np.int64), np.array([x for _, x in out], np.int64)


def _digest(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, out = batch.column("text"), []
        data, offsets = buffers(column)
        for k, (lo, hi) in enumerate(repeated(column, index)):
            raw = data[offsets[k] : offsets[k + 1]].tobytes()
            out.append((len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(left(raw, lo, hi)).hexdigest(), list(zip(lo.tolist(), hi.tolist(), strict=True))))
        n, removed, spans, digest, where = map(list, zip(*out, strict=True)) if out else [[]] * 5
        where = pa.array([[{"start": a, "end": b} for a, b in w] for w in where], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), where], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(documents: DataFrame, length: int = 400) -> DataFrame:
    """One row for each row of documents: doc_id, sizes, the SHA-256 of what stays, and the removed
    spans in bytes.

    A null text counts as empty; texts of fewer than ``length`` bytes lose nothing. Repeated rows are
    texts that occur repeatedly and so lose everything from ``length`` bytes on. Other columns are
    ignored. An empty table gives no rows.
    """
    index = build(documents, length)
    return shared.mapped(documents.select("doc_id", "text"), partial(_digest, index=index), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def _cut(batches: Iterator[pa.RecordBatch], index: Index, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, texts = batch.column(name), []
        data, offsets = buffers(column)
        for k, (lo, hi) in enumerate(repeated(column, index)):
            raw = data[offsets[k] : offsets[k + 1]].tobytes()
            texts.append((left(raw, *whole_characters(raw, lo, hi)) if len(lo) else raw).decode())
        at = batch.schema.get_field_index(name)
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def remove_repeats(documents: DataFrame, length: int = 400) -> DataFrame:
    """documents with all their columns, their texts without the repeated bytes (whole characters only;
    a null text becomes empty)."""
    return shared.mapped(documents, partial(_cut, index=build(documents, length), name="text"), documents.schema)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("spans")

"""LM scoring: an interpolated modified Kneser-Ney n-gram model of order three (or two).

Counted in Spark, stored as sorted hash arrays in the shared folder, mapped into memory by the
workers that score. Three passes read the texts; no text, no n-gram and no count passes the driver,
which sees one row of totals a bucket.

1. Words are counted by 64-bit hash (ends of texts as one more word). A word's id is its place among
   all sorted hashes.
2. Trigrams of ids are counted, exactly: the key of two words is a bijective mix of the bits that both ids have,
   and a bucket holds the words and counts that follow each of its contexts, in order. Each distinct trigram
   u v w then counts one for the bigram v w, sent on by the task that holds its bucket: the number of
   words that v w follows (order two counts bigrams themselves instead). A context is a bigram but for the two start
   marks, so keys are stored once, each with how often it follows and how many words follow it.
3. From each bucket of distinct bigrams come, by word, how often it is followed and by how many
   words once, twice or more, and how many words it follows.
4. Each text's score is the sum of log10 p(w | u v), texts beginning after two start marks, with
   p(w | u v) = max(c(uvw) - D3(c), 0) / c(uv) + g(uv) p(w | v),
   p(w | v) = max(n(vw) - D2(n), 0) / n(v) + g(v) p(w),  p(w) = max(n(w) - D1(n), 0) / T + g / (V + 1),
   with three discounts a level from the counts of counts; n counts different words before.
   V + 1 leaves one share for all unknown words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Sorted
from .text import U64, words

END = U64(0x5851F42D4C957F2D)
#: Odd factors of the mix of two ids.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
KINDS = ("follows", "once", "twice", "more", "after")
STATS = "bucket int, types long, total long, n1 long, n2 long, n3 long, n4 long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def with_ends(counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of documents with END after each; and where each document begins."""
    n = counts + 1
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, U64)
    inner = np.ones(len(out), bool)
    inner[stop - 1] = False
    out[stop - 1] = END
    out[inner] = h
    return out, stop - n


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts; where counts of counts are missing, 3/4 of what they may be."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0
    found = [1 - 2 * y * n2 / n1 if n1 else 0, 2 - 3 * y * n3 / n2 if n2 else 0, 3 - 4 * y * n4 / n3 if n3 else 0]
    return [d if 0 < d <= k else 0.75 for k, d in zip((1, 2, 3), found, strict=True)]


def _word_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, n, h in words(batch.column("text")):
        yield with_ends(n, h)[0]


def _arrow(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [name for name, _ in schema])


def _chunks(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive sizes that sum up to the limit at most, or of one larger."""
    stop, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(stop, limit + (stop[a - 1] if a else 0), "right")))
        yield slice(a, b)
        a = b


def squeezed(x: np.ndarray) -> np.ndarray:
    """Counts in a byte each, those from 255 on in a list of places and values behind; all in one array of bytes."""
    big = np.flatnonzero(x >= 255)
    head = np.array([len(x), len(big)], np.int64)
    parts = (head, np.minimum(x, 255).astype(np.uint8), np.zeros(-len(x) % 8, np.uint8), big.astype(np.int64), x[big].astype(np.int64))
    return np.concatenate([y.view(np.uint8) for y in parts])


def counts_at(stored: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at these places of what squeezed() gave."""
    n, big = stored[:16].view(np.int64).tolist()
    out = stored[16 + at].astype(np.int64)
    if big and len(hit := np.flatnonzero(out == 255)):
        places, values = stored[16 + n + -n % 8 :].view(np.int64).reshape(2, big)
        out[hit] = values[np.searchsorted(places, at[hit])]
    return out


#: Words that follow a context from which on its totals are stored.
LARGE = 64
#: Contexts of a bucket of which one start is stored, and buckets of pairs that one task writes.
BLOCK, TOGETHER = 16, 4


class Model:
    """What scoring needs: where the arrays are, and a few totals."""

    def __init__(self, spark, bits: int, order: int):
        if order not in (2, 3):
            raise ValueError("the order is two or three")
        self.bits, self.order, self.vocabulary = bits, order, 0
        #: By bucket of contexts the words that follow each, in order, and their counts.
        self.triples = shared.folder(spark, "lm-triples")
        self.words = Sorted(shared.folder(spark, "lm-words"), self.bits, ("counts",))
        self._lists = shared.Held()
        self.pairs = self.pair_store(shared.folder(spark, "lm-pairs"))
        self.by_word = shared.folder(spark, "lm-by-word")
        self.starts = np.zeros(1, np.int64)
        self.tokens = self.types = 0
        self.low, self.high, self.top = [0.75] * 3, [0.75] * 3, [0.75] * 3
        self._segments = shared.Held()

    @property
    def width(self) -> int:
        """Bits of an id; the start mark is the id V."""
        return max(4, self.vocabulary.bit_length())

    @property
    def group_bits(self) -> int:
        """Leading bits that name a group of buckets that one task writes."""
        return max(1, self.pair_bits - TOGETHER.bit_length() + 1)

    @property
    def pair_bits(self) -> int:
        """Leading bits that name a bucket of pairs."""
        return min(self.bits, 2 * self.width)

    def pair_store(self, uri: str) -> Sorted:
        return Sorted(uri, self.pair_bits, ("counts", "followers", "starts"), 64 - 2 * self.width)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct pairs, 0 for unknown ones."""
        out = np.zeros(len(keys), np.int64)
        for b, s in shared.cut(keys, self.pair_bits):
            have, at, ok = self.pairs.places(b, keys[s])
            if have:
                out[s] = np.where(ok, counts_at(have[1], at), 0)
        return out

    def pair_key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """A bijective mix of two ids in the leading bits of a key. Unknown ids (-1) give some other key."""
        n = 2 * self.width
        mask, half = U64((1 << n) - 1), U64(self.width)
        x = ((first.astype(U64) << half) | (second.astype(U64) & U64((1 << self.width) - 1))) & mask
        for factor in FACTORS:
            x = ((x ^ (x >> half)) * U64(factor)) & mask
        return (x ^ (x >> half)) << U64(64 - n)

    def pair_ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inverse of pair_key()."""
        n = 2 * self.width
        mask, half = U64((1 << n) - 1), U64(self.width)
        x = key >> U64(64 - n)
        x = x ^ (x >> half)
        for factor in FACTORS[::-1]:
            x = (x * U64(pow(factor, -1, 1 << n))) & mask
            x = x ^ (x >> half)
        return (x >> half).astype(np.int64), (x & U64((1 << self.width) - 1)).astype(np.int64)

    def listed(self, b: int) -> tuple:
        """The words and counts that follow the contexts of a bucket; of those that many follow, by start, the totals."""
        return self._lists.get(b, self.triples, [f"{b}-words", f"{b}-counts", f"{b}-large"])

    @property
    def segment(self) -> int:
        """Ids whose statistics are stored together."""
        return max(1 << 16, -(-(self.vocabulary + 1) >> self.bits))

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words."""
        keys, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for b, s in shared.cut(keys, self.bits):
            have = self.words.bucket(b)
            if have and len(have[0]):
                at = np.minimum(np.searchsorted(have[0], keys[s]), len(have[0]) - 1)
                ok = have[0][at] == keys[s]
                ids[s] = np.where(ok, at + self.starts[b], -1)
                counts[s] = np.where(ok, have[1][at], 0)
        return ids[back], counts[back]

    def pair_keys(self, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all bigrams (the word before the first is the id V), ids, ids before, counts."""
        tokens, first = with_ends(n, h)
        ids, counts = self.ids(tokens)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first] = self.vocabulary
        return self.pair_key(before, ids), ids, before, counts

    def contexts(self, key: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each token: the count of its trigram, the total of its context, and how many words follow
        that once, twice and more; key: of the bigrams, known: whether context and word have ids."""
        out = tuple(np.zeros(len(key), np.int64) for _ in range(5))
        some = np.flatnonzero(known)
        # tokens by the key of their context, so that a bucket's are a slice
        order = np.argsort(key[some], kind="stable")
        some, k = some[order], key[some][order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        keys, stop = k[first], np.append(first[1:], len(k))
        for b, s in shared.cut(keys, self.pair_bits):
            have, at, ok = self.pairs.places(b, keys[s])
            if not have:
                continue
            followers, starts = have[2], have[3]
            ok &= counts_at(followers, at) > 0
            if not ok.any():
                continue
            words, counts, large = self.listed(b)
            n = (stop[s] - first[s])[ok]
            tokens = np.repeat(first[s][ok] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where, of = at[ok], np.repeat(np.arange(len(n)), n)
            # a start is its block's and what the contexts before it in the block have
            inside = where[:, None] & ~(BLOCK - 1)
            ahead = inside + np.arange(BLOCK)
            ahead = np.where(ahead <= where[:, None], ahead, inside)
            n = counts_at(followers, ahead.ravel()).reshape(ahead.shape)
            own = np.arange(BLOCK) == (where[:, None] & (BLOCK - 1))
            lo = starts[where // BLOCK].astype(np.int64) + (n * ((np.arange(BLOCK) < (where[:, None] & (BLOCK - 1))))).sum(1)
            hi = lo + (n * own).sum(1)
            found, many = np.zeros((4, len(lo)), np.int64), hi - lo >= LARGE
            found[:, many] = large[1:, np.searchsorted(large[0], lo[many])]
            few = np.flatnonzero(~many)
            for c in _chunks((hi - lo)[few]):
                found[:, few[c]] = self._totals(lo[few[c]], hi[few[c]], counts)
            w, left, right = ids[some[tokens]], lo[of], hi[of]
            end = right
            while (open_ := left < right).any():
                mid = (left + right) // 2
                less = open_ & (words[np.minimum(mid, end - 1)] < w)
                left, right = np.where(less, mid + 1, left), np.where(open_ & ~less, mid, right)
            there = left < end
            there[there] = words[left[there]] == w[there]
            out[0][some[tokens[there]]] = counts_at(counts, left[there])
            for o, x in zip(out[1:], found, strict=True):
                o[some[tokens]] = x[of]
        return out

    @staticmethod
    def _totals(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        n = hi - lo
        first = np.cumsum(n) - n
        c = counts_at(counts, np.repeat(lo - first, n) + np.arange(n.sum()))
        return tuple(np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2))

    def before(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The key of the two words before each token, from the keys of the bigrams that end there."""
        first = np.cumsum(n + 1) - (n + 1)
        out = np.empty_like(key)
        out[1:] = key[:-1]
        out[first] = self.pair_key(np.array([self.vocabulary]), np.array([self.vocabulary]))[0]
        return out

    def stats(self, ids: np.ndarray) -> list[np.ndarray]:
        """The arrays KINDS at sorted distinct ids."""
        out = [np.zeros(len(ids), np.int64) for _ in KINDS]
        part = ids // self.segment
        for p in np.unique(part):
            if have := self._segments.get(int(p), self.by_word, [f"{p}-{k}" for k in KINDS]):
                s = part == p
                for o, x in zip(out, have, strict=True):
                    o[s] = x[ids[s] - p * self.segment]
        return out


def _write_words(table: pa.Table, model: Model) -> pa.Table:
    b, k, n = shared.merge(table)
    model.words.write(b, k, shared.least(n))
    return pa.table([[b], [len(k)], [int(n.sum())], *([x] for x in counts_of_counts(n))], schema=_stats_schema())


def _stats_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), *((k, pa.int64()) for k in ("types", "total", "n1", "n2", "n3", "n4"))])


def _pairs(batch: pa.RecordBatch, model: Model) -> Iterator[np.ndarray]:
    for _, _, n, h in words(batch.column("text")):
        yield model.pair_keys(n, h)[0]


TRIPLES = "bucket int, contexts binary, words binary, counts binary"
#: Bigrams with their counts, and contexts with the number of words that follow; counts of counts in the first row.
CONTINUED = f"{shared.PACKED}, contexts boolean, m1 long, m2 long, m3 long, m4 long"


def _merged(key: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, with summed counts."""
    order = np.lexsort((word, key))
    key, word, n = key[order], word[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (word[1:] != word[:-1])]))
    return key[at], word[at], np.add.reduceat(n, at)


def _triples(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        key, word, n = _merged(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        rows = [(b, shared.pack_keys(key[s]), shared.pack(word[s]), shared.narrow(n[s])) for b, s in shared.cut(key, model.pair_bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], [x.split()[0] for x in TRIPLES.split(", ")])

    for batch in batches:
        for _, _, n, h in words(batch.column("text")):
            key, ids, _, _ = model.pair_keys(n, h)
            held.append(_merged(model.before(key, n), ids.astype(np.uint32), np.ones(len(ids), np.int64)))
            if sum(len(x[0]) for x in held) >= shared.HELD:
                yield sent()
    if held:
        yield sent()


def _write_triples(table: pa.Table, model: Model) -> pa.Table:
    """One bucket of trigrams to its arrays; the bigrams that end them, with the words before these."""
    b = table.column("bucket")[0].as_py()
    key, word, n = _merged(
        np.concatenate([shared.unpack_keys(x.as_buffer()) for x in table.column("contexts")]),
        np.concatenate([shared.unpack(bytes(x.as_buffer()), np.uint32) for x in table.column("words")]),
        np.concatenate([shared.widen(bytes(x.as_buffer())) for x in table.column("counts")]))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    shared.save(model.triples, f"{b}-words", word.astype(np.uint32))
    shared.save(model.triples, f"{b}-counts", squeezed(n))
    many = np.diff(np.append(at, len(key))) >= LARGE
    shared.save(model.triples, f"{b}-large", np.stack([at, *(np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2))])[:, many])
    cc = counts_of_counts(n)
    pairs, m = shared.distinct(model.pair_key(model.pair_ids(key)[1], word.astype(np.int64)))
    rows, own = shared.rows(pairs, m, model.group_bits), shared.rows(key[at], np.diff(np.append(at, len(key))), model.group_bits)
    rows = pa.Table.from_batches([rows, own]).combine_chunks()
    return pa.Table.from_arrays([*rows.columns, pa.array([False] * (rows.num_rows - own.num_rows) + [True] * own.num_rows), *(pa.array([c, *[0] * (rows.num_rows - 1)], pa.int64()) for c in cc)], [x.split()[0] for x in CONTINUED.split(", ")])


PARTS = "segment long, bucket int, n1 long, n2 long, n3 long, n4 long, m1 long, m2 long, m3 long, m4 long, ids binary, counts binary, kind int"


def _write_pairs(table: pa.Table, model: Model) -> pa.Table:
    """A group of buckets of bigrams and contexts to their arrays; its share of each word's statistics, by segment of ids."""
    context = np.array(table.column("contexts")) if model.order == 3 else np.zeros(table.num_rows, bool)
    sides = [table.filter(pa.array(x)) for x in (~context, context)]
    b = table.column("bucket")[0].as_py()
    k, n = shared.merge(sides[0])[1:] if sides[0].num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
    c, f = shared.merge(sides[1])[1:] if sides[1].num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
    every = np.union1d(k, c)
    counts, followers = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, k)], followers[np.searchsorted(every, c)] = n, f
    for one, part in shared.cut(every, model.pair_bits):
        starts = (np.cumsum(followers[part]) - followers[part])[::BLOCK]
        model.pairs.write(one, every[part], squeezed(counts[part]), squeezed(followers[part]), starts.astype(np.uint32) if followers[part].sum() < 1 << 32 else starts)
    before, after = model.pair_ids(k)
    cc, rows = counts_of_counts(n), []
    cc += [sum(table.column(f"m{i}").to_pylist()) if model.order == 3 else 0 for i in (1, 2, 3, 4)]
    for kind, (ids, w) in enumerate(((before, n), (before[n == 1], None), (before[n == 2], None), (before[n > 2], None), (after, None))):
        got, c = shared.distinct(ids.astype(U64), np.ones(len(ids), np.int64) if w is None else w)
        if not len(got):
            continue
        part = got.astype(np.int64) // model.segment
        at = np.flatnonzero(np.diff(part, prepend=-1))
        for x, y in zip(at, [*at[1:], len(got)], strict=True):
            rows.append([int(part[x]), b, *cc, shared.pack_keys(got[x:y]), shared.narrow(c[x:y]), kind])
            cc = [0] * 8
    schema = pa.schema([("segment", pa.int64()), ("bucket", pa.int32()), *((f"{a}{i}", pa.int64()) for a in "nm" for i in (1, 2, 3, 4)), ("ids", pa.binary()), ("counts", pa.binary()), ("kind", pa.int32())])
    return pa.table([list(c) for c in zip(*rows, strict=True)], schema=schema) if rows else schema.empty_table()


def _write_segment(table: pa.Table, model: Model) -> pa.Table:
    p = table.column("segment")[0].as_py()
    dense = np.zeros((len(KINDS), model.segment), np.int64)
    for kind, ids, counts in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("counts"), strict=True):
        dense[kind, shared.unpack_keys(ids.as_buffer()).astype(np.int64) - p * model.segment] += shared.widen(bytes(counts.as_buffer()))
    for name, x in zip(KINDS, dense, strict=True):
        shared.save(model.by_word, f"{p}-{name}", x.astype(np.uint32) if x.max() < 1 << 32 else x)
    after = dense[-1]
    sums = [sum(table.column(f"{a}{i}").to_pylist()) for a in "nm" for i in (1, 2, 3, 4)]
    return pa.table([[p], [int(after.sum())], *([x] for x in counts_of_counts(after)), *([x] for x in sums)], schema=_segment_schema())


def _segment_schema() -> pa.Schema:
    return pa.schema([("segment", pa.int64()), ("types", pa.int64()), *((f"{a}{i}", pa.int64()) for a in "tnm" for i in (1, 2, 3, 4))])


def fit(texts: DataFrame, order: int = 3) -> Model:
    """The model of a column ``text``; a null text counts as empty, no texts give a model that knows no word."""
    spark = texts.sparkSession
    model, texts = Model(spark, shared.bits(texts), order), texts.select("text")
    seen = shared.mapped(texts, partial(shared.counted, hashes=_word_hashes, bucket_bits=model.bits), shared.PACKED)
    totals = seen.groupBy("bucket").applyInArrow(shared.with_args(_write_words, model=model), STATS).collect()
    types = np.zeros(1 << model.bits, np.int64)
    for r in totals:
        types[r.bucket] = r.types
    model.starts = np.concatenate([[0], np.cumsum(types)])
    model.vocabulary, model.tokens = int(types.sum()), sum(r.total for r in totals)
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: a bigram's key would not hold both ids")
    if not totals:
        return model
    model.pairs = model.pair_store(model.pairs.uri)
    if order == 3:
        triples = shared.mapped(texts, partial(_triples, model=model), TRIPLES)
        pairs = triples.groupBy("bucket").applyInArrow(shared.with_args(_write_triples, model=model), CONTINUED)
    else:
        pairs = shared.mapped(texts, partial(shared.counted, hashes=partial(_pairs, model=model), bucket_bits=model.group_bits), shared.PACKED)
    parts = pairs.groupBy("bucket").applyInArrow(shared.with_args(_write_pairs, model=model), PARTS)
    segments = parts.groupBy("segment").applyInArrow(shared.with_args(_write_segment, model=model), ", ".join(["segment long", "types long", *(f"{a}{i} long" for a in "tnm" for i in (1, 2, 3, 4))])).collect()
    model.types = sum(r.types for r in segments)
    model.low_counts = [sum(r[f"t{i}"] for r in segments) for i in (1, 2, 3, 4)]
    model.low, model.high, model.top = (discounts([sum(r[f"{a}{i}"] for r in segments) for i in (1, 2, 3, 4)]) for a in "tnm")
    return model


def probabilities(model: Model, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(w | u v), or p(w | v), of every word and end of these documents, and how often training has the word."""
    key, ids, before, counts = model.pair_keys(n, h)
    d, e = np.array([0.0, *model.high]), np.array([0.0, *model.low])
    v1 = model.vocabulary + 1
    if not model.types:
        return np.full(len(ids), 1 / v1), counts
    known, back = np.unique(np.concatenate([ids, before]), return_inverse=True)
    follows, once, twice, more, after = (x.astype(np.float64)[back] for x in model.stats(known))
    after, m = after[: len(ids)], len(ids)
    t1, t2 = model.low_counts[:2]
    # every word of the vocabulary follows some word, so all types with three or more are the rest
    g = (e[1] * t1 + e[2] * t2 + e[3] * (model.vocabulary - t1 - t2)) / model.types
    p = np.maximum(after - e[np.minimum(after, 3).astype(int)], 0) / model.types + g / v1
    follows, once, twice, more = (x[m:] for x in (follows, once, twice, more))
    some = np.maximum(follows, 1)
    weight = np.where(follows > 0, (d[1] * once + d[2] * twice + d[3] * more) / some, 1.0)
    c = np.zeros(m)
    both = (ids >= 0) & (before >= 0)
    keys, at = np.unique(key[both], return_inverse=True)
    c[both] = model.pair_counts(keys)[at]
    p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / some + weight * p
    if model.order == 3:
        first = np.cumsum(n + 1) - (n + 1)
        known = np.concatenate([[True], both[:-1]])
        known[first] = True  # two start marks
        c, total, once, twice, more = model.contexts(model.before(key, n), ids, known)
        d, some = np.array([0.0, *model.top]), np.maximum(total, 1)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / some + np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / some, 1.0) * p
    return p, counts


def _together(runs: Iterator[tuple], tokens: int = 1 << 19) -> Iterator[tuple]:
    """Runs of documents joined to larger ones, as each visits every bucket."""
    held: list[tuple] = []
    for run in runs:
        held.append(run)
        if sum(len(x[3]) for x in held) >= tokens:
            yield held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            held = []
    if held:
        yield held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64, np.float64)]
        for i, j, n, h in _together(words(batch.column("text"))):
            p, counts = probabilities(model, n, h)
            first = np.cumsum(n + 1) - (n + 1)
            base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
            for o, x in zip(out, (n + 1, np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)), strict=True):
                o[i:j] = x
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out[0]), pa.array(out[1]), pa.array(np.full(batch.num_rows, model.tokens)), pa.array(out[2]), pa.array(out[3])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Adds to doc_id and held_out each text's tokens, known tokens, unigram score and model score (log10)."""
    return shared.mapped(documents.select("doc_id", "held_out", "text"), partial(_score, model=model), RESULT)


def held_out_scores(documents: DataFrame, folds: int = 7, held: int = 2, order: int = 3) -> DataFrame:
    """Fits on the documents whose crc32 of the id as text is not ``held`` modulo ``folds``; scores all.

    Null and empty texts hold one token, the end. A null id counts as the empty text in the fold.
    Repeated rows are scored and counted as often as they occur. An empty table gives no rows.
    """
    marked = documents.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held).alias("held_out"))
    return score(marked, fit(marked.where(~F.col("held_out")), order))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return held_out_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))

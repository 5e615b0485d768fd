"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan.

Words are counted by a 64-bit hash of word and language, so a language needs no column of its own. Three
passes read the texts.

1. Words. Those that occur ``least`` times or more are frequent, and numbered.
2. Pairs of neighbouring frequent words; a phrase is frequent only where all its pairs are.
3. Projection. Each place where a frequent pair begins, and goes on with a frequent pair, is an occurrence
   pointer of its first word: the words that follow it, as far as pairs stay frequent, four in all.
   Equal pointers of a task are one with a count. Pointers go to the task of their prefix, which
   sorts them, so that a projection is a slice, and grows the prefix to the right depth-first: each
   word that extends it often enough gives a longer prefix with a narrower slice.

A prefix with very many occurrences is dealt out over several tasks, by all the words that follow. Equal
pointers meet in one task still, so only counts of shorter phrases are partial; these are sent whatever
their size and summed. Phrases, their cuts and the longer phrases that hold them are joined natively;
only the words of phrases that are left become text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import Sorted
from .text import PIECE, U64, buffers, mix, rolling, runs, spans_hash, unmix

LONGEST = 4
#: Occurrences of a prefix that one task grows.
PROJECTED = 1 << 20
#: Phrases of a language that are ranked together before the last ranking, in so many parts.
PARTS = 64
#: Words that a task remembers to have sent; words, and bytes of these, that it holds before it sends them.
SENT, MET, MET_BYTES = 1 << 20, 1 << 17, 16 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_CUT = _BLANK | _ENDS
_TOTAL = U64(0x2545F4914F6CDD1D)
PROJECTION = "bucket int, pointers binary, counts binary, ids array<bigint>, langs array<string>, words array<string>"
GROWN = "w1 long, w2 long, w3 long, w4 long, n long"


def _part(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of b, and the number of piece ends before each; first: where texts begin."""
    cut = _CUT[b]
    before = np.empty(len(b), bool)
    before[0] = True
    before[1:] = cut[:-1]
    before[first[first < len(b)]] = True
    start = np.flatnonzero(before & ~cut)
    after = np.empty(len(b), bool)
    after[-1] = True
    after[:-1] = cut[1:] | before[1:]
    end = np.flatnonzero(after & ~cut) + 1
    return start, end, spans_hash(rolling(b, True), start, end), np.cumsum(_ENDS[b])[start]


def _parts(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        while end < len(b):
            back = np.flatnonzero(_CUT[b[end - PIECE : end]])
            if len(back):
                end += int(back[-1]) + 1 - PIECE
                break
            end = min(end + PIECE, len(b))
        yield at, b[at:end]
        at = end


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, counts, hashes, joined, starts, ends): of the words of texts i to j their number by text, their
    hashes, whether each follows the one before in the same piece, and where they lie in the buffer."""
    data, offsets = buffers(column)
    for i, j in runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        first = offsets[i : j + 1] - lo
        found, ended = [], 0
        pieces = [(0, data[lo:hi])] if hi - lo <= PIECE else _parts(data[lo:hi])
        for at, b in pieces:
            if len(b):
                start, end, h, piece = _part(b, first[:-1] if hi - lo <= PIECE else first[:1])
                found.append((start + at, end + at, h, piece + ended))
                ended += int(np.count_nonzero(_ENDS[b]))
        if found:
            start, end, h, piece = map(np.concatenate, zip(*found, strict=True))
        else:
            start = end = piece = np.zeros(0, np.int64)
            h = np.zeros(0, U64)
        bound = np.searchsorted(start, first)
        joined = np.zeros(len(h), bool)
        joined[1:] = piece[1:] == piece[:-1]
        joined[bound[:-1][bound[:-1] < len(h)]] = False
        yield i, j, np.diff(bound), h, joined, start + lo, end + lo


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    """A hash of each row's language; null counts as und."""
    data, offsets = buffers(pc.fill_null(batch.column("lang"), "und"))
    hashes = np.zeros(batch.num_rows, U64)
    for i, j in runs(offsets):
        lo = int(offsets[i])
        c = rolling(data[lo : int(offsets[j])])
        hashes[i:j] = spans_hash(c, offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo)
    return mix(hashes + _TOTAL)


def _words(batch: pa.RecordBatch) -> Iterator:
    """Hashes of words with their language; of each language itself as often as it has words."""
    langs = _languages(batch)
    for i, j, n, h, *_ in tokens(batch.column("text")):
        yield mix(h ^ np.repeat(langs[i:j], n))
        yield langs[i:j], n


class Frequent:
    """The frequent words and pairs, as arrays in the shared folder."""

    def __init__(self, spark, bits: int, least: int):
        self.bits, self.least = bits, least
        self.words = Sorted(shared.folder(spark, "words"), bits, ("counts",))
        self.pairs = Sorted(shared.folder(spark, "pairs"), bits, ("counts",))
        self.starts = np.zeros(1, np.int64)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, -1 where they aren't frequent, and counts."""
        keys, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for b, s in shared.cut(keys, self.bits):
            have = self.words.bucket(b)
            if have and len(have[0]):
                at = np.minimum(np.searchsorted(have[0], keys[s]), len(have[0]) - 1)
                ok = have[0][at] == keys[s]
                ids[s], counts[s] = np.where(ok, at + self.starts[b], -1), np.where(ok, have[1][at], 0)
        return ids[back], counts[back]

    def neighbours(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(ids, counts, both, starts, ends, languages) of the words of some texts; both: whether a word and the
        one before are a pair of frequent ones."""
        langs = _languages(batch)
        for i, j, n, h, joined, start, end in tokens(batch.column("text")):
            ids, counts = self.ids(mix(h ^ np.repeat(langs[i:j], n)))
            both = joined & (ids >= 0)
            both[1:] &= ids[:-1] >= 0
            yield ids, counts, both, start, end, np.repeat(np.arange(i, j), n)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix((first.astype(U64) << U64(32)) | second.astype(U64))


def _pairs(batch: pa.RecordBatch, frequent: Frequent) -> Iterator[np.ndarray]:
    for ids, _, both, *_ in frequent.neighbours(batch):
        at = np.flatnonzero(both)
        yield _pair(ids[at - 1], ids[at])


def _keep(table: pa.Table, store: Sorted, least: int) -> pa.Table:
    """Writes a bucket's frequent keys."""
    b, k, n = shared.merge(table)
    often = n >= least
    store.write(b, k[often], shared.least(n[often]))
    return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([int(often.sum())], pa.int64())})


def _projected(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Occurrence pointers of a task by the bucket of their prefix, and the words that it has met."""
    held: list[np.ndarray] = []
    sent: set[int] = set()
    met: list[tuple[int, str, str]] = []
    size = 0
    names = [x.split()[0] for x in PROJECTION.split(", ")]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def flush() -> pa.RecordBatch:
        rows, n = _merged(np.concatenate(held), None)
        held.clear()
        order = np.argsort(rows[:, 4], kind="stable")
        rows, n = rows[order], n[order]
        at = np.flatnonzero(np.diff(rows[:, 4], prepend=-1))
        out = [(int(rows[a, 4]), shared.pack(rows[a:b, :4].astype(np.uint32).ravel()), shared.narrow(n[a:b]), None, None, None) for a, b in zip(at, [*at[1:], len(rows)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def spell() -> pa.RecordBatch:
        """The words that were met, a row a bucket: as many rows as tasks and buckets, however many words."""
        dealt: dict[int, list] = {}
        for x in met:
            dealt.setdefault(x[0] & (1 << frequent.bits) - 1, []).append(x)
        met.clear()
        out = [(b, None, None, *map(list, zip(*x, strict=True))) for b, x in dealt.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        data, _ = buffers(batch.column("text"))
        for ids, counts, both, start, end, row in frequent.neighbours(batch):
            at = np.flatnonzero(both)
            keys, back = np.unique(_pair(ids[at - 1], ids[at]), return_inverse=True)
            both[at] = frequent.pairs.find(keys)[0][back]
            # where a frequent pair begins; how far pairs go on
            starts = np.flatnonzero(both) - 1
            used = np.unique(np.concatenate([ids[starts], ids[starts + 1]]), return_index=True) if len(starts) else (np.zeros(0, np.int64),) * 2
            fresh = np.array([x not in sent for x in used[0].tolist()], bool)
            if fresh.any():
                place = np.concatenate([starts, starts + 1])[used[1][fresh]]
                langs = batch.column("lang").take(pa.array(row[place])).to_pylist()
                words = [data[a:b].tobytes().lower().decode() for a, b in zip(start[place], end[place], strict=True)]
                sent.update(used[0][fresh].tolist())
                met += zip(used[0][fresh].tolist(), ["und" if x is None else x for x in langs], words, strict=True)
                size += sum(map(len, words)) + sum(map(len, filter(None, langs)))
                if len(met) >= MET or size >= MET_BYTES:
                    yield spell()
                    size = 0
                if len(sent) > SENT:
                    sent.clear()
            after = np.append(both, [False] * LONGEST)
            starts = starts[after[starts + 2]]
            if len(starts):
                longer = np.append(ids, [0] * LONGEST)
                third = np.where(after[starts + 3], longer[starts + 3] + 1, 0)
                rows = np.stack([ids[starts], ids[starts + 1], ids[starts + 2], third], 1)
                held.append(np.column_stack([rows, _bucket(rows, counts[starts], frequent.bits)]))
                if sum(map(len, held)) >= shared.HELD // 2:
                    yield flush()
    if held:
        yield flush()
    if met:
        yield spell()


def _spelt(table: pa.Table) -> pa.Table:
    """The distinct words of a bucket: the least language and spelling of each number."""
    flat = pa.table([pa.chunked_array([x.flatten() for x in table.column(c).chunks]) for c in ("ids", "langs", "words")], ["id", "lang", "word"])
    return flat.group_by("id").aggregate([("lang", "min"), ("word", "min")]).select(["id", "lang_min", "word_min"]).rename_columns(["id", "lang", "word"])


def _bucket(rows: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The task of each pointer: by its first word, and by what follows too where that has very many."""
    key = mix(rows[:, 0].astype(U64) + _TOTAL)
    hot = counts > PROJECTED
    if hot.any():
        follow = mix(mix(rows[hot, 1].astype(U64) << U64(32) | rows[hot, 2].astype(U64)) ^ rows[hot, 3].astype(U64))
        key[hot] = mix(key[hot] ^ (follow % (-(-counts[hot] // PROJECTED)).astype(U64)))
    return (key >> U64(64 - bits)).astype(np.int64)


def _merged(rows: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and their summed counts (n: None, one each)."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    if n is None:
        return rows[at], np.diff(np.append(at, len(rows)))
    return rows[at], np.add.reduceat(n[order], at)


def grow(rows: np.ndarray, n: np.ndarray, least: int, whole: bool, depth: int = 1, prefix: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of three words and more and their counts: extends a prefix to the right, depth-first.

    rows: sorted pointers of one prefix of ``depth`` words, each with the words from the prefix's last on;
    0 in the last column: nothing follows. Without ``whole``, counts of three words may be partial and are
    given whatever their size.
    """
    column = rows[:, depth]
    first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    total = np.add.reduceat(n, first)
    stop = np.append(first[1:], len(rows))
    last = depth == LONGEST - 1
    for a, b, t in zip(first.tolist(), stop.tolist(), total.tolist(), strict=True):
        word = int(column[a]) - last
        if word < 0 or t < least and (whole or last):
            continue
        longer = (*prefix, word)
        if depth >= 2:
            yield longer, t
        if not last:
            yield from grow(rows[a:b], n[a:b], least, whole, depth + 1, longer)


def _grown(table: pa.Table, frequent: Frequent, hot: np.ndarray) -> pa.Table:
    """The frequent phrases of the prefixes of one bucket; hot: the words that are dealt out."""
    rows = np.concatenate([shared.unpack(bytes(x.as_buffer()), np.uint32).reshape(-1, 4) for x in table.column("pointers")]).astype(np.int64)
    rows, n = _merged(rows, np.concatenate([shared.widen(bytes(x.as_buffer())) for x in table.column("counts")]))
    at = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
    out = []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(rows)], strict=True):
        w = int(rows[a, 0])
        whole = not len(hot) or hot[min(int(np.searchsorted(hot, w)), len(hot) - 1)] != w
        if whole and n[a:b].sum() < frequent.least:
            continue
        out += [((w, *p), c) for p, c in grow(rows[a:b], n[a:b], frequent.least, whole)]
    columns = [pa.array([p[k] if k < len(p) else None for p, _ in out], pa.int64()) for k in range(LONGEST)]
    return pa.table([*columns, pa.array([c for _, c in out], pa.int64())], names=[x.split()[0] for x in GROWN.split(", ")])


def _stored(batches: Iterator[pa.RecordBatch], frequent: Frequent, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The frequent words or pairs of some buckets as phrases."""
    for batch in batches:
        for b in batch.column("bucket").to_pylist():
            store = frequent.pairs if pairs else frequent.words
            have = store.bucket(b)
            if not have or not len(have[0]):
                continue
            for at in range(0, len(have[0]), 1 << 16):
                k, n = np.array(have[0][at : at + (1 << 16)]), np.array(have[1][at : at + (1 << 16)], np.int64)
                if pairs:
                    k = unmix(k)
                    w = [(k >> U64(32)).astype(np.int64), (k & U64(0xFFFFFFFF)).astype(np.int64)]
                else:
                    w = [np.arange(len(k)) + at + frequent.starts[b]]
                columns = [pa.array(x) for x in w] + [pa.nulls(len(k), pa.int64())] * (LONGEST - len(w))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [x.split()[0] for x in GROWN.split(", ")])


def _lookup(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """How many words each language has: the count of its hash."""
    for batch in batches:
        _, n = frequent.words.find(np.unique(_languages(batch)), 0)
        keys, back = np.unique(_languages(batch), return_inverse=True)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n[back])], ["lang", "total"])


def _phrase(*columns: str):
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def mine(documents: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two to four words.

    Texts are split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into words, A-Z as a-z.
    A null text is empty, a null language ``und``; ids take no part, and repeated rows count as often
    as they occur. A phrase counts wherever its words follow each other in a piece, overlaps included,
    and needs ``least`` occurrences. Its score is the least over its cuts of floor(scale * a / (l + r)), l and r
    the occurrences of both parts, ties by the earlier cut. A phrase inside a longer one that has at least
    ``percent`` of its occurrences is dropped. An empty table gives no rows.
    """
    spark = documents.sparkSession
    texts = documents.select("text", "lang")
    frequent = Frequent(spark, shared.bits(texts), least)
    seen = shared.mapped(texts, partial(shared.counted, hashes=_words, bucket_bits=frequent.bits), shared.PACKED)
    kept = seen.groupBy("bucket").applyInArrow(shared.with_args(_keep, store=frequent.words, least=least), "bucket int, n long").collect()
    size = np.zeros(1 << frequent.bits, np.int64)
    for r in kept:
        size[r.bucket] = r.n
    frequent.starts = np.concatenate([[0], np.cumsum(size)])
    if frequent.starts[-1] >= (1 << 32) - 1:
        raise ValueError("2**32 frequent words or more: a pair's key would not hold both numbers")
    seen = shared.mapped(texts, partial(shared.counted, hashes=partial(_pairs, frequent=frequent), bucket_bits=frequent.bits), shared.PACKED)
    seen.groupBy("bucket").applyInArrow(shared.with_args(_keep, store=frequent.pairs, least=least), "bucket int, n long").agg(F.sum("n")).collect()
    buckets = spark.range(1 << frequent.bits, numPartitions=min(1 << frequent.bits, int(spark.conf.get("spark.sql.shuffle.partitions")))).select(F.col("id").cast("int").alias("bucket"))
    single = shared.mapped(buckets, partial(_stored, frequent=frequent, pairs=False), GROWN)
    double = shared.mapped(buckets, partial(_stored, frequent=frequent, pairs=True), GROWN)
    # words beyond PROJECTED occurrences: at most one for each PROJECTED words of the corpus
    hot = np.sort(np.array([r.w1 for r in single.where(F.col("n") > PROJECTED).select("w1").collect()], np.int64))
    projected = shared.written(shared.mapped(texts, partial(_projected, frequent=frequent), PROJECTION), "projected")
    grown = projected.where("pointers is not null").select("bucket", "pointers", "counts").groupBy("bucket").applyInArrow(shared.with_args(_grown, frequent=frequent, hot=hot), GROWN)
    grown = grown.groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = ["w1", "w2", "w3", "w4"]
    phrases = shared.written(double.union(grown).select(_phrase(*words).alias("p"), F.col("n").alias("a")), "phrases")
    dictionary = projected.where("ids is not null").select("bucket", "ids", "langs", "words").groupBy("bucket").applyInArrow(shared.with_args(_spelt), "id long, lang string, word string")
    return _ranked(phrases, single.select(F.array("w1").alias("p"), F.col("n").alias("a")), dictionary, frequent, top, percent, scale)


def _ranked(phrases: DataFrame, single: DataFrame, dictionary: DataFrame, frequent: Frequent, top: int, percent: int, scale: int) -> DataFrame:
    size = F.size("p")
    held = phrases.where(size > 2).select(F.col("a").alias("f"), F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("p", i, k)))), lambda x: F.size(x) > 1)).alias("p"))
    held = held.groupBy("p").agg(F.max("f").alias("f"))
    left = phrases.join(held, "p", "left").where(F.col("f").isNull() | (100 * F.col("f").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)"))).select("p", "a")
    counts = single.union(phrases).select("p", F.col("a").alias("f"))
    cuts = left.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    # floor(scale * a / (l + r)) in whole numbers that may pass 64 bits
    score = F.expr(f"cast(({scale}BD * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("p", "a", "s.score", "s.l", "s.r")
    spelt = scored.select("p", "a", "score", "l", "r", F.posexplode("p").alias("i", "id")).join(dictionary, "id")
    spelt = spelt.groupBy("p", "a", "score", "l", "r").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the best of each part, then of all parts
    best = spelt.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = shared.mapped(dictionary.select("lang").distinct().withColumn("text", F.lit("")), partial(_lookup, frequent=frequent), "lang string, total long")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))

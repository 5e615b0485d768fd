"""Document fingerprints by locally consistent parsing.

A text's code points are names of level 0. At each level, runs of one name become one name with its
length; deterministic coin tossing (the lowest bit in which a name differs from the one before it,
and that bit, repeated until six labels are left) labels the names; local maxima of the labels begin
phrases of two to a dozen names, and a hash of a phrase's names is its name at the next level. Where a
phrase begins depends on a few names around it, so equal substrings get equal phrases inside,
whatever stands before them. Long texts are parsed in parts that end where a hash of the last eight
code points says so (once in 2^19), so equal substrings are also cut alike; a stretch without such a
place is cut each 2^20 code points from the last one.

A fingerprint is the 64 least 32-bit hashes among a text's distinct phrase names of level 1 and above
and its whole text, in order. A run of n equal names
counts n times, so that a line repeated over half a text weighs as much as it covers. Of two fingerprints, the likeness is the share of the 64 least hashes
of both together that both have: an unbiased estimate of the share of phrases they have in common.
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
from .text import U64, mix, powers

KEPT = 64
LEVELS = 24
#: Code points of rows that are compared together, about.
STRETCH = 1 << 18
#: Code points parsed together, and the longest part of a text.
LONGEST = 1 << 20
#: Code points that decide where a long text is cut, and the bits of their hash that must be zero.
WINDOW = 8
CUT_BITS = 19
_BIT = np.zeros(64, np.uint8)
_DE_BRUIJN = U64(0x03F79D71B4CB0A89)
_BIT[((U64(1) << np.arange(64, dtype=U64)) * _DE_BRUIJN >> U64(58)).astype(int)] = np.arange(64)
_MIXER = {1: U64(0x9E3779B97F4A7C15), 2: U64(0xC2B2AE3D27D4EB4F), 4: U64(0x165667B19E3779F9)}
_LOW = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _labels(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 in which no two neighbours of one text are equal, as no two names are."""
    x = a ^ np.concatenate([a[:1], a[:-1]])
    x[first] = 1
    bit = _BIT[((x & (~x + U64(1))) * _DE_BRUIJN) >> U64(58)]
    label = 2 * bit + ((a >> bit.astype(U64)) & U64(1)).astype(np.uint8)
    for _ in range(3):
        y = label ^ np.concatenate([label[:1], label[:-1]])
        y[first] = 1
        bit = _LOW[y]
        label = 2 * bit + ((label >> bit) & 1)
    return label


def _phrases(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The next level of texts that are not empty; and for each further name of a run a name of its own,
    with the number of its text."""
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = names[1:] != names[:-1]
    new[bounds[:-1]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    names = names[at]
    long = np.flatnonzero(length > 1)
    nth = np.ones(int((length[long] - 1).sum()), np.int64)
    nth[np.cumsum(length[long] - 1)[:-1]] -= length[long][:-1] - 1
    more = mix(np.repeat(names[long], length[long] - 1) ^ mix(np.cumsum(nth).astype(U64)))
    again = more, np.searchsorted(bounds, np.repeat(at[long], length[long] - 1), "right") - 1
    names = np.where(length > 1, mix(names * U64(3) + length.astype(U64)), names)
    bounds = np.searchsorted(at, bounds)
    first = bounds[:-1]
    label = _labels(names, first)
    top = np.zeros(len(names), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    top[first] = top[bounds[1:] - 1] = False
    top[np.minimum(first + 1, len(names) - 1)] = False
    top[first] = True
    start = np.flatnonzero(top)
    end = np.append(start[1:], len(names))
    power, inverse = powers(len(names) + 1)
    c = np.concatenate([np.zeros(1, U64), np.cumsum(names * power[: len(names)])])
    return mix((c[end] - c[start]) * inverse[start] + (end - start).astype(U64)), np.searchsorted(start, bounds), again


def _names(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64) + U64(1))


def cuts(names: np.ndarray) -> np.ndarray:
    """Places after which a text may be cut, by the WINDOW names before them."""
    if len(names) < WINDOW:
        return np.zeros(0, np.int64)
    h, size = names, 1
    while size < WINDOW:
        h = h[size:] + h[:-size] * _MIXER[size]
        size *= 2
    return np.flatnonzero(h >> U64(64 - CUT_BITS) == 0) + WINDOW


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, names, bounds): the parts of texts, about LONGEST code points at a time."""
    held: list[int] = []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = _names("".join(texts[k] for k in held))
        bounds = np.concatenate([[0], np.cumsum([len(texts[k]) for k in held])])
        at = cuts(names)
        doc = np.searchsorted(bounds, at, "right") - 1
        ok = (doc < len(held)) & (at - bounds[np.minimum(doc, len(held) - 1)] >= WINDOW)
        every = np.unique(np.concatenate([bounds, at[ok]]))
        return np.array(held)[np.searchsorted(bounds, every[:-1], "right") - 1], names, every

    size = 0
    for k, t in enumerate(texts):
        if len(t) > LONGEST:
            last, ends = 0, []
            for a in range(0, len(t), LONGEST):
                lo = max(0, a - WINDOW + 1)
                ends += (cuts(_names(t[lo : a + LONGEST])) + lo).tolist()
            for end in [*ends, len(t)]:
                while end > last:
                    stop = min(end, last + LONGEST)
                    yield np.array([k]), _names(t[last:stop]), np.array([0, stop - last])
                    last = stop
        elif t:
            held.append(k)
            size += len(t)
            if size >= LONGEST:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _least(doc: np.ndarray, h: np.ndarray, kept: int) -> np.ndarray:
    """Sorted distinct (document, 32-bit hash) keys, the ``kept`` least of each document."""
    key = np.sort((doc.astype(U64) << U64(32)) | h)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    of = key >> U64(32)
    first = np.searchsorted(of, of)
    return key[np.arange(len(key)) - first < kept]


def sketches(texts: list[str], kept: int = KEPT) -> list[np.ndarray]:
    """The fingerprints of texts, as ascending uint32 arrays; of an empty text, an empty one."""
    whole = [(k, int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") >> 32) for k, t in enumerate(texts) if t]
    held = [np.array([(k << 32) | h for k, h in whole], U64)]
    for owner, names, bounds in _groups(texts):
        found = []
        for level in range(1, LEVELS):
            names, bounds, (more, of) = _phrases(names, bounds)
            if level > 1:
                found.append((owner[of], mix(more ^ U64(LEVELS + level))))
            found.append((np.repeat(owner, np.diff(bounds)), mix(names ^ U64(level))))
            size = np.diff(bounds)
            if size.max() <= 1:
                break
            if level > 2 and (size <= 1).mean() > 0.5:  # only those go on that are not one name yet
                more = size > 1
                names, owner = names[np.repeat(more, size)], owner[more]
                bounds = np.concatenate([[0], np.cumsum(size[more])])
        doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
        held.append(_least(doc, h >> U64(32), kept))
    key = np.concatenate(held)
    key = _least(key >> U64(32), key & U64(0xFFFFFFFF), kept)
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=U64) << U64(32))
    return [key[a:b].astype(np.uint32) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """0 to 1; 1 for two empty texts, 0 for an empty and another."""
    x, y = a.tolist(), b.tolist()
    if x == y:
        return 1.0
    both = set(x).intersection(y)
    least = sorted(set(x).union(y))[:kept]
    return len(both.intersection(least)) / len(least)


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def _deal(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, firsts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their range of ids; the first of each range also at the end of the one before."""
    order = sorted(firsts)
    before = {firsts[b]: order[k - 1] for k, b in enumerate(order)}
    for batch in batches:
        key = np.array(batch.column("key"))
        bucket = np.searchsorted(bounds, key, "right")
        again = np.flatnonzero(np.isin(key, list(before)))
        at = np.concatenate([np.arange(len(key)), again])
        bucket = np.concatenate([bucket, [before[k] for k in key[again].tolist()]]).astype(np.int64)
        out = pa.Table.from_batches([batch]).take(pa.array(at)).add_column(0, "last", pa.array(np.arange(len(at)) >= len(key))).add_column(0, "bucket", pa.array(bucket))
        yield from out.combine_chunks().to_batches()


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and id; each with the next of its range."""
    held: tuple | None = None
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for batch in batches:
        group, size = [], 0
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "last", "doc_id", "text")), strict=True))
        for k, (bucket, last, doc, text) in enumerate(rows):
            group.append((bucket, last, doc, text or ""))
            size += len(text or "")
            if size < STRETCH and k < len(rows) - 1:
                continue
            seen = ([held] if held else []) + group
            edited = []
            for (b, end, _, t), (c, _, _, u) in zip(seen, seen[1:], strict=False):
                q = len(t) // 4
                edited.append(t[: len(t) - q] + u[:q] if b == c and not end else None)
            prints = sketches([x[3] for x in seen])
            changed = iter(sketches([t for t in edited if t is not None]))
            out = []
            for j, t in enumerate(edited):
                if t is not None:
                    p, e = prints[j], next(changed)
                    out.append((seen[j][2], len(seen[j][3]), hashlib.sha256(t.encode()).hexdigest(), _hex(p), _hex(e), likeness(p, e), likeness(p, prints[j + 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            held, group, size = seen[-1], [], 0


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: its fingerprint, that of its edited text, and their likeness,
    also to the next document's.

    Documents follow one another by ascending doc_id (null first; equal ids by text, null as empty),
    after the last comes the first, so a single row is its own next. The edited text has the last
    floor(n / 4) code points replaced by as many, or all, of the next document's first. A null text is
    empty, its fingerprint the empty string. Other columns are ignored. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(rows.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n), np.float64)).astype(np.int64)

    def bucketed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, np.array(batch.column("key")), "right"), pa.int64()), batch.column("key")], ["bucket", "key"])

    # one row a range of ids comes to the driver: a few for each task, however many documents there are
    firsts = shared.mapped(rows.select("key"), bucketed, "bucket long, key long").groupBy("bucket").agg(F.min("key").alias("key")).collect()
    dealt = shared.mapped(rows, partial(_deal, bounds=bounds, firsts={r.bucket: r.key for r in firsts}), "bucket long, last boolean, key long, doc_id long, text string")
    # a range lies in one partition, in order, and ends with the first of the next
    return shared.mapped(dealt.repartition(n // 8, "bucket").sortWithinPartitions("bucket", "last", "key", "text"), _compare, ROWS)


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity by maximum-scoring segments.

1. From a bounded sample of labelled texts (8,192 a class at most, the parameter ``sample``; those with
   the least hashes of their ids; of texts that share one of three minimum hashes of their shingles,
   as copies do, one) come the log-odds of words and of words' first 4, 5 and 6 bytes between the
   classes (the ``most`` features that most texts have), with a Dirichlet prior from both classes
   pooled: each class counts as if it had a tenth as many texts again, with a feature as often as both
   together have it. To be sure of them, they lose 2.5 standard deviations and a margin. A word
   scores by the longest of its features that the sample has often enough; all else scores nothing,
   and every word costs a small drift.
2. A linear scan finds all maximal-scoring segments of a text (Ruzzo and Tompa). Only words
   that score above zero are looped over; what lies between is a difference of running sums.
3. In clean text the number of segments that reach S is about K n exp(-lambda S) (Karlin and Altschul):
   lambda comes from the clean words' scores, K from the clean texts' segments. A segment expected
   less than once in a text is significant; a text's evidence is the sum of -log of these expectations.
4. A logistic curve makes a probability of log(1 + evidence). It is fitted on the sample, where each half
   is scored by the other half's log-odds, and corrected to the classes' shares among all labels. The
   margin is the one of MARGINS with which these halves have the least logistic loss.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .jaccard_join import sets
from .text import U64, mix, word_hashes

PREFIXES = (4, 5, 6)
#: Texts of the sample that must have a feature.
SEEN = 4
#: Texts of the prior for each text of the sample.
PRIOR = 0.1
DEVIATIONS = 2.5
#: Log-odds that may count as none: classes differ a little in their languages and lengths, and in a large
#: sample every common word is sure to be a little likelier in one of them.
MARGINS = (0.3, 0.6, 0.9, 1.2)
DRIFT = 0.1
COUNTS = "key long, n0 long, n1 long, n2 long, n3 long"


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    k: float = 0.01
    intercept: float = -3.0
    slope: float = 0.5


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Word features, then those of 6, 5 and 4 first bytes, each kind with a name space of its own; the
    two lowest bits are free."""
    for i, j, n, h in word_hashes(column, PREFIXES):
        yield i, j, n, [mix(x ^ U64(k)) & ~U64(3) for k, x in enumerate([h[0], *h[:0:-1]])]


def _sample_counts(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        code = np.array(batch.column("half")).astype(U64) * U64(2) + np.array(batch.column("toxic")).astype(U64)
        for i, _, n, hs in features(batch.column("text")):
            stop = np.cumsum(n)
            for k, (a, b) in enumerate(zip(stop - n, stop, strict=True)):
                if b > a:
                    yield shared.distinct(np.concatenate([h[a:b] for h in hs]))[0] | code[i + k]

    yield from shared.counted(batches, hashes, bucket_bits)


def _frequent(table: pa.Table) -> pa.Table:
    """Of one bucket the features that several texts have: the texts of each half and class."""
    _, k, n = shared.merge(table)
    key, code = k & ~U64(3), (k & U64(3)).astype(int)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.zeros((4, len(at)), np.int64)
    np.add.at(counts, (code, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(k))))), n)
    some = counts.sum(0) >= SEEN
    return pa.table([key[at][some].view(np.int64), *counts[:, some]], ["key", "n0", "n1", "n2", "n3"])


def log_odds(toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int], margin: float) -> np.ndarray:
    """Log-odds of features between the classes, by the texts that have them, brought towards zero by
    their deviations and the margin."""
    t, c = max(texts[0], 1), max(texts[1], 1)
    share = (toxic + clean) / (t + c)
    a, b = toxic + PRIOR * t * share, clean + PRIOR * c * share
    d = np.log(a / b) - math.log(t / c)
    return np.sign(d) * np.maximum(np.abs(d) - DEVIATIONS * np.sqrt(1 / a + 1 / b) - margin, 0)


def word_scores(model: Model, hs: list[np.ndarray]) -> np.ndarray:
    out, open_ = np.zeros(len(hs[0])), np.ones(len(hs[0]), bool)
    if len(model.keys):
        for h in hs:
            q = h[open_]
            at = np.minimum(np.searchsorted(model.keys, q), len(model.keys) - 1)
            ok = model.keys[at] == q
            where = np.flatnonzero(open_)[ok]
            out[where] = model.odds[at[ok]]
            open_[where] = False
    return out - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, end) with their scores, in one pass over the positive scores."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    some = np.flatnonzero(scores > 0)
    # start, end, sum before, sum after, and the place of the last one before it with a smaller sum before
    held: list[tuple[int, int, float, float, int]] = []
    for k, left, right in zip(some.tolist(), total[some].tolist(), total[some + 1].tolist(), strict=True):
        lo, j = k, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((lo, k + 1, left, right, j))
                break
            lo, _, left, _, before = held[j]
            del held[j:]
            j = before
    return [(a, b, y - x) for a, b, x, y, _ in held]


def evidence(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
    """The sum over significant segments, and these with their expectations."""
    kept = [(a, b, model.k * n * math.exp(-model.rate * s)) for a, b, s in found]
    kept = [x for x in kept if x[2] < 1]
    return sum(-math.log(max(x[2], 1e-300)) for x in kept), kept


def _texts(model: Model, column: pa.Array) -> Iterator[tuple[int, int, list, np.ndarray]]:
    """For each text its number, words, segments and word scores."""
    for i, _, n, hs in features(column):
        s = word_scores(model, hs)
        stop = np.cumsum(n)
        for k, (a, b) in enumerate(zip(stop - n, stop, strict=True)):
            x = s[a:b]
            yield i + k, int(b - a), segments(x) if b > a and x.max() > 0 else [], x


def _calibration(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Of each sampled text and margin its class, words and the scores of its segments; and, one row a
    batch, half and margin, a histogram of the clean words' scores (its class is null)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
    for batch in batches:
        half, toxic = np.array(batch.column("half")), np.array(batch.column("toxic"))
        for fold in (0, 1):
            rows = np.flatnonzero(half == fold)
            column = batch.column("text").take(pa.array(rows))
            for m, pair in enumerate(models.value):
                out, words = [], Counter()
                for k, n, found, x in _texts(pair[1 - fold], column):
                    y = int(toxic[rows[k]])
                    out.append((m, y, n, [s for *_, s in found], [], []))
                    if not y:
                        bins, counts = np.unique(np.round(x, 2), return_counts=True)
                        words.update(dict(zip(bins.tolist(), counts.tolist(), strict=True)))
                out.append((m, None, 0, [], list(words), list(words.values())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["margin", "toxic", "n", "segments", "bins", "counts"])


def karlin_rate(bins: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(rate * bin) = 1; at most 4, and that where nothing scores above zero."""
    lo, hi = 1e-3, 4.0
    f = lambda x: float((share * np.exp(x * bins)).sum()) - 1
    if f(hi) < 0:
        return hi
    if f(lo) > 0:
        return lo
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a slight pull towards a slope of 0.5."""
    a = np.stack([np.ones(len(x)), x], 1)
    w = np.array([-3.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1.0])
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - np.array([0.0, w[1] - 0.5]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        least = [[int(mix(s ^ U64(k)).min().view(np.int64)) if len(s) else 0 for k in (1, 2, 3)] for _, s in sets(text)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), text, *(pa.array([x[k] for x in least], pa.int64()) for k in range(3))], ["toxic", "text", "m0", "m1", "m2"])


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def calibrated(model: Model, seen: pa.Table, size: dict[int, int]) -> float:
    """Sets the model's rate, k, intercept and slope by _calibration()'s rows; returns the logistic loss."""
    hist = seen.filter(pc.is_null(seen.column("toxic")))
    bins, counts = (np.array([x for row in hist.column(c).to_pylist() for x in row]) for c in ("bins", "counts"))
    seen = seen.filter(pc.is_valid(seen.column("toxic")))
    toxic, words, scores = np.array(seen.column("toxic")), np.array(seen.column("n")), seen.column("segments").to_pylist()
    if len(bins):
        model.rate = karlin_rate(bins, counts / counts.sum())
    reach = sum(model.rate * s >= 1 for row, y in zip(scores, toxic, strict=True) if y == 0 for s in row)
    model.k = max(reach * math.e / max(int(words[toxic == 0].sum()), 1), 1e-6)
    x = np.log1p([evidence(model, [(0, 0, s) for s in row], int(m))[0] for row, m in zip(scores, words, strict=True)])
    weight = np.array([size[y] / sum(size.values()) * len(toxic) / max((toxic == y).sum(), 1) for y in (0, 1)])[toxic]
    model.intercept, model.slope = logistic(x, toxic, weight)
    return float((weight * np.logaddexp(0, (1 - 2 * toxic) * (model.intercept + model.slope * x))).sum())


def fit(documents: DataFrame, labels: DataFrame, sample: int = 8192, most: int = 1 << 18) -> Model:
    """labels: doc_id and toxic (0 or 1; others and nulls are left out). Without labels of both classes
    the model finds nothing toxic."""
    spark = documents.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    size = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model()
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    # at most twice ``sample`` rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = shared.mapped(rows.select("toxic", "text"), _least_hashes, "toxic long, text string, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        rows = rows.groupBy(m).agg(F.max(F.struct("toxic", "text", *sorted({"m0", "m1", "m2"} - {m}))).alias("row")).select("row.*", m)
    rows = shared.written(rows.select("toxic", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")), "toxic-sample")
    n = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    found = shared.mapped(rows, partial(_sample_counts, bucket_bits=shared.bits(rows)), shared.PACKED).groupBy("bucket").applyInArrow(shared.with_args(_frequent), COUNTS)
    # at most ``most`` rows of five numbers
    found = found.orderBy(F.desc(F.expr("n0 + n1 + n2 + n3")), "key").limit(most).toArrow()
    keys = np.array(found.column("key")).view(U64)
    order = np.argsort(keys)
    keys, table = keys[order], np.stack([np.array(found.column(f"n{k}"))[order] for k in range(4)])

    def model(halves: tuple[int, ...], margin: float) -> Model:
        t, c = (sum(table[2 * h + y] for h in halves) for y in (1, 0))
        enough = t + c >= max(2, SEEN * len(halves) // 2)
        texts = tuple(sum(n.get((h, y), 0) for h in halves) for y in (1, 0))
        return Model(keys[enough], log_odds(t[enough], c[enough], texts, margin))

    pairs = spark.sparkContext.broadcast([(model((0,), m), model((1,), m)) for m in MARGINS])
    # a row for each text of the sample and margin
    seen = shared.mapped(rows, partial(_calibration, models=pairs), "margin long, toxic long, n long, segments array<double>, bins array<double>, counts array<long>").toArrow()
    best: tuple[float, Model] | None = None
    for m, margin in enumerate(MARGINS):
        made = model((0, 1), margin)
        loss = calibrated(made, seen.filter(pc.equal(seen.column("margin"), m)), size)
        if best is None or loss < best[0]:
            best = loss, made
    return best[1]


ROWS = "doc_id long, held_out boolean, score double, predicted int, evidence double, segments array<struct<start: long, end: long, expected: double>>"


def _probability(m: Model, x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, m.intercept + m.slope * math.log1p(x)))))


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))
    for batch in batches:
        out = []
        for _, n, found, _ in _texts(m, batch.column("text")):
            x, kept = evidence(m, found, n)
            p = _probability(m, x)
            out.append((p, int(p >= threshold), x, [{"start": a, "end": b, "expected": e} for a, b, e in kept]))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.float64(), span), strict=True))], [x.split()[0] for x in ("doc_id", "held_out", "score", "predicted", "evidence", "segments")])


def score(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row for each row of documents (doc_id, held_out, text): the probability of toxicity, whether
    it reaches the threshold, the evidence, and the significant segments in words. A null or empty text
    has none and so the least probability."""
    return shared.mapped(documents.select("doc_id", "held_out", "text"), partial(_score, model=documents.sparkSession.sparkContext.broadcast(model), threshold=threshold), ROWS)


def learned(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Model:
    """The model of the labels that are not held out."""
    return fit(documents, labels.where(fold(F.col("doc_id"), folds) != held))


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from labels of documents whose crc32 of the id as text is not ``held`` modulo ``folds``;
    scores every document, from its text alone.

    Labels without a document and documents without a label do no harm; a document labelled twice is
    toxic if either label says so. Repeated rows are scored alike; a null id counts as the empty text in
    the fold. An empty table gives no rows.
    """
    model = learned(documents, labels, folds, held)
    return score(documents.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held).alias("held_out")), model)


def _clean(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        toxic = [_probability(m, evidence(m, found, n)[0]) >= threshold for _, n, found, _ in _texts(m, batch.column("text"))]
        yield batch.filter(pa.array([not x for x in toxic], pa.bool_()))


def reject(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """documents with all their columns, without the rows predicted toxic. Each row is judged by its own
    text, whatever its id is and whether it has one."""
    model = documents.sparkSession.sparkContext.broadcast(learned(documents, labels))
    return shared.mapped(documents, partial(_clean, model=model, threshold=threshold), documents.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("segments").cast("long").alias("n_segments"))

"""Centroid clustering by exponion search, in exact integers.

Vectors are cut into chunks of about 16,384, written once as arrays in the shared folder beside the
state of each vector: its centroid, an upper bound on the distance to it and a lower bound on the
distance to any other. A round is one job over the chunks' names. A task maps a chunk and its state,

1. widens the bounds by how far the centroids have moved, and leaves vectors alone whose upper bound
   is below the lower one;
2. makes the upper bound of the others exact and looks again;
3. scans, for what is left, only the centroids within 2 u + s of the current one, where u is the
   distance to it and s its distance to the nearest other centroid: the list of the other centroids
   sorted by distance gives them as a prefix. The radius is inclusive, so ties are seen, and the ball
   holds the nearest and the second nearest;

and writes the new state, under the round's number, and sums its vectors by centroid. Sums are added
in two steps, so the driver sees one row a centroid. State of a round depends only on written files:
a task that runs again writes the same.

Components are integers; squared distances are exact: in 64 bits where magnitudes allow it
(below 2**27 for 64 components), else in Python's integers, where no bounds are kept and all centroids are scanned.
Bounds are doubles with a margin, so rounding only costs a scan.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

CHUNK = 16_384
#: Room for rounding in comparisons of bounds.
MARGIN = 1e-9
SUMS = "cluster int, n long, sums array<string>"
GROUPS = 64


def usable(v: Column, dimension: int) -> Column:
    """Whether a vector has that many components, all of them finite numbers."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def wide(dimension: int) -> int:
    """The magnitude from which 64 bits may not hold a squared distance, and 32 bits not a component."""
    return min(1 << 31, math.isqrt((1 << 63) // max(dimension, 1)) // 2)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; scale: a power of two. Python's integers where 64 bits don't do."""
    if not len(x) or np.abs(x).max() < wide(x.shape[1]) / scale - 1:
        return np.floor(x * scale).astype(np.int64)
    # from 2**53 on doubles are integers
    return np.array([[int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from c, a row or one for each."""
    if x.dtype == object or c.dtype == object:
        d = x.astype(object) - c.astype(object)
        return (d * d).sum(1) if len(d) else np.zeros(0, object)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _store(x: np.ndarray) -> np.ndarray:
    """An array that can be saved: int32 where it does, digits for Python's integers."""
    if x.dtype == object:
        return np.array([[str(v) for v in row] for row in x], "U")
    return x.astype(np.int32)


def _restore(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object) if x.dtype.kind == "U" else np.asarray(x, np.int64)


class Centroids:
    """The centroids of a round as exact integers, what lies between them, and how far they have moved."""

    def __init__(self, rows: list[list[int]], before: Centroids | None = None):
        self.rows = rows
        self.wide = any(abs(v) >= wide(len(r)) for r in rows for v in r)
        self.array = np.array(rows, object if self.wide else np.int64).reshape(len(rows), -1)
        self.moved = np.zeros(len(rows))
        if self.wide:
            return
        far = np.sqrt(np.stack([squared(self.array, c) for c in self.array]).astype(np.float64))
        np.fill_diagonal(far, -1.0)
        #: For each centroid all of them by distance, itself first; ties by number.
        self.order = np.argsort(far, axis=1, kind="stable")
        np.fill_diagonal(far, 0.0)
        self.far = np.take_along_axis(far, self.order, 1)
        self.nearest = self.far[:, 1] if len(rows) > 1 else np.full(1, np.inf)
        if before is not None and not before.wide:
            self.moved = np.sqrt(squared(self.array, before.array).astype(np.float64))

    def others(self) -> np.ndarray:
        """For each centroid the farthest way that another has moved."""
        if len(self.moved) < 2:
            return np.zeros(len(self.moved))
        two = np.sort(self.moved)[-2:]
        return np.where(self.moved == two[1], np.where(np.count_nonzero(self.moved == two[1]) > 1, two[1], two[0]), two[1])


def _scan_all(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared distance."""
    a, best = np.zeros(len(x), np.int64), squared(x, c.array[0])
    for j in range(1, len(c.rows)):
        d = squared(x, c.array[j])
        less = (d < best).astype(bool)
        a[less], best[less] = j, d[less]
    return a, best


def assign(x: np.ndarray, c: Centroids, a: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids, upper and lower bounds after a move, and how many distances were computed."""
    if x.dtype == object or c.wide:
        return _scan_all(x, c)[0], np.full(len(x), np.inf), np.zeros(len(x)), len(x) * len(c.rows)
    work = 0
    if a is None:
        a, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    else:
        a, upper, lower = a.copy(), upper + c.moved[a], np.maximum(lower - c.others()[a], 0.0)
    open_ = np.flatnonzero(~(upper * (1 + MARGIN) + MARGIN < lower))
    exact = squared(x[open_], c.array[a[open_]])
    work += len(open_)
    upper[open_] = np.sqrt(exact.astype(np.float64))
    still = ~(upper[open_] * (1 + MARGIN) + MARGIN < lower[open_])
    open_, exact = open_[still], exact[still]
    if len(open_) and len(c.rows) > 1:
        home = a[open_]
        radius = (2 * upper[open_] + c.nearest[home]) * (1 + MARGIN) + MARGIN
        # how many of the sorted list lie inside the ball
        inside = np.zeros(len(open_), np.int64)
        for h in np.unique(home):
            s = home == h
            inside[s] = np.searchsorted(c.far[h], radius[s], "right")
        best, who = exact.copy(), home.copy()
        second = np.full(len(open_), np.iinfo(np.int64).max)
        for j in range(1, len(c.rows)):
            at = np.flatnonzero(inside > j)
            if not len(at):
                break
            k = c.order[home[at], j]
            d = squared(x[open_[at]], c.array[k])
            work += len(at)
            first = (d < best[at]) | ((d == best[at]) & (k < who[at]))
            second[at] = np.where(first, best[at], np.minimum(second[at], d))
            who[at], best[at] = np.where(first, k, who[at]), np.where(first, d, best[at])
        a[open_], upper[open_], lower[open_] = who, np.sqrt(best.astype(np.float64)), np.sqrt(second.astype(np.float64))
    elif len(open_):
        lower[open_] = np.inf
    return a, upper, lower, work


def _chunked(batches: Iterator[pa.RecordBatch], uri: str, scale: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """Writes the chunks of a task; yields their names."""
    held: list[pa.RecordBatch] = []

    def saved() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        name = uuid.uuid4().hex  # another attempt writes others, and only one attempt's names count
        x = np.array(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dimension)
        ids = table.column("vec_id")
        shared.save(uri, f"{name}-vectors", _store(integers(x, scale)))
        shared.save(uri, f"{name}-ids", np.array(ids.fill_null(0), np.int64))
        shared.save(uri, f"{name}-named", ~np.array(ids.is_null().combine_chunks(), bool))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([name])], ["chunk"])

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            if sum(b.num_rows for b in held) >= CHUNK:
                yield saved()
    if held:
        yield saved()


def _assigned(uri: str, chunk: str, turn: int, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a chunk and their centroids in this round, whose state is written."""
    x = _restore(shared.load(uri, f"{chunk}-vectors"))
    state = (None, np.zeros(0), np.zeros(0))
    if turn:
        state = tuple(np.array(shared.load(uri, f"{chunk}-{k}-{turn - 1}")) for k in ("at", "upper", "lower"))
    a, upper, lower, _ = assign(x, c, *state)
    for k, v in (("at", a.astype(np.int32)), ("upper", upper), ("lower", lower)):
        shared.save(uri, f"{chunk}-{k}-{turn}", v)
    return x, a


def _added(batches: Iterator[pa.RecordBatch], uri: str, turn: int, c: Centroids) -> Iterator[pa.RecordBatch]:
    """A task's sums of vectors by centroid."""
    sums: dict[int, list] = {}
    for batch in batches:
        for chunk in batch.column("chunk").to_pylist():
            x, a = _assigned(uri, chunk, turn, c)
            for k in np.unique(a):
                s = x[a == k]
                have = sums.setdefault(int(k), [0, [0] * x.shape[1]])
                have[0] += len(s)
                have[1] = [p + int(q) for p, q in zip(have[1], s.sum(0), strict=True)]
    yield _sums(sums)


def _sums(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([[str(v) for v in s] for _, s in sums.values()], pa.list_(pa.string()))], ["cluster", "n", "sums"])


def _total(table: pa.Table) -> pa.Table:
    """One centroid's sums, of integers of any size."""
    rows = table.column("sums").to_pylist()
    total = [sum(int(v) for v in column) for column in zip(*rows, strict=True)]
    return pa.Table.from_batches([_sums({table.column("cluster")[0].as_py(): [sum(table.column("n").to_pylist()), total]})])


def _final(batches: Iterator[pa.RecordBatch], uri: str, turn: int, c: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in batch.column("chunk").to_pylist():
            x, a = _assigned(uri, chunk, turn, c)
            d = squared(x, c.array[a])
            if d.dtype == object:
                d = [int(v) if v < 1 << 63 else None for v in d]
            ids = pa.array(np.array(shared.load(uri, f"{chunk}-ids")), mask=~np.array(shared.load(uri, f"{chunk}-named")))
            yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])


def fitted(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, salt: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, a written table, and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"), dimension)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    # k rows come to the driver
    first = kept.orderBy(drawn.asc_nulls_last(), "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    uri = shared.folder(spark, "vectors")
    chunks = shared.written(shared.mapped(kept, partial(_chunked, uri=uri, scale=scale, dimension=dimension), "chunk string"), "chunks")
    chunks = chunks.repartition(max(1, min(chunks.count(), 4 * spark.sparkContext.defaultParallelism)))
    c = Centroids(integers(np.array([r.embedding for r in first], np.float64), scale).tolist())
    for turn in range(rounds):
        sums = shared.mapped(chunks, partial(_added, uri=uri, turn=turn, c=c), SUMS)
        sums = sums.groupBy("cluster", F.pmod(F.hash("sums"), F.lit(GROUPS)).alias("part")).applyInArrow(shared.with_args(_total), SUMS)
        rows = {r.cluster: r for r in sums.groupBy("cluster").applyInArrow(shared.with_args(_total), SUMS).collect()}
        c = Centroids([[int(v) // rows[j].n for v in rows[j].sums] if j in rows else old for j, old in enumerate(c.rows)], c)
    return shared.written(shared.mapped(chunks, partial(_final, uri=uri, turn=rounds, c=c), "vec_id long, cluster int, distance long"), "clusters"), c.rows


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that has ``dimension``
    components, none null or non-finite; components are floor(scale * x).

    The first centroids are the k vectors with the least sha256 of ``salt:vec_id``, vectors without an id
    last, ties by their components; with fewer vectors there are fewer centroids. Repeated rows are
    vectors each. A centroid without vectors stays as it is. Rows without a usable vector aren't
    returned; an empty table gives no rows. Squared distances and sums beyond 64 bits are null.
    """
    spark = vectors.sparkSession
    rows, centroids = fitted(vectors, k, rounds, dimension, scale, salt)
    # one row a centroid
    known = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.bool_and(F.col("distance").isNotNull()).alias("ok")).collect()
    total = {r.cluster: int(r.s) if r.ok else None for r in known}
    every = None if None in total.values() else sum(total.values())
    fits = None if every is None or every >= 1 << 63 else every
    names = [(j, total[j] if total.get(j) is not None and total[j] < 1 << 63 else None, fits, hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for j, r in enumerate(centroids) if j in total]
    named = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Nearest neighbours by score-aware anisotropic quantisation.

The least Euclidean distance is the greatest inner product q.x - |x|**2 / 2, from the sample's mean. Vectors are quantised in
pairs of components with 16 centroids each, four bits a pair. The codebooks minimise a loss that
weighs the part of a residual along its vector ``weight`` times the part across it, as an error along
the vector changes the inner products that matter; assignments are found pair by pair against the
others, and all codebooks together by least squares. They are fitted on a bounded sample (8,192
vectors at most, those with the least hashes of their ids; the parameter ``sample``).

Every row is indexed once: its codes, half its squared norm, its id. Queries are written to the shared
folder in chunks of about 1,024, and each task of the index maps them; rows are never sent to queries.
Two codes make a byte, and for each byte a table of 256 partial products a query is looked up and
summed over blocks of 16,384 rows. Beforehand a 64th of the rows, by the hash of their ids, gives each
query a threshold T: the distance of its 16th best different one there (its k-th, if k is more), which about
a thousand of all rows reach. A row keeps how far its codes put it from where it is, r: one within T of a
query has codes within T + r of it. So a block looks at the rows whose codes are, by exact products and then by the
distances themselves, and sends those within T, the best ``rerank``. What the codes can't tell apart
(tight groups, equal codes, outliers) costs time and loses no neighbour; a bound has room for rounding.
What is shuffled grows with the queries and not with queries times blocks. Of equal vectors only those with
the k + 1 least ids can be among a query's k nearest; the others give way there, so that a vector which
a third of the rows share doesn't crowd out the rest.

The scan itself compares every query with every row: with queries as a fixed share of rows its
arithmetic grows with their square, at two table lookups for four components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ASKED = 1024
ROWS = 16_384
CENTROIDS = 16
#: One row in so many gives the threshold, which is its so-many-th best different product.
SPARSE = 64
PLACE = 16
#: Room for rounding: of sums in single precision; of products in double precision from the centre; of the centre itself.
ROUGH, FINE, SHIFT = 1e-4, 1e-12, 1e-20
#: Share of a block's pairs that the codes leave from which products are taken of all.
MANY = 0.02


def slack(d, *squares) -> np.ndarray:
    """What a squared distance d from products may be off by; squares: of both vectors from the centre, then from zero."""
    a, b, c, e = squares
    return 1e-9 * np.abs(d) + FINE * (a + b) + SHIFT * (c + e)


def usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _assign(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes that minimise |r|**2 + (weight - 1) (r.u)**2, pair by pair; u: the vector's direction."""
    n, pairs = len(x), len(books)
    s = x.reshape(n, pairs, 2)
    u = s / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    codes = np.stack([((s[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(pairs)], 1)
    along = np.zeros((n, pairs))
    for p in range(pairs):
        along[:, p] = ((s[:, p] - books[p][codes[:, p]]) * u[:, p]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        for p in range(pairs):
            r = s[:, p, None] - books[p]
            a = (r * u[:, p, None]).sum(2)
            rest = total - along[:, p]
            codes[:, p] = ((r**2).sum(2) + (weight - 1) * (a + rest[:, None]) ** 2).argmin(1)
            along[:, p] = a[np.arange(n), codes[:, p]]
            total = rest + along[:, p]
    return codes


def train(x: np.ndarray, weight: float, rounds: int = 4) -> np.ndarray:
    """Codebooks (pairs, 16, 2) for vectors of even length."""
    rng = np.random.default_rng(7)
    n, pairs = len(x), x.shape[1] // 2
    s = x.reshape(n, pairs, 2)
    books = s[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)].transpose(1, 0, 2).copy()
    for _ in range(8):
        for p in range(pairs):
            code = ((s[:, p, None] - books[p]) ** 2).sum(2).argmin(1)
            size = np.bincount(code, minlength=CENTROIDS)
            mean = np.stack([np.bincount(code, s[:, p, k], CENTROIDS) for k in (0, 1)], 1) / np.maximum(size, 1)[:, None]
            books[p] = np.where(size[:, None] > 0, mean, books[p])
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
    m = pairs * CENTROIDS * 2
    for _ in range(rounds):
        codes = _assign(x, books, weight, 1)
        a, b = np.eye(m) * 1e-6, np.zeros(m)
        b += 1e-6 * books.ravel()
        for lo in range(0, n, 1024):
            c, y, w = codes[lo : lo + 1024], x[lo : lo + 1024], u[lo : lo + 1024]
            at = ((np.arange(pairs) * CENTROIDS + c) * 2)[:, :, None] + np.arange(2)
            at = at.reshape(len(c), -1)
            v = np.zeros((len(c), m))
            np.put_along_axis(v, at, w, 1)
            a += (weight - 1) * v.T @ v
            np.add.at(a, (at, at), 1.0)
            np.add.at(b, at, y + (weight - 1) * w * (y * w).sum(1)[:, None])
        books = np.linalg.solve(a, b).reshape(pairs, CENTROIDS, 2)
    return books


def anisotropy(dimension: int, threshold: float = 0.2) -> float:
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


def square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes (n, pairs) stand for."""
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    x = np.array(column.flatten(), np.float64).reshape(-1, dimension)
    return np.pad(x, ((0, 0), (0, dimension % 2)))


def _index(batches: Iterator[pa.RecordBatch], books: np.ndarray, centre: np.ndarray, weight: float, dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = _matrix(part.column("embedding"), dimension)
            with np.errstate(all="ignore"):
                y = x - centre
                codes = _assign(y, books, weight).astype(np.uint8)
                z = decoded(codes, books)
                off = np.linalg.norm(y - z, axis=1)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, ::2] * 16 + codes[:, 1::2]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("same"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(square(z)), pa.array(off), pa.array([r.tobytes() for r in x], pa.binary())], INDEX.replace(" long", "").replace(" binary", "").replace(" double", "").split(", "))


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): the partial products of two codes in a byte."""
    t = np.einsum("npk,pck->pcn", q.reshape(len(q), -1, 2), books)
    if len(t) % 2:
        t = np.concatenate([t, np.zeros((1, *t.shape[1:]))])
    return (t[::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, CENTROIDS**2, -1).astype(np.float32)


class Block:
    """Up to ROWS rows of the index, ready to be scanned. Of equal vectors the k + 1 least ids stay."""

    def __init__(self, rows: pa.Table, centre: np.ndarray, k: int):
        ids, same = np.array(rows.column("vec_id")), np.array(rows.column("same"))
        order = np.lexsort((ids, same))
        first = np.flatnonzero(np.diff(same[order], prepend=same[order[0]] - 1))
        size = np.diff(np.append(first, len(ids)))
        order = order[np.arange(len(ids)) - np.repeat(first, size) <= k]
        order = order[np.argsort(ids[order], kind="stable")]
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        self.ids, self.same, self.codes = ids[order], same[order], codes
        self.coded, self.off = np.array(rows.column("coded"))[order], np.array(rows.column("off"))[order]
        self.rows = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)[order]
        self.centred = self.rows - centre
        self.square, self.whole = square(self.centred), square(self.rows)
        # (T + r)**2 >= |q|**2 + coded - 2 product, solved for the product; T**2 and |q|**2 come with the query
        self.bound = (self.coded * (1 - ROUGH) - self.off**2 * (1 + ROUGH)) / 2

    def best(self, names: np.ndarray, q: np.ndarray, most: np.ndarray, books: np.ndarray, centre: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query ids, ids, same, squared distances) of the rows whose squared distance is within ``most`` of the
        queries, ``keep`` a query at most, equal ones by ascending id. What isn't a number counts as within."""
        for lo in range(0, len(names), 64):
            asked, limit = q[lo : lo + 64], most[lo : lo + 64]
            y = asked - centre
            mine, t = square(y), tables(y, books)
            s = np.zeros((len(self.ids), len(asked)), np.float32)
            for m in range(len(t)):
                s += t[m][self.codes[:, m]]
            least = (mine * (1 - ROUGH) - limit * (1 + ROUGH)) / 2 + self.bound[:, None]
            least -= self.off[:, None] * (np.sqrt(limit) * (1 + ROUGH))
            near = ~(s < least) | (self.coded > 1e30)[:, None] | (mine > 1e30)
            # many: one product of matrices costs less than picking rows
            every = self.centred @ y.T if near.mean() > MANY else None
            for j, name in enumerate(names[lo : lo + 64]):
                at = np.flatnonzero(near[:, j] & (self.ids != name))
                d = mine[j] + self.square[at] - 2 * (every[at, j] if every is not None else self.centred[at] @ y[j])
                room = slack(d, mine[j], self.square[at], asked[j] @ asked[j], self.whole[at])
                at = at[~(d - room > limit[j])]
                if len(at) > keep:
                    # not those that ``keep`` others are surely nearer than
                    d = mine[j] + self.square[at] - 2 * (self.centred[at] @ y[j])
                    room = slack(d, mine[j], self.square[at], asked[j] @ asked[j], self.whole[at])
                    at = at[~(d - room > np.partition(d + room, keep - 1)[keep - 1])]
                x = square(self.rows[at] - asked[j])
                some = np.lexsort((self.ids[at], x))[:keep]
                yield np.full(len(some), name), self.ids[at[some]], self.same[at[some]], x[some]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Queries:
    """The queries, in chunks of arrays in the shared folder: ids, vectors, then thresholds."""

    def __init__(self, asked: DataFrame, dimension: int):
        self.uri, self.dimension = shared.folder(asked.sparkSession, "queries"), dimension
        self.chunks = max(1, -(-asked.count() // ASKED))
        rows = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(self.chunks)).alias("chunk"), "vec_id", "query")
        rows.groupBy("chunk").applyInArrow(shared.with_args(_save_queries, queries=self), "chunk long").agg(F.count("*")).collect()

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for c in range(self.chunks):
            try:
                yield c, shared.load(self.uri, f"{c}-ids"), shared.load(self.uri, f"{c}-vectors")
            except FileNotFoundError:  # no id falls into this chunk
                pass

    def most(self, chunk: int, n: int) -> np.ndarray:
        try:
            return shared.load(self.uri, f"{chunk}-most")
        except FileNotFoundError:  # no row in the 64th
            return np.full(n, np.inf)


def _save_queries(table: pa.Table, queries: Queries) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    shared.save(queries.uri, f"{chunk}-ids", np.array(table.column("vec_id")))
    shared.save(queries.uri, f"{chunk}-vectors", _matrix(table.column("query").combine_chunks(), queries.dimension))
    return pa.table({"chunk": [chunk]})


def _place(s: np.ndarray, place: int) -> np.ndarray:
    """The ``place`` least different values of each row, ascending, with infinity for missing ones."""
    s = np.sort(s, axis=1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = np.inf
    s = np.sort(s, axis=1)[:, :place]
    return np.pad(s, ((0, 0), (0, place - s.shape[1])), constant_values=np.inf)


def _sparse(batches: Iterator[pa.RecordBatch], queries: Queries, centre, place: int) -> Iterator[pa.RecordBatch]:
    """For each chunk of queries the least squared distances of a block of the sparse rows, rounding added."""
    for rows in _blocks(batches):
        ids = np.array(rows.column("vec_id"))
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
        y, whole = x - centre.value, square(x)
        far = square(y)
        for chunk, names, q in queries:
            best = []
            for lo in range(0, len(names), 64):
                z, own = q[lo : lo + 64] - centre.value, square(q[lo : lo + 64])[:, None]
                mine = square(z)[:, None]
                s = mine + far - 2 * (z @ y.T)
                s = np.maximum(s, 0) + slack(s, mine, far, own, whole)
                s[(names[lo : lo + 64, None] == ids) | np.isnan(s)] = np.inf
                best.append(_place(s, place))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.concatenate(best).tobytes()], pa.binary())], ["chunk", "best"])


def _save_most(table: pa.Table, queries: Queries, place: int) -> pa.Table:
    chunk, best = table.column("chunk")[0].as_py(), None
    for raw in table.column("best"):
        s = np.frombuffer(raw.as_py(), np.float64).reshape(-1, place)
        best = s if best is None else _place(np.concatenate([best, s], axis=1), place)
    shared.save(queries.uri, f"{chunk}-most", best[:, -1])
    return pa.table({"chunk": [chunk]})


INDEX = "vec_id long, same long, codes binary, coded double, off double, vector binary"
FOUND = "query_id long, vec_id long, same long, distance double"


def _scan(batches: Iterator[pa.RecordBatch], queries: Queries, books, centre, keep: int, k: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(all="ignore"):
        for rows in _blocks(batches):
            block = Block(rows, centre.value, k)
            for chunk, names, q in queries:
                found = list(block.best(names, q, queries.most(chunk, len(names)), books.value, centre.value, keep))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def _nearest(clean: DataFrame, asked: DataFrame, dimension: int, k: int, rerank: int, sample: int) -> DataFrame:
    """nearest() of clean vectors of one length."""
    spark, weight = clean.sparkSession, anisotropy(dimension)
    # at most ``sample`` vectors come to the driver
    held = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).to_pylist()
    x = np.unique(np.array(held, np.float64), axis=0)
    x = np.pad(x, ((0, 0), (0, dimension % 2)))
    # beyond 1e100 squares aren't numbers: such vectors are coded badly and compared by distance
    x = x[np.abs(x).max(1) < 1e100] if (np.abs(x).max(1) < 1e100).any() else np.zeros_like(x[:1])
    middle = x.mean(0)
    books, centre = spark.sparkContext.broadcast(train(x - middle, weight)), spark.sparkContext.broadcast(middle)
    place, rerank = max(PLACE, k), max(rerank, k)

    def indexed(batches):
        return _index(batches, books.value, centre.value, weight, dimension)

    index = shared.written(shared.mapped(clean.withColumn("same", F.xxhash64("embedding")), indexed, INDEX), "vectors")
    store = Queries(asked, dimension)
    sparse = index.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(SPARSE)) == 0)
    sparse = shared.mapped(sparse, partial(_sparse, queries=store, centre=centre, place=place), "chunk long, best binary")
    sparse.groupBy("chunk").applyInArrow(shared.with_args(_save_most, queries=store, place=place), "chunk long").agg(F.count("*")).collect()
    found = shared.mapped(index, partial(_scan, queries=store, books=books, centre=centre, keep=rerank, k=k), FOUND)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "same").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("n") <= rerank).select("query_id", "vec_id").distinct()
    distance = F.sqrt(F.aggregate(F.zip_with("query", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    exact = best.join(clean, "vec_id").join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "vec_id", distance.alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 400, sample: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest vectors found, by Euclidean distance
    in double precision, ties by ascending id; a query's own id is no candidate.

    vectors and queries have vec_id and embedding. Vectors that are null, zero, without an id, or hold
    nulls, NaN or infinities take no part. Vectors are compared with those of their length, one length
    after another. Rows that repeat an id are candidates each; rows that repeat a whole query give its
    neighbours once. With fewer than k candidates all are returned; empty tables give no rows.
    """
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("query")).distinct()
    # a row for each length: one, as a rule
    lengths = sorted(r.n for r in clean.groupBy(F.size("embedding").alias("n")).agg(F.count("*")).join(asked.select(F.size("query").alias("n")).distinct(), "n").collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, (_nearest(clean.where(F.size("embedding") == n), asked.where(F.size("query") == n), n, k, rerank, sample) for n in lengths))


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))

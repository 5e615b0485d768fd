"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Two vectors link when their cosine is ``least`` or more. Equal vectors are one class and from then on
one row. Random hyperplanes, fixed by the number of components, give each class ``tables`` keys of
``bits`` signs. At least ``recall`` of pairs exactly at the threshold share a key, nearly all of those
well above it; bits grow with the logarithm of the rows, so unlike vectors rarely share one.

Links are counted without listing the pairs of a group:

1. Balls. Of each key one class is the pivot, the one with the least hash of its number. A class looks at
   the pivots of its keys, drops those whose signs differ too often, verifies the others by cosine and
   follows the linked one of the least hash. The followers' mean direction is a centre; those within
   half the linking angle of it are its ball, and link all with each other. What is left is a ball alone.
2. Balls that share a key meet, unless the signs of their centres differ too often. From the exact angle
   of two centres and the radii either all pairs between the balls link, or none, or their members are
   compared, in blocks.
3. A class's links are the rest of its ball, the balls that link wholly, and what the blocks have
   counted. Components are those of balls.

A key shared by very many balls is dealt out over pairs of parts. Angles that decide for whole balls have
a margin; within it members are compared, in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .jaccard_join import components
from .neighbours import usable

#: Angle that decisions for whole balls keep from the threshold.
MARGIN = 1e-6
#: Balls of a key that meet in one part; members of a ball in a block, and sets of them that ask one.
PART = 256
BLOCK = 1024
#: Standard deviations of differing signs that a pair is allowed above what its angle makes expected.
SLACK = 6.0
#: Rows of partial sums added together.
ADDED = 8192
CLASSES = "class binary, vec_id long, vector binary"


def plan(rows: int, least: float, recall: float) -> tuple[int, int]:
    """Signs a key, and tables: one key a row in expectation, and enough tables for the recall."""
    bits = min(24, max(8, (max(rows, 1) - 1).bit_length()))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def units(raw: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Rows of unit length from stored vectors; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw.to_pylist()), dtype).astype(np.float64)
    x = x.reshape(len(raw), -1) if len(raw) else x.reshape(0, 1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hyperplanes(dimension: int, tables: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([11, dimension])).standard_normal((tables * bits, dimension)).T


def signs(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The keys of each row, ``bits`` signs each, as many to a word as fit."""
    positive = (x @ _hyperplanes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    key = (positive.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)
    each = 64 // bits
    key = np.pad(key, ((0, 0), (0, -tables % each))).reshape(len(x), -1, each)
    return (key << (np.arange(each, dtype=np.uint64) * np.uint64(bits))).sum(2, dtype=np.uint64).view(np.int64)


def _column(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _described(batches: Iterator[pa.RecordBatch], dtype: str, dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("embedding").flatten(), dtype).reshape(-1, dimension) + np.dtype(dtype).type(0)  # no -0
        raw = [r.tobytes() for r in x]
        names = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column("vec_id"), pa.array(raw, pa.binary())], ["class", "vec_id", "vector"])


def _signed(batches: Iterator[pa.RecordBatch], dtype: str, tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield pa.RecordBatch.from_arrays([part.column("ball"), _lists(signs(units(part.column("vector"), dtype), tables, bits))], ["ball", "signs"])


def _cosines(batches: Iterator[pa.RecordBatch], left: str, right: str, names: tuple[str, str], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose vectors' cosine is at least so much, with it."""
    for batch in batches:
        if batch.num_rows:
            s = np.einsum("ij,ij->i", units(batch.column("vector"), left), units(batch.column("other_vector"), right))
            ok = pa.array(s >= least)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(ok) for n in names] + [pa.array(s[s >= least])], [*names, "cosine"])


def _partial_sums(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _summed(np.array(batch.column("pivot")), units(batch.column("vector"), dtype))


def _summed(pivot: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(pivot, kind="stable")
    first = np.flatnonzero(np.diff(pivot[order], prepend=pivot[order[0]] - 1))
    return pa.RecordBatch.from_arrays([pa.array(pivot[order][first]), _column(np.add.reduceat(x[order], first))], ["pivot", "sums"])


def _centres(table: pa.Table) -> pa.Table:
    """Mean directions of the pivots of one group of partial sums."""
    raw = table.column("sums").to_pylist()
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    total = _summed(np.array(table.column("pivot")), x)
    return pa.table({"pivot": total.column(0), "vector": total.column(1)})


def _open(asking: pa.Table, block: pa.Table, dtype: str, least: float) -> pa.Table:
    """Links of asking classes with the members of a block: rows (c, n, ball, other) count links of c, and name
    the asking class's ball and the block's where there are any."""
    rows: list[tuple] = []
    if len(asking) and len(block):
        q, x = units(asking.column("vector"), dtype), units(block.column("vector"), dtype)
        weight, asked = np.array(block.column("copies")), np.array(asking.column("copies"))
        held, ball = np.zeros(len(x), np.int64), block.column("ball")[0].as_py()
        names, own = asking.column("c").to_pylist(), asking.column("own").to_pylist()
        for lo in range(0, len(q), 256):
            near = q[lo : lo + 256] @ x.T >= least
            held += asked[lo : lo + 256] @ near
            for j in np.flatnonzero(near.any(1)):
                rows.append((names[lo + j], int(weight[near[j]].sum()), own[lo + j], ball))
        members = block.column("c").to_pylist()
        rows += [(members[j], int(held[j]), None, None) for j in np.flatnonzero(held)]
    return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("c", "n", "ball", "other"))})


def _differing(a: str, b: str) -> Column:
    """How many signs of two rows of keys differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _allowed(angle: Column | float, signs_in_all: int) -> Column:
    """Differing signs that two vectors at this angle have at most, but for a chance in a thousand million."""
    p = F.least(F.lit(0.5), (angle if isinstance(angle, Column) else F.lit(angle)) / math.pi)
    return p * signs_in_all + F.sqrt(p * (1 - p) * signs_in_all) * SLACK + 1


def _keys(df: DataFrame, tables: int, bits: int, *columns: str) -> DataFrame:
    """A row for each table: table, key, and these columns."""
    each = 64 // bits
    key = f"shiftrightunsigned(signs[t div {each}], cast(t % {each} * {bits} as int)) & {(1 << bits) - 1}L"
    return df.select(*columns, F.posexplode(F.expr(f"transform(sequence(0, {tables - 1}), t -> {key})")).alias("table", "key"))


def _spread(key: Column, n: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.ceil(n / size))


def _balls(classes: DataFrame, signed: DataFrame, dtype: str, least: float, tables: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Members of balls of several: c, ball, angle (from the centre); and the centres: ball, vector."""
    theta = math.acos(least)
    mine = _keys(signed.withColumnRenamed("ball", "c"), tables, bits, "c", "signs")
    pivots = mine.groupBy("table", "key").agg(F.min(F.struct(F.xxhash64("c").alias("h"), F.col("c").alias("pivot"), F.col("signs").alias("other"))).alias("p"), F.count("*").alias("n")).where("n > 1").select("table", "key", "p.*")
    pairs = mine.join(pivots, ["table", "key"]).where((F.col("c") != F.col("pivot")) & (_differing("signs", "other") <= _allowed(theta, tables * bits))).select("c", "pivot", "h").distinct()
    vector = classes.select("c", "vector")
    pairs = pairs.join(vector, "c").join(classes.select(F.col("c").alias("pivot"), F.col("vector").alias("other_vector")), "pivot")
    linked = shared.written(shared.mapped(pairs, partial(_cosines, left=dtype, right=dtype, names=("c", "pivot"), least=least), "c long, pivot long, cosine double"), "followed")
    # a pivot that others follow may follow itself
    everyone = linked.select("c", "pivot").union(linked.select(F.col("pivot").alias("c"), "pivot").distinct())
    chosen = everyone.groupBy("c").agg(F.min(F.struct(F.xxhash64("pivot").alias("h"), F.col("pivot")))["pivot"].alias("pivot"))
    followers = shared.written(chosen.join(vector, "c"), "followers")
    sums = shared.written(shared.mapped(followers.select("pivot", "vector"), partial(_partial_sums, dtype=dtype), "pivot long, sums binary"), "sums")
    groups = max(1, -(-sums.count() // ADDED))
    centres = shared.written(sums.groupBy(F.pmod(F.xxhash64("pivot"), F.lit(groups)).alias("part")).applyInArrow(shared.with_args(_centres), "pivot long, vector binary"), "centres")
    near = followers.join(centres.select("pivot", F.col("vector").alias("other_vector")), "pivot")
    inside = shared.mapped(near, partial(_cosines, left=dtype, right="f8", names=("c", "pivot"), least=math.cos(theta / 2 - MARGIN)), "c long, ball long, cosine double")
    return shared.written(inside.withColumn("angle", F.acos(F.least(F.lit(1.0), "cosine")) + MARGIN).drop("cosine"), "members"), centres.withColumnRenamed("pivot", "ball")


def _meetings(balls: DataFrame, theta: float, tables: int, bits: int, centre_signs: DataFrame, member_signs: DataFrame) -> DataFrame:
    """Pairs (ball, other) that share a key of any members, and whose centres may be near enough."""
    rows = _keys(member_signs, tables, bits, "ball").distinct()
    crowds = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART))
    rows = rows.join(crowds, ["table", "key"]).join(balls.select("ball", "radius").join(centre_signs, "ball"), "ball").withColumn("part", F.pmod(F.xxhash64("ball"), F.col("parts")))
    rows = shared.written(rows.select("table", "key", "parts", "part", "ball", "radius", "signs"), "meeting")
    last = F.col("parts") - 1
    left = rows.select("table", "key", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), last)).alias("j"), "ball", "radius", "signs")
    right = rows.select("table", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("ball").alias("other"), F.col("radius").alias("other_radius"), F.col("signs").alias("other_signs"))
    met = left.join(right, ["table", "key", "i", "j"]).where(F.when(F.col("i") == F.col("j"), F.col("ball") < F.col("other")).otherwise(F.col("ball") != F.col("other")))
    met = met.where(_differing("signs", "other_signs") <= _allowed(theta + F.col("radius") + F.col("other_radius"), tables * bits))
    return met.select(F.least("ball", "other").alias("ball"), F.greatest("ball", "other").alias("other")).distinct()


def _linked(clean: DataFrame, dimension: int, rows: int, dtype: str, least: float, recall: float) -> DataFrame:
    """class, n_links, component_id of vectors of one length."""
    theta = math.acos(least)
    bits, tables = plan(rows, least, recall)
    described = shared.mapped(clean, partial(_described, dtype=dtype, dimension=dimension), CLASSES)
    classes = described.groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    classes = shared.written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    sign = partial(_signed, dtype=dtype, tables=tables, bits=bits)
    signed = shared.written(shared.mapped(classes.select(F.col("c").alias("ball"), "vector"), sign, "ball long, signs array<long>"), "signs")
    members, centres = _balls(classes, signed, dtype, least, tables, bits)
    slim = classes.select("c", "class", "first_id", "copies")
    # a class alone has a ball of its own, numbered below zero
    homes = slim.join(members, "c", "left").select("c", "class", "first_id", "copies", F.coalesce("ball", -1 - F.col("c")).alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    homes = shared.written(homes, "homes")
    balls = shared.written(homes.groupBy("ball").agg(F.sum("copies").alias("weight"), F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("first_id").alias("first_id")), "balls")
    alone = signed.select((-1 - F.col("ball")).alias("ball"), "signs")
    central = shared.mapped(centres, partial(_signed, dtype="f8", tables=tables, bits=bits), "ball long, signs array<long>").union(alone)
    of_members = signed.join(homes.select(F.col("c").alias("ball"), F.col("ball").alias("home")), "ball").select(F.col("home").alias("ball"), "signs")
    met = shared.written(_meetings(balls, theta, tables, bits, central, of_members), "meetings")
    # centres of balls alone are stored as the vectors are, others as doubles
    vectors = centres.select("ball", "vector", F.lit(True).alias("mean")).union(classes.select((-1 - F.col("c")).alias("ball"), "vector", F.lit(False).alias("mean")))
    sided = met.join(vectors, "ball").join(vectors.select(F.col("ball").alias("other"), F.col("vector").alias("other_vector"), F.col("mean").alias("other_mean")), "other")
    sided = shared.mapped(sided, partial(_angles, dtype=dtype), "ball long, other long, cosine double")
    size = balls.select("ball", "radius", "weight", "size")
    other = balls.select(F.col("ball").alias("other"), F.col("radius").alias("other_radius"), F.col("weight").alias("other_weight"), F.col("size").alias("other_size"))
    sided = sided.join(size, "ball").join(other, "other")
    both, angle = F.col("radius") + F.col("other_radius"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))
    single = (F.col("size") == 1) & (F.col("other_size") == 1) & (both == 0)
    verdict = F.when(single, F.when(F.col("cosine") >= least, "all").otherwise("none")).when(angle + both <= theta - MARGIN, "all").when(angle - both > theta + MARGIN, "none").otherwise("some")
    sided = shared.written(sided.withColumn("verdict", verdict).where("verdict != 'none'"), "pairs")
    whole = sided.where("verdict = 'all'")
    beside = whole.select("ball", F.col("other_weight").alias("w")).union(whole.select(F.col("other").alias("ball"), F.col("weight").alias("w"))).groupBy("ball").agg(F.sum("w").alias("beside"))
    opened = shared.written(_compared(sided.where("verdict = 'some'"), homes, classes, dtype, least), "opened")
    edges = whole.select("ball", "other").union(opened.where("other is not null").select("ball", "other"))
    labels = components(edges, "ball", "other")
    named = balls.join(labels, F.col("ball") == F.col("node"), "left").select("ball", "weight", "first_id", F.coalesce("label", "ball").alias("label"))
    named = shared.written(named, "labels")
    found = named.join(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "label").join(beside, "ball", "left").select("ball", "weight", "component_id", F.coalesce("beside", F.lit(0)).alias("beside"))
    extra = opened.groupBy("c").agg(F.sum("n").alias("extra"))
    result = homes.join(found, "ball").join(extra, "c", "left")
    return result.select("class", (F.col("weight") - 1 + F.col("beside") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")


def _angles(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """The cosines of pairs of centres."""

    def directions(raw: pa.Array, mean: np.ndarray) -> np.ndarray:
        parts = [units(raw.filter(pa.array(s)), t) for s, t in ((mean, "f8"), (~mean, dtype))]
        out = np.empty((len(raw), max(p.shape[1] for p in parts)))
        for s, p in zip((mean, ~mean), parts, strict=True):
            if s.any():
                out[s] = p
        return out

    for batch in batches:
        if batch.num_rows:
            a = directions(batch.column("vector"), np.array(batch.column("mean"), bool))
            b = directions(batch.column("other_vector"), np.array(batch.column("other_mean"), bool))
            yield pa.RecordBatch.from_arrays([batch.column("ball"), batch.column("other"), pa.array(np.einsum("ij,ij->i", a, b))], ["ball", "other", "cosine"])


def _compared(pairs: DataFrame, homes: DataFrame, classes: DataFrame, dtype: str, least: float) -> DataFrame:
    """Of pairs of balls the links of members, counted: the smaller ball's members ask the blocks of the larger."""
    larger = F.col("size") >= F.col("other_size")
    pairs = pairs.select(F.when(larger, F.col("ball")).otherwise(F.col("other")).alias("held"), F.when(larger, F.col("other")).otherwise(F.col("ball")).alias("own"), F.greatest("size", "other_size").alias("blocks"))
    asks = pairs.join(homes.select("c", "copies", F.col("ball").alias("own")), "own")
    asks = shared.written(asks.select("held", "own", "c", "copies", F.ceil(F.col("blocks") / BLOCK).alias("blocks")), "asking")
    chunks = asks.groupBy("held", "blocks").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    asks = asks.join(chunks.select("held", "chunks"), "held").join(classes.select("c", "vector"), "c")
    asks = asks.select("held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("c", "own"), F.col("chunks")).alias("chunk"), "own", "c", "copies", "vector")
    members = homes.select("c", "copies", "ball").join(chunks.withColumnRenamed("held", "ball"), "ball").join(classes.select("c", "vector"), "c")
    members = members.select(F.col("ball").alias("held"), F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), *(F.col(k).alias(k) for k in ("ball", "c", "copies", "vector")))

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        return _open(left, right, dtype, least)

    keys = ("held", "block", "chunk")
    return asks.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(opened, "c long, n long, ball long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: how many other rows' vectors have a cosine of ``least`` or more
    with it (as far as found; none below), the smallest vec_id that links reach, itself included,
    and whether that is its own.

    Vectors that are null, zero, empty, or hold nulls, NaN or infinities link with nothing and are their own
    components; vectors of different lengths don't link. Equal vectors link, and rows that repeat an id
    are separate rows: each counts, and all that bear a component's id are kept. A row without an id takes
    part; its component is null where no row of it has an id. An empty table gives no rows.
    ``least`` lies above 0 and below 1.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    dtype = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if dtype == "f4" else "array<double>").alias("embedding"))
    clean = rows.where(usable(F.col("embedding")))
    # a row for each length: one, as a rule
    lengths = sorted((r.d, r.n) for r in clean.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect())
    names = [(d, _linked(clean.where(F.size("embedding") == d), d, n, dtype, least, recall)) for d, n in lengths]
    other = rows.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    parts = [other]
    for d, found in names:
        own = shared.mapped(clean.where(F.size("embedding") == d), partial(_described, dtype=dtype, dimension=d), CLASSES).select("class", "vec_id")
        parts.append(own.join(found, "class").select("vec_id", "n_links", "component_id"))
    return reduce(DataFrame.union, parts).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

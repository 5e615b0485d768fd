"""N-gram Jaccard join with a token-group matrix: links of 0.8 or more on five-word shingles.

A text's set is hashed shingles; equal sets are one class and from then on one row. Exactness rests
on three facts: only shingles that another class has can count towards an overlap; a set needs 80 %
of its own shingles in common to link; and two sets that link share one of the rarest
s - ceil(0.8 n) + 1 of their s shared shingles, in any order common to all sets (the prefix).

1. Document frequencies of all shingles, kept as sorted arrays in the shared folder where above one.
2. Each text looks up its shingles; where fewer than 80 % are shared, it can link with nothing.
3. Similar sets form groups: each set is compared with the richest set of the groups that its least
   hashes name; verified links make linked groups. Blocks of about 64 sets are cut from each large one,
   and from the sets of small ones that have the same least hash.
4. The token-group matrix has a row for each prefix shingle and block, with the linked groups that
   its sets belong to and their sizes. Two blocks meet only where a shingle has sets of different linked
   groups in them, of sizes that may link: a set of n shingles, s of them shared, has at most s in common
   with another, so it can only link with sets of at most 2.25 s - n shingles. Blocks hold sets of nearly
   one size, so texts that a common line, a licence, makes alike, but not alike enough, don't meet;
   where a shingle has many blocks, these are joined by their sizes too.
   A set of one opens the other where its union of shingles may hold 80 % of the set, and then
   counts its overlap with every member at once.
5. Connected components by alternating large and small stars.

Blocks of one linked group never meet, so a group of m copies with slight differences costs m
comparisons, and its stragglers an opening for each block and not one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Sorted
from .text import U64, mix, words

BLOCK = 64
#: Sizes that share a block differ by less than this factor.
BAND = 1.02
#: Blocks of a shingle from which on they are joined by size too.
HOT = 32
#: Sets that meet one copy of a block.
CHUNK = 128
SETS = "doc_id long, n_shingles long, set_id binary, tokens binary, frequencies binary"
_K = U64(0x9FB21C651E98DF25)


def sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number in the batch and its sorted distinct shingle hashes."""
    for i, _, n, h in words(column):
        total = np.concatenate([[0], np.cumsum(n)])
        s = np.zeros(max(len(h) - size + 1, 0), U64)
        for k in range(size):
            s *= _K
            s += h[k : k + len(s)]
        s = mix(s)
        for k, (a, m) in enumerate(zip(total[:-1], n, strict=True)):
            if m >= size:
                yield i + k, shared.distinct(s[a : a + m - size + 1])[0]
            elif m:
                x = U64(m)
                with np.errstate(over="ignore"):
                    for w in h[a : a + m]:
                        x = x * _K + w
                    yield i + k, mix(np.array([x ^ _K]))
            else:
                yield i + k, np.zeros(0, U64)


def _shingles(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for _, s in sets(batch.column("text"), size):
        held.append(s)
        if len(held) >= 512:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _keep_shared(table: pa.Table, store: Sorted) -> pa.Table:
    b, k, n = shared.merge(table)
    several = n > 1
    store.write(b, k[several], n[several].astype(np.uint32))
    return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(k)])})


def _describe(batches: Iterator[pa.RecordBatch], store: Sorted, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    def made(ids: list, group: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(group)
        keys, back = np.unique(every, return_inverse=True)
        df = store.find(keys, 0)[1][back]
        at, rows = 0, []
        for doc, s in zip(ids, group, strict=True):
            d = df[at : at + len(s)]
            at += len(s)
            several = d > 1
            if not len(s):
                rows.append((doc, 0, None, None, None))
                continue
            name = mix(s ^ _K).sum().tobytes() + mix(s + _K).sum().tobytes()
            linked = 100 * int(several.sum()) >= percent * len(s)
            rows.append((doc, len(s), name, shared.pack_keys(s[several]) if linked else None, shared.pack(d[several].astype(np.uint32)) if linked else None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SETS.split(", ")])

    for batch in batches:
        names, ids, group, held = batch.column("doc_id").to_pylist(), [], [], 0
        for k, s in sets(batch.column("text"), size):
            ids.append(names[k])
            group.append(s)
            held += len(s)
            if held >= 1 << 19:
                yield made(ids, group)
                ids, group, held = [], [], 0
        if ids:
            yield made(ids, group)


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _prepare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each class the shingles that other classes have, the sizes of sets that it may link with, its
    prefix, and the groups it may join."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            k, d = shared.unpack_keys(r["tokens"]), shared.unpack(r["frequencies"], np.uint32).astype(np.int64)
            other = d > r["copies"]
            k, d = k[other], d[other]
            if len(k) < _need(r["n_shingles"], percent):
                continue
            prefix = k[np.lexsort((k, d))][: len(k) - _need(r["n_shingles"], percent) + 1]
            groups = [int(mix(k ^ U64(x)).min().view(np.int64)) for x in (1, 2, 3)]
            n = r["n_shingles"]
            rows.append((r["set_id"], n, _need(n, percent), (100 + percent) * len(k) // percent - n, float(d.sum() / n), shared.pack_keys(k), prefix.view(np.int64).tolist(), groups))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["set_id", "n", "fewest", "most", "richness", "tokens", "prefix", "groups"])


def _linked(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            a, b = shared.unpack_keys(r["tokens"]), shared.unpack_keys(r["p_tokens"])
            if _linked(len(np.intersect1d(a, b, assume_unique=True)), r["n"], r["p_n"], percent):
                rows.append((r["set_id"], r["pivot"]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.binary()) for k in (0, 1)], ["a", "b"])


def _open(asking: pa.Table, block: pa.Table, percent: int) -> pa.Table:
    """The links between the asking sets and the members of one block."""
    found: list[tuple[bytes, bytes]] = []
    if len(asking) and len(block):
        members, sizes = block.column("set_id").to_pylist(), np.array(block.column("n"))
        held = [shared.unpack_keys(x.as_buffer()) for x in block.column("tokens")]
        union, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
        order = np.argsort(union, kind="stable")
        union, owner = union[order], owner[order]
        for q, n, raw in zip(asking.column("q").to_pylist(), asking.column("q_n").to_pylist(), asking.column("q_tokens"), strict=True):
            k = shared.unpack_keys(raw.as_buffer())
            lo, hi = np.searchsorted(union, k), np.searchsorted(union, k, "right")
            some = hi > lo
            if 100 * int(some.sum()) < percent * n:
                continue
            lo, m = lo[some], (hi - lo)[some]
            at = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            overlap = np.bincount(owner[at], minlength=len(members))
            found += [(q, members[j]) for j in np.flatnonzero(100 * overlap >= percent * (n + sizes - overlap))]
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node on an edge: the least node that it reaches. Large and small stars in
    turn, each round a written table, until nothing changes."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = shared.written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = shared.written(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _spread(key: Column, n: Column, size: int) -> Column:
    """A number below ceil(n / size), even over the keys."""
    return F.pmod(F.xxhash64(key), F.ceil(n / size))


def _band(n: Column) -> Column:
    """The number of a size's band; sizes up to 50 have one each."""
    return F.floor(F.log(n) / F.log(F.lit(BAND)) + 1e-9)


def links(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough links between classes to connect all that are connected."""
    pair = partial(_verify, percent=percent)
    groups = classes.select("set_id", "richness", F.explode("groups").alias("group"))
    pivots = groups.groupBy("group").agg(F.max(F.struct("richness", "set_id"))["set_id"].alias("pivot"))
    pairs = groups.join(pivots, "group").where("set_id != pivot").select("set_id", "pivot").distinct()
    slim = classes.select("set_id", "n", "tokens")
    pairs = pairs.join(slim, "set_id").join(slim.select(F.col("set_id").alias("pivot"), F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens")), "pivot")
    first = shared.written(shared.mapped(pairs, pair, "a binary, b binary"), "links")
    labels = components(first)
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    named = classes.select("set_id", "prefix", "n", "fewest", "most", F.col("groups")[0].cast("string").cast("binary").alias("group")).join(sized, F.col("set_id") == F.col("node"), "left")
    named = named.withColumn("home", F.struct(F.when(F.col("size") >= BLOCK // 2, F.col("label")).otherwise(F.col("group")).alias("name"), _band(F.col("n")).alias("band")))
    homes = named.groupBy("home").agg(F.count("*").alias("members"))
    named = named.join(homes, "home").select("set_id", "prefix", "n", "fewest", "most", F.coalesce("label", "set_id").alias("label"), F.struct("home", _spread(F.col("set_id"), F.col("members"), BLOCK).alias("part")).alias("block"))
    named = shared.written(named, "blocks")
    matrix = named.select("block", "label", "n", "fewest", "most", F.explode("prefix").alias("token")).groupBy("token", "block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("fewest").alias("fewest"), F.max("most").alias("most"))
    several = matrix.groupBy("token").agg(F.min("low").alias("least_label"), F.max("high").alias("most_label"), F.count("*").alias("blocks")).where("least_label != most_label").select("token", "blocks")
    matrix = shared.written(matrix.join(several, "token"), "matrix")
    other = matrix.select(F.col("token"), F.col("blocks"), *(F.col(c).alias(f"other_{c}") for c in ("block", "low", "high", "n_least", "n_most", "fewest", "most")))
    # two blocks meet where a shingle has sets of different groups in them, of sizes that may link
    may = F.expr("block <= other_block and (low != high or other_low != other_high or low != other_low) and (block != other_block or low != high)"
                 " and n_least <= other_most and other_n_least <= most and n_most >= other_fewest and other_n_most >= fewest")
    few = matrix.where(F.col("blocks") <= HOT).join(other.where(F.col("blocks") <= HOT), "token").where(may).select("block", "other_block")
    bands = F.explode(F.sequence(_band(F.col("fewest")), F.greatest(_band(F.col("fewest")), _band(F.col("most"))))).alias("band")
    hot = matrix.where(F.col("blocks") > HOT).select("*", bands).join(other.where(F.col("blocks") > HOT).withColumn("band", F.col("other_block.home.band")), ["token", "band"]).where(may).select("block", "other_block")
    meet = few.union(hot).distinct()
    meet = meet.join(named.select("block", F.col("set_id").alias("q")), "block").select("q", F.col("other_block").alias("block"))
    meet = shared.written(meet, "meet")
    chunks = meet.groupBy("block").agg(F.count("*").alias("asked"))
    meet = meet.join(chunks, "block").withColumn("chunk", _spread(F.col("q"), F.col("asked"), CHUNK))
    meet = meet.join(slim.select(F.col("set_id").alias("q"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens")), "q").select("block", "chunk", "q", "q_n", "q_tokens")
    members = named.select("set_id", "block").join(chunks, "block").select("set_id", "block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("asked") / CHUNK) - 1)).alias("chunk")).join(slim, "set_id").select("block", "chunk", "set_id", "n", "tokens")

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        return _open(left, right, percent)

    second = meet.groupBy("block", "chunk").cogroup(members.groupBy("block", "chunk")).applyInArrow(opened, "a binary, b binary")
    # what the first round has found counts as one link from each set to its group's label
    return second.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles and component_id, the smallest doc_id that
    its links reach, itself included.

    Words are runs of bytes other than ASCII white space, A-Z as a-z. A text of fewer than ``size``
    words has one shingle, all of it; a null text or one without words has none, links with nothing
    and is its own component. Equal sets link. A row without an id takes part, but its id is nobody's
    component unless the component has no other, and then it is null. Rows that repeat an id are
    separate rows with the same id. An empty table gives no rows.
    """
    spark, texts = documents.sparkSession, documents.select("doc_id", "text")
    store = Sorted(shared.folder(spark, "shingles"), shared.bits(texts), ("counts",))
    counted = shared.mapped(texts, partial(shared.counted, hashes=partial(_shingles, size=size), bucket_bits=store.bits), shared.PACKED)
    counted.groupBy("bucket").applyInArrow(shared.with_args(_keep_shared, store=store), "bucket int, n long").agg(F.sum("n")).collect()
    described = shared.written(shared.mapped(texts, partial(_describe, store=store, size=size, percent=percent), SETS), "sets")
    slim = described.select("doc_id", "n_shingles", "set_id")
    classes = slim.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    # one row of each class: the one with the least id
    known = described.where("tokens is not null").select("set_id", "n_shingles", "tokens", "frequencies", F.col("doc_id").alias("first_id"))
    known = known.join(classes, (known.set_id == classes.set_id) & known.first_id.eqNullSafe(classes.first_id)).select(known.set_id, "n_shingles", "tokens", "frequencies", "copies").dropDuplicates(["set_id"])
    prepared = shared.written(shared.mapped(known, partial(_prepare, percent=percent), "set_id binary, n long, fewest long, most long, richness double, tokens binary, prefix array<long>, groups array<long>"), "classes")
    labels = components(links(prepared, percent))
    joined = classes.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "first_id", F.coalesce("label", "set_id").alias("label"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_set = shared.written(joined.join(least, "label").select("set_id", "component_id"), "components")
    return slim.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each component of linked rows: of the least id (rows without one come last), of equal
    ids any one. Ids take no part in linking, so rows that share an id are judged each by its own text.
    Rows without words link with nothing and all stay. Whatever columns documents have, they stay."""
    spark, uri = documents.sparkSession, shared.folder(documents.sparkSession, "keyed")
    row = shared.unused("row", documents)
    # the keys hold once they are written; computed anew, they could go to other rows
    keyed = documents.withColumn(row, F.monotonically_increasing_id())
    keyed.write.option("compression", "zstd").parquet(uri)
    keyed = spark.read.schema(keyed.schema).parquet(uri)
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)
    kept = keyed.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return keyed.join(kept.select(row), row, "left_semi").select(documents.columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

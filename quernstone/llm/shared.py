"""Sorted hash arrays in the folder that the whole cluster shares.

Several operators need to know, for each of very many 64-bit hashes, how often it occurs in the
corpus. The map side sorts and counts the hashes of a batch, cuts them into buckets by their leading
bits and sends one compact row a bucket; the reduce side merges a bucket and writes it as a sorted
array. Later tasks map these files into memory and look up sorted queries, so that nothing whole
passes the driver, no task holds more than one bucket, and a key that fills a third of the corpus
costs one entry a task.
"""

from __future__ import annotations

import atexit
import ctypes
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Entries that a map task gathers before it sends them.
HELD = 1 << 20
PACKED = "bucket int, keys binary, counts binary"
#: Bytes of text whose hashes share a bucket, about.
BUCKET = 16 << 20
MOST_BITS = 18
#: Bytes of an Arrow batch, unless the session asks for other than Spark's default of 64 MB.
BATCH = 4 << 20
#: Bytes of arrays that a worker holds where they can't be mapped.
HELD_BYTES = 128 << 20
#: Arrays that a store keeps mapped in a worker; the system allows some 65,000 maps a process.
MAPPED = 8192
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, removed when the driver ends. Where that is unset, a
    single machine takes a temporary folder, as in tests; a cluster has to name one that all share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    uri = f"{base if '://' in base or base.startswith('file:') else f'file://{base}'}/{name}-{uuid.uuid4().hex}"
    if local(uri):
        atexit.register(shutil.rmtree, local(uri), ignore_errors=True)
    return uri


def local(uri: str) -> str | None:
    """The path of a URI in a mounted folder, else None."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    uri = folder(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def save(uri: str, name: str, array: np.ndarray) -> None:
    """Writes an array under the URI; a repeated or doubled task replaces the file by the same."""
    if path := local(uri):
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}/{name}.npy")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}.npy") as f:
            np.lib.format.write_array(pa.PythonFile(f, "w"), array)


def load(uri: str, name: str) -> np.ndarray:
    """Maps an array that save() wrote; from a store without a mount it is read into memory."""
    if path := local(uri):
        return _mapped(f"{path}/{name}.npy")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{path}/{name}.npy") as f:
        return np.lib.format.read_array(pa.PythonFile(f, "r"))


def _mapped(path: str) -> np.ndarray:
    """A mapped array that keeps no file open."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if 0 in shape:
            return np.empty(shape, dtype)
        untracked = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **untracked)
        return np.frombuffer(raw, dtype, offset=f.tell(), count=int(np.prod(shape))).reshape(shape, order="F" if fortran else "C")


class Held:
    """Groups of loaded arrays by key, the latest used ones: MAPPED arrays at most where they are mapped, else
    HELD_BYTES of them (one group is held in any case). A worker's own: it isn't sent with its owner."""

    def __init__(self) -> None:
        self._groups: dict[int, tuple] = {}
        self._arrays = self._bytes = 0

    def __getstate__(self) -> dict:
        return {"_groups": {}, "_arrays": 0, "_bytes": 0}

    def get(self, key: int, uri: str, names: list[str]) -> tuple:
        """The arrays of these names, or () where the first has no file."""
        if (have := self._groups.pop(key, None)) is None:
            try:
                have = tuple(load(uri, name) for name in names)
            except FileNotFoundError:
                have = ()
            self._arrays += len(have)
            self._bytes += 0 if local(uri) else sum(x.nbytes for x in have)
            while self._groups and (self._arrays > MAPPED or self._bytes > HELD_BYTES):
                gone = self._groups.pop(next(iter(self._groups)))
                self._arrays -= len(gone)
                self._bytes -= 0 if local(uri) else sum(x.nbytes for x in gone)
        self._groups[key] = have
        return have


def bits(texts: DataFrame, column: str = "text") -> int:
    """Leading bits that name a bucket: enough for one bucket each BUCKET bytes of a text column, which
    are measured, and for two buckets each shuffle partition; 18 at most."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = max(size // BUCKET, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_BITS, max(6, (least - 1).bit_length()))


def release() -> None:
    """Gives memory that a task no longer needs back to the system, as the worker waits for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _released(batches: Iterator[pa.RecordBatch], f: Callable) -> Iterator[pa.RecordBatch]:
    try:
        yield from f(batches)
    finally:
        release()


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of bounded bytes, after which a worker gives its memory back."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in ("67108864b", "64MB"):
        conf.set(_BATCH, f"{BATCH}b")
    return df.mapInArrow(partial(_released, f=f), schema)


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts (int64)."""
    if counts is None:
        k = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        k, counts = keys[order], counts[order]
    first = np.empty(len(k), bool)
    first[:1] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    at = np.flatnonzero(first)
    if counts is None:
        n = np.diff(np.append(at, len(k)))
    else:
        n = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
    return k[at], n


def pack(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression finds the equal ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_keys(k: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return pack(np.diff(k, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U64), dtype=U64)


def least(counts: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


def narrow(counts: np.ndarray) -> bytes:
    """Counts with a leading byte that names their width."""
    size = 1 if not len(counts) or counts.max() < 256 else 4 if counts.max() < 1 << 32 else 8
    return bytes([size]) + pack(counts.astype(f"u{size}"))


def widen(raw: bytes) -> np.ndarray:
    return unpack(raw[1:], np.dtype(f"u{raw[0]}")).astype(np.int64)


def cut(keys: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys that hold any."""
    if not len(keys):
        return
    bucket = (keys >> U64(64 - bucket_bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(at, [*at[1:], len(keys)], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def counted(batches: Iterator[pa.RecordBatch], hashes: Callable[[pa.RecordBatch], Iterator], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Map side: hashes(batch) yields arrays of keys, or pairs of keys and counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return distinct(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    for batch in batches:
        for x in hashes(batch):
            k, n = distinct(*x) if isinstance(x, tuple) else distinct(x)
            held.append((k, n.astype(np.int32) if not len(n) or n.max() < 1 << 31 else n))
            fresh += len(k)
            if fresh >= HELD:
                k, n = merged()
                fresh = len(k) if len(k) < HELD // 2 else 0
                held = [(k, n)] if fresh else []
                if not fresh:
                    yield rows(k, n, bucket_bits)
    if held:
        yield rows(*merged(), bucket_bits)


def rows(k: np.ndarray, n: np.ndarray, bucket_bits: int) -> pa.RecordBatch:
    made = [(b, pack_keys(k[s]), narrow(n[s])) for b, s in cut(k, bucket_bits)]
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.binary())], ["bucket", "keys", "counts"])


def merge(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Reduce side: one bucket's rows as sorted keys and summed counts."""
    keys = [unpack_keys(x.as_buffer()) for x in table.column("keys")]
    counts = [widen(bytes(x.as_buffer())) for x in table.column("counts")]
    return table.column("bucket")[0].as_py(), *distinct(np.concatenate(keys), np.concatenate(counts))


class Sorted:
    """Sorted keys in buckets, with parallel arrays of values, written by tasks and mapped by others.

    spare: how many low bits of the keys are always zero. Keys are stored without these and without the bits that name their
    bucket: in 32 bits where that does, and up to SUB bits more go to a table of where each part of the bucket begins.
    """

    SUB = 12

    def __init__(self, uri: str, bucket_bits: int, values: tuple[str, ...] = (), spare: int = 0):
        self.uri, self.bits, self.values, self.spare = uri, bucket_bits, values, spare
        self._held = Held()

    @property
    def sub(self) -> int:
        """Bits of a key beyond 32 that the table takes; -1: keys are stored whole."""
        more = max(0, 64 - self.bits - self.spare - 32)
        return more if more <= self.SUB else -1

    def _rest(self, keys: np.ndarray) -> np.ndarray:
        return (keys << U64(self.bits)) >> U64(self.bits + self.spare)

    def write(self, bucket: int, keys: np.ndarray, *values: np.ndarray) -> None:
        arrays = dict(zip(self.values, values, strict=True))
        if self.sub < 0:
            arrays["keys"] = keys
        else:
            rest = self._rest(keys)
            arrays["keys"] = rest.astype(np.uint32)
            arrays["parts"] = np.searchsorted(rest >> U64(32), np.arange((1 << self.sub) + 1, dtype=U64))
        for name, x in arrays.items():
            save(self.uri, f"{bucket}-{name}", x)

    def _arrays(self, b: int) -> tuple:
        return self._held.get(b, self.uri, [f"{b}-{name}" for name in ("keys", *self.values, *(["parts"] if self.sub >= 0 else []))])

    def bucket(self, b: int) -> tuple:
        """The arrays of a bucket, keys as they are stored; () where no key has these leading bits."""
        return self._arrays(b)[: 1 + len(self.values)]

    def places(self, b: int, keys: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        """The arrays of a bucket, where in them sorted keys of the bucket are, and which of them are there."""
        have = self._arrays(b)
        if not have or not len(have[0]):
            return (), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if self.sub < 0:
            at = np.minimum(np.searchsorted(have[0], keys), len(have[0]) - 1)
            return have, at, have[0][at] == keys
        rest = self._rest(keys)
        low, at, end = rest.astype(np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for part, s in cut(rest << U64(32 - self.sub), self.sub) if self.sub else [(0, slice(0, len(keys)))]:
            first, stop = int(have[-1][part]), int(have[-1][part + 1])
            at[s], end[s] = first + np.searchsorted(have[0][first:stop], low[s]), stop
        ok = at < end
        at = np.minimum(at, len(have[0]) - 1)
        return have, at, ok & (have[0][at] == low)

    def keys(self, b: int) -> np.ndarray:
        """The whole keys of a bucket."""
        have = self._arrays(b)
        if not have or self.sub < 0:
            return np.array(have[0]) if have else np.zeros(0, U64)
        high = np.repeat(np.arange(1 << self.sub, dtype=U64), np.diff(have[-1]))
        return (U64(b) << U64(64 - self.bits)) | (((high << U64(32)) | have[0].astype(U64)) << U64(self.spare))

    def find(self, keys: np.ndarray, *missing: int | float) -> list[np.ndarray]:
        """For sorted distinct keys: whether each is held, then each array of values (missing where not)."""
        held = np.zeros(len(keys), bool)
        out = [np.full(len(keys), m, np.float64 if isinstance(m, float) else np.int64) for m in missing]
        for b, s in cut(keys, self.bits):
            have, at, ok = self.places(b, keys[s])
            if not have:
                continue
            held[s] = ok
            for o, v in zip(out, have[1 : 1 + len(self.values)], strict=False):
                o[s] = np.where(ok, v[at], o[s])
        return [held, *out]


def with_args(f: Callable, *args, **named) -> Callable[[pa.Table], pa.Table]:
    """f with the later arguments given, as a plain function (applyInArrow inspects its signature)."""

    def g(table):
        try:
            return f(table, *args, **named)
        finally:
            release()

    return g

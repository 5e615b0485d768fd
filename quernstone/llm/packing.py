"""Best-fit packing: bounded-space online best-fit of token sequences.

Documents are tokenised where they are read. Longer ones are cut into full pieces with the shorter
piece first. What is packed is one small row a piece; the pieces are dealt out evenly, some hundred
thousand to a task, and each task packs its own with a fixed number of open bins, held in a bitset
keyed by free space: the best fit is the lowest set bit at or above the piece's length, and where a
bin more would be open than may be, the fullest closes first. Pieces arrive in windows, the longest
first, so that the short ones fill what the long ones leave.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import shared
from .tokens import encoder

OPEN_BINS = 16_384
WINDOW = 16_384
#: Pieces that one task packs.
TASK = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BestFit:
    """A bounded number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        self.count -= 1
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin that gets the piece, and the offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.made
            self.made += 1
        if rest := free - length:
            self.bins[rest].append(bin_id)
            self.bits |= 1 << rest
            self.count += 1
        return bin_id, self.capacity - free


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, before them what is over."""
    over = n % capacity if n > capacity else n
    starts = ([0] if over else []) + list(range(over, n, capacity))
    return [(s, (starts[k + 1] if k + 1 < len(starts) else n) - s) for k, s in enumerate(starts)]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]

    def made(rows: list, held: list) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
        if with_ids:
            columns.append(pa.array(held, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    for batch in batches:
        rows, held = [], []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).column(batch.column("text")), strict=True):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                piece = ids[s : s + n]
                rows.append((doc, k, s, n, zlib.crc32(piece.tobytes())))
                if with_ids:
                    held.append(piece)
            if len(held) >= 256:
                yield made(rows, held)
                rows, held = [], []
        if rows:
            yield made(rows, held)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 40
    packer, held, n = BestFit(capacity, open_bins), [], 0

    def placed() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        length = np.array(table.column("length"))
        spots = np.zeros((len(length), 2), np.int64)
        for k in np.argsort(-length, kind="stable").tolist():
            spots[k] = packer.place(int(length[k]))
        yield from table.append_column("sequence_id", pa.array(spots[:, 0] + first)).append_column("offset", pa.array(spots[:, 1])).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WINDOW:
            yield from placed()
            held, n = [], 0
    if n:
        yield from placed()


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end: int = 0, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end token alone. Rows that repeat an id are packed separately, a null
    id stays null, other columns are ignored. An empty table gives no rows.
    """
    cut = partial(_pieces, tokenizer=tokenizer or default_tokenizer(), capacity=capacity, end=end, with_ids=with_ids)
    pieces = shared.written(shared.mapped(documents.select("doc_id", "text"), cut, PIECES + ", ids array<long>" * with_ids), "pieces")
    tasks = max(1, round(pieces.count() / TASK))
    # a task that runs again packs its rows in the same order
    dealt = pieces.repartition(tasks).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return shared.mapped(dealt, partial(_pack, capacity=capacity, open_bins=open_bins), PLACED.replace("ids_crc32 long", "ids_crc32 long, ids array<long>") if with_ids else PLACED)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

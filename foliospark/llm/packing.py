"""Best-fit packing of token sequences into sequences of a fixed length.

Bounded-space online best-fit: each task packs the pieces it meets, in order, into at most ``open_bins`` open bins. A
bitset keyed by free space has a bit for each free length that an open bin has; the lowest set bit at or above the piece's
length is the best fit, and when too many bins are open the fullest one closes. Texts are never shuffled. What is still
open when a task ends is packed once more, longest piece first, by fewer tasks: only lengths and ids move there."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import vocabulary, written
from foliospark.llm.tokens import encoder

#: Pieces of open bins that a task of the second round packs.
REPACKED_PER_TASK = 200_000
OPEN_BINS = 512


class BestFit:
    """Open bins by free space. ``place`` gives the bin and the offset in it; ``closed`` gets each bin that closes."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.n_open, self.next_bin = capacity, open_bins, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} in bins of {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self.by_free[free]
            at = own.pop()
            if not own:
                self.bits ^= 1 << free
            self.n_open -= 1
        else:
            free, at = self.capacity, self.next_bin
            self.next_bin += 1
        rest = free - length
        if rest:
            if self.n_open == self.most:
                self._close_fullest()
            self.by_free[rest].append(at)
            self.bits |= 1 << rest
            self.n_open += 1
        return at, self.capacity - free

    def _close_fullest(self) -> None:
        least = (self.bits & -self.bits).bit_length() - 1
        self.by_free[least].pop(0)
        if not self.by_free[least]:
            self.bits ^= 1 << least
        self.n_open -= 1

    def still_open(self) -> set[int]:
        return {b for own in self.by_free for b in own}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = 4096, *, open_bins: int = OPEN_BINS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of each document: doc_id, piece (from 0), start (its document's ids before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), sequence_id and offset there. Only a document of more
    than ``capacity`` ids is cut. A null text is an empty one and still has ``end_id``; with ``end_id`` None an empty
    document has no row. Equal rows are documents of their own; a null id stays null; other columns are not read."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary(tokenizer))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, bins = encoder(sent.value), BestFit(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        waiting: dict[int, list[tuple]] = {}  # pieces of bins that are open
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

        def batch_of(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [is_open] * len(rows)], kinds)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    at, offset = bins.place(len(part) // 4)
                    waiting.setdefault(at, []).append((doc_id, piece, a // 4, len(part) // 4, zlib.crc32(part), first + at, offset))
            still = bins.still_open()
            for at in [b for b in waiting if b not in still]:
                out += waiting.pop(at)
            yield batch_of(out, False)
        yield batch_of([r for own in waiting.values() for r in own], True)

    pieces = written(rows.mapInArrow(pack, PIECE + ", open boolean"), "pieces")
    left = pieces.filter("open").drop("open")
    tasks = max(1, -(-left.count() // REPACKED_PER_TASK))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, REPACKED_PER_TASK)
        first = TaskContext.get().partitionId() << 40 | 1 << 39
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            columns = batch.columns[:5] + [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECE.split(", ")])

    repacked = left.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(again, PIECE)
    return pieces.filter("not open").drop("open").unionByName(repacked)

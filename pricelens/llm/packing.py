"""Best-fit packing of token pieces into fixed-length sequences.

Method: bounded-space online best-fit. Open bins are filed by their free space,
and one integer serves as a bitset of the free spaces that occur: the lowest set bit at
or above a piece's length is the best fit. If none fits, a new bin opens; if
that makes more than ``OPEN_BINS``, the fullest closes first.

Tokenizing is a map over the documents that leaves only piece records (no
ids); those are dealt by document over tasks, and each task packs what it gets,
in stretches of ``OPEN_BINS`` pieces in a pseudo-random but fixed order, each
stretch by falling length. So a retried task gives the same sequences, and its
memory is one stretch and the open bins.

Defined results: null and empty texts are one piece that holds only the end id; a
document of more than ``length`` ids is cut so that its first piece may be
shorter and all others are full; repeated rows are packed as often as they
occur; a null doc_id stays null; no documents, no rows. Only doc_id and text
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_docs
from .scan import slices
from .tokens import SLICE, default_path, encoder, token_ids

LENGTH, END_ID = 1024, 2
OPEN_BINS = 8192
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, length: int) -> list[int]:
    """Cuts of n ids: full pieces from the end, a shorter one first if need be."""
    return [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]


def _pieces(path: str, end: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("text"), path, end), strict=True):
                cuts = piece_bounds(len(ids), length)
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, x in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b]), ids[a:b] if with_ids else None), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(rows, types, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        encoder(path).forget()
    return run


def cut_documents(docs: DataFrame, path: str | None = None, end: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id in pieces of at most ``length``."""
    return text_docs(docs).mapInArrow(_pieces(path or default_path(), end, length, with_ids), PIECE + (", ids array<int>" if with_ids else ""))


class Bins:
    """Open bins filed by free space."""

    def __init__(self, length: int, most: int, first: int):
        self.length, self.most, self.next = length, most, first
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.spaces, self.open = 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.spaces &= ~(1 << free)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of this size."""
        fitting = self.spaces >> size
        if fitting:
            free = size + ((fitting & -fitting).bit_length() - 1)
            found = self._take(free)
            self.open -= 1
        else:
            free, found, self.next = self.length, self.next, self.next + 1
        left = free - size
        if left:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.open -= 1
            self.by_free[left].append(found)
            self.spaces |= 1 << left
            self.open += 1
        return found, self.length - free


def _packer(length: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = Bins(length, open_bins, TaskContext.get().partitionId() << 40)
        waiting: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            order = np.argsort(-table.column("length").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            places = [bins.place(n) for n in table.column("length").to_pylist()]
            sequence, offset = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*table.schema.names, "sequence_id", "offset"])

        for batch in batches:
            for k in range(0, batch.num_rows, open_bins):
                part = batch.slice(k, open_bins)
                if waiting and sum(b.num_rows for b in waiting) + part.num_rows > open_bins:
                    yield packed()
                    waiting.clear()
                waiting.append(part)
        if waiting:
            yield packed()
    return run


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    names = pieces.columns
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return (pieces.repartition(F.xxhash64("doc_id")).sortWithinPartitions(*order)
            .mapInArrow(_packer(length, open_bins), schema).select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place; with_ids adds the ids themselves."""
    return pack(cut_documents(docs, path, with_ids=with_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, from pieces packed with_ids. A sequence is bounded by its length."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))

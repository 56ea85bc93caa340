"""Token ids of a corpus as binary segments with Elias-Fano encoded document boundaries.

Format. A file is a Parquet file of segments (so that any store Spark writes to will do and a
retried task leaves no half file); one row is one segment of consecutive documents:

  file, segment   place in ascending doc_id order
  file_start      ids of the file before the segment
  n_docs, n_ids   counts
  doc_ids         the documents' ids, little-endian signed 64-bit
  ids             concatenated token ids, little-endian, of ``width`` bytes (2 if the vocabulary allows, else 4)
  low, high, samples   the boundaries

Boundaries are the n_docs + 1 running counts 0 = b_0 <= b_1 <= ... = n_ids. With l = floor(log2(n_ids / n_docs))
the l low bits of each are packed in ``low``; ``high`` has a one at bit (b_i >> l) + i. ``samples`` is the select
structure: the place of every 256th one. select(i) starts at the sample, counts ones by the byte to the i-th and
returns ((place - i) << l) | low_i, so an offset needs no table of 64-bit numbers: about 2 + l bits a document.

Defined results: null and empty texts hold only the end id; equal doc_ids stand beside each other, by text; null doc_ids
come last and are written as the least 64-bit number; no documents, no segments. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored, text_docs
from .scan import slices
from .tokens import IDS, SLICE, default_path, encoder, token_ids

END_ID = 0
#: A segment closes after this many ids (with the document that reaches it).
SEGMENT_IDS = 1 << 20
SAMPLE = 256
NO_ID = -(1 << 63)
SEGMENT = "file_start long, n_docs int, n_ids long, width int, doc_ids binary, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A rising sequence of counts in near-minimal space."""

    def __init__(self, size: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.size, self.low_bits = size, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a >> 3:(b + 7) >> 3].tobytes(), "little")
        return (word >> (a & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample."""
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left = rest + int(self.high[byte] & ((1 << (at & 7)) - 1)).bit_count()  # ones of this byte before the sample count too
        while left >= (ones := int(self.high[byte]).bit_count()):
            left, byte = left - ones, byte + 1
        bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All values in one pass."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.size]
        low = np.unpackbits(self.low, bitorder="little")[:self.size * self.low_bits].reshape(self.size, self.low_bits).astype(np.int64)
        return ((places - np.arange(self.size)) << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)


def _segment(before: int, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> pa.RecordBatch:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    ef = EliasFano.of(bounds)
    docs = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    body = np.concatenate(ids).astype(f"<u{width}").tobytes()
    row = [before, len(ids), int(bounds[-1]), width, docs, body, ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes()]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)


def _write(path: str, end: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
        docs: list = []
        held: list[np.ndarray] = []
        size = before = 0
        for batch in slices(batches, size=SLICE):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("text"), path, end), strict=True):
                docs.append(doc)
                held.append(ids.astype(f"<u{width}"))
                size += len(ids)
                if size >= segment_ids:
                    yield _segment(before, docs, held, width)
                    docs, held, size, before = [], [], 0, before + size
        encoder(path).forget()
        if docs:
            yield _segment(before, docs, held, width)
    return run


def write_segments(docs: DataFrame, path: str | None = None, end: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the segments of all documents in ascending doc_id order; returns the table read back."""
    path = path or default_path()
    ordered = text_docs(docs).repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    rows = ordered.mapInArrow(_write(path, end, segment_ids), SEGMENT)
    return stored(rows.select(F.spark_partition_id().alias("file"), (F.monotonically_increasing_id() % (1 << 33)).alias("segment"), "*"), "token-segments")


def with_starts(segments: DataFrame) -> DataFrame:
    """``segments`` with first_start: ids before each. Only the sums by file travel: a row for each task that wrote."""
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return segments.join(F.broadcast(before), "file").withColumn("first_start", F.col("before") + F.col("file_start")).drop("before")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ef = EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])
            bounds = ef.all()
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype(IDS)
            docs = np.frombuffer(row["doc_ids"], "<i8")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(bounds[:-1] + row["first_start"], pa.int64()),
                pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments."""
    return with_starts(segments).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(segments: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, ids array) of one document, by select on its segment's boundaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])
                for k in np.flatnonzero(np.frombuffer(row["doc_ids"], "<i8") == doc_id).tolist():
                    ids = np.frombuffer(row["ids"], f"<u{row['width']}")[ef.select(k):ef.select(k + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return segments.mapInArrow(run, "doc_id long, ids array<int>")

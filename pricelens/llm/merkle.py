"""Document fingerprints: Merkle trees over sections and paragraphs.

Method. A paragraph is a line; its leaves are content-defined pieces of about
64 bytes (a cut where a rolling hash of four bytes has six zero bits), so an
edit changes the leaves it touches and no others. A section is a run of
paragraphs that ends at a blank line or at a paragraph whose digest says so (one in
eight), which keeps sections local as well. Every node's digest is the hash
of its children's full digests. Equal roots mean equal texts; two trees differ
where their sections, then paragraphs, then leaves do.

Fingerprint: root (32 hex digits), ``:``, sections joined by ``;``; a section is 8
digits of its digest, ``=``, and its paragraphs joined by ``,``; a paragraph is the 8 first
digits of each leaf. Likeness of two fingerprints: twice the leaves they share, over
the leaves of both; 1 for equal roots.

Neighbours. Documents are dealt by doc_id ranges, largest first, one range a
task and sorted there; the first document of each range also goes to the range
before it (and the very first to the last), so each task streams its documents
with the next one at hand. Texts cross the network once.

Defined results: a null text is an empty one and has no leaves; a single document
is its own next; equal doc_ids stand beside each other by text; null doc_ids come
last. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_docs
from .scan import slices

_CUT = np.uint32(0xFC000000)
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaf_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all leaves, and which of them end a paragraph."""
    rolling = data.astype(np.uint32)
    for k in (1, 2, 3):
        rolling[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    stop = data == 0x0A
    cuts = ((rolling * np.uint32(2654435761)) & _CUT) == 0
    ends = np.flatnonzero(cuts | stop) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return ends, stop[ends - 1]


def fingerprint(text: str) -> str:
    body = text.encode("utf-8", "surrogatepass")
    sections: list[tuple[bytes, str]] = []
    if body:
        ends, stops = _leaf_ends(np.frombuffer(body, dtype=np.uint8))
        paragraphs: list[tuple[bytes, str]] = []
        leaves: list[bytes] = []
        a = 0
        last = len(ends) - 1

        def close() -> None:
            digest = _digest(b"s" + b"".join(d for d, _ in paragraphs))
            sections.append((digest, digest.hex()[:8] + "=" + ",".join(p for _, p in paragraphs)))
            paragraphs.clear()

        for k, (b, stop) in enumerate(zip(ends.tolist(), stops.tolist(), strict=True)):
            leaves.append(_digest(body[a:b]))
            a = b
            if stop or k == last:
                digest = _digest(b"p" + b"".join(leaves))
                paragraphs.append((digest, "".join([x.hex()[:8] for x in leaves])))
                blank = len(leaves) == 1 and b >= 2 and body[b - 2:b] == b"\n\n"
                leaves = []
                if blank or digest[0] < 32:
                    close()
        if paragraphs:
            close()
    return _digest(b"d" + b"".join(d for d, _ in sections)).hex() + ":" + ";".join(s for _, s in sections)


def leaves_of(print_: str) -> Counter:
    found: Counter = Counter()
    for section in print_[33:].split(";"):
        for p in section[9:].split(","):
            found.update(p[k:k + 8] for k in range(0, len(p), 8))
    return found


def likeness(x: str, y: str, x_leaves: Counter | None = None, y_leaves: Counter | None = None) -> float:
    if x[:32] == y[:32]:
        return 1.0
    a = leaves_of(x) if x_leaves is None else x_leaves
    b = leaves_of(y) if y_leaves is None else y_leaves
    both = a.total() + b.total()
    return 2.0 * (a & b).total() / both if both else 1.0


def differing_branches(x: str, y: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``x`` whose digest chain does not occur in ``y``: where the texts were edited."""
    if x[:32] == y[:32]:
        return []
    there = y[33:].split(";")
    known = set(there)
    paragraphs = {p for s in there for p in s[9:].split(",")}
    return [(i, j) for i, s in enumerate(x[33:].split(";")) if s not in known for j, p in enumerate(s[9:].split(",")) if p not in paragraphs]


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None
    out: list[tuple] = []
    done = False

    def judged(own: tuple, following: tuple) -> tuple:
        doc, text, own_print, own_leaves, _ = own
        half = len(text) // 2
        edited = text[:len(text) - half] + following[1][:half]
        edited_print = fingerprint(edited)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print, edited_print,
                likeness(own_print, edited_print, own_leaves), likeness(own_print, following[2], own_leaves, following[3]))

    for batch in slices(rows):
        for doc, text, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist(), batch.column("guest").to_pylist(), strict=True):
            if done:
                continue
            own_print = fingerprint(text)
            row = (doc, text, own_print, leaves_of(own_print), guest)
            if before is not None:
                out.append(judged(before, row))
            before, done = row, guest
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, types, strict=True)], names)
        out = []


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``; ``ranges`` tasks (default: the session's shuffle partitions)."""
    docs = text_docs(docs)
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    # n - 1 bounds and one head a range: both grow with the number of tasks only.
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("b")).first()["b"] or [])) if n > 1 else []
    place = (F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("doc_id")))) if bounds else F.lit(0))
    heads = ids.withColumn("range", place).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()
    receivers = [(h["head"], heads[k - 1]["range"]) for k, h in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(receivers, "head long, receiver int")
    homes = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("receiver").alias("range"), F.lit(True).alias("guest")))
    own = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))
    dealt = (docs.withColumn("range", place).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")
             .select("doc_id", "text", F.inline(F.when(F.col("receiver").isNull(), own).otherwise(homes))))
    ordered = (dealt.repartitionById(max(n, len(bounds) + 1), F.col("range"))
               .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))
    return ordered.select("doc_id", "text", "guest").mapInArrow(_compare, SCHEMA)

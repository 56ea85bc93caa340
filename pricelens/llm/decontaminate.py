"""Benchmark decontamination with a distributed positional inverted index.

Method. Words of the benchmark are counted over all documents; each window of
consecutive item words is looked up from its two rarest words. The index holds the
postings (word, document, position) of those words. The rarest word's postings,
less its offset in the window, give the possible starts; they are
intersected with the second word's postings at the adjusted position: the same
place is a phrase candidate, a place within ``SLOP`` words a proximity match.
Every phrase candidate is then compared word by word with its document.
Windows with a word that no document holds are not looked up.

Words travel as 64-bit hashes. Two fixed-size bitmaps (words, documents) keep rows that
cannot matter out of the shuffles; the joins after them decide. Frequent words split by the skew join, and
partners within a candidate are at most 2 * SLOP + 1.

Defined results: null and empty texts have no words, an item without words no
window; a repeated row is judged as often as it occurs; equal doc_ids with different
texts are judged apart; a null doc_id or item_id stays (a null item_id is not
listed); an empty benchmark finds nothing. The digest of no items is that of the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bitmap_of, cut, in_bitmap, text_docs
from .scan import ALNUM, longs, mix, slices, word_hashes

WINDOW, SLOP = 10, 3
#: log2 of the bits of the word and document filters (512 KB and 2 MB).
WORD_BITS, DOC_BITS = 22, 24
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = out * _STEP + words[k:k + len(out)]
    return mix(out + np.uint64(width))


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, at = word_hashes(batch.column("text"), ALNUM)
            items, ids, terms = [], [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = words[a:b]
                n = min(width, len(own))
                if n == 0:
                    continue
                for k, w in enumerate(rolled(own, n)):
                    items.append(item)
                    ids.append(w)
                    terms.append(own[k:k + n].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), longs(np.array(ids, dtype=np.uint64)), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "window", "terms"])
    return run


def _count(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, _ = word_hashes(batch.column("text"), ALNUM)
            term, n = np.unique(words[in_bitmap(bitmap, words)], return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(term), longs(n)], ["term", "n"])
    return run


def _post(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, at = word_hashes(batch.column("text"), ALNUM)
            where = np.flatnonzero(in_bitmap(bitmap, words))
            owner = np.searchsorted(at, where, "right") - 1
            doc = batch.column("doc").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([longs(words[where]), longs(doc), longs(where - at[owner])], ["term", "doc", "pos"])
    return run


def _only(texts: pa.Array, keep: np.ndarray) -> pa.Array:
    """The texts where ``keep`` is true, else null."""
    return texts.take(pa.array(np.arange(len(texts)), mask=~keep))


def _measure(bitmap: np.ndarray):
    """Word counts of all documents; the text of those that may have candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, at = word_hashes(batch.column("text"), ALNUM)
            keep = in_bitmap(bitmap, batch.column("doc").to_numpy().view(np.uint64))
            text = _only(batch.column("text"), keep)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), longs(np.diff(at)), text], ["doc_id", "doc", "n_words", "text"])
    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each candidate with its document; hit words are counted once."""
    for batch in slices(batches):
        hits, found = [], []
        lists = batch.column("candidates").to_pylist()
        words, at = word_hashes(_only(batch.column("text"), batch.column("candidates").is_valid().to_numpy(zero_copy_only=False)), ALNUM)
        for a, b, candidates in zip(at[:-1].tolist(), at[1:].tolist(), lists, strict=True):
            own, hit, windows = words[a:b], np.zeros(b - a, dtype=bool), set()
            by_width: dict[int, np.ndarray] = {}
            for c in candidates or ():
                n, start = c["n"], c["start"]
                if n not in by_width:
                    by_width[n] = rolled(own, n).view(np.int64)
                if 0 <= start < len(by_width[n]) and by_width[n][start] == c["window"]:
                    hit[start:start + n] = True
                    windows.add(c["window"])
            hits.append(int(hit.sum()))
            found.append(sorted(windows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "doc", "n_words", "n_hit", "windows"])


def keyed(docs: DataFrame) -> DataFrame:
    return text_docs(docs).withColumn("doc", F.xxhash64("doc_id", "text"))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id string, window, terms) of every window of every item."""
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_windows(width), "item_id string, window long, terms array<long>")


def rarest_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, n, o1, t1, o2, t2): each window's size and its rarest words with their offsets; o2 is null for one word."""
    distinct = windows.groupBy("window").agg(F.first("terms").alias("terms"))
    terms = cut(distinct.select("window", F.posexplode("terms").alias("off", "term")))
    bitmap = bitmap_of(terms, "term", WORD_BITS)
    counts = docs.select("text").mapInArrow(_count(bitmap), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_window = (terms.join(counts, "term", "left").groupBy("window")
                 .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("r")))
    return cut(by_window.where(F.col("r")[0]["n"] > 0).select(
        "window", F.size("r").alias("n"), F.col("r")[0]["off"].alias("o1"), F.col("r")[0]["term"].alias("t1"),
        F.get("r", F.lit(1))["off"].alias("o2"), F.get("r", F.lit(1))["term"].alias("t2")))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index (term, doc, pos) of the given words."""
    bitmap = bitmap_of(terms, "term", WORD_BITS)
    return cut(docs.select("doc", "text").mapInArrow(_post(bitmap), "term long, doc long, pos long").join(terms, "term", "left_semi"))


def matches(index: DataFrame, rare: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc, window, n, start, off_by): starts from the rarest word, intersected with the second's list; off_by 0 is a phrase candidate."""
    first = index.join(rare, index.term == rare.t1).select("doc", "window", "n", (F.col("pos") - F.col("o1")).alias("start"), "o2", "t2").where("start >= 0")
    single = first.where("t2 IS NULL").select("doc", "window", "n", "start", F.lit(0).cast("long").alias("off_by"))
    side = 4 * slop + 4
    target = F.col("start") + F.col("o2")
    low, high = F.floor((target - slop) / side), F.floor((target + slop) / side)
    wanted = first.where("t2 IS NOT NULL").withColumn("cell", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    second = index.select(F.col("doc").alias("d"), F.col("term").alias("t"), F.floor(F.col("pos") / side).alias("c"), "pos")
    both = (wanted.join(second, (F.col("doc") == F.col("d")) & (F.col("t2") == F.col("t")) & (F.col("cell") == F.col("c")))
            .select("doc", "window", "n", "start", (F.col("pos") - target).alias("off_by")).where(F.abs("off_by") <= slop))
    return cut(single.unionByName(both))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, doc (a hash of id and text), n_words, n_hit, n_items, items_sha256, contaminated, n_near (items met only in proximity), hit items."""
    docs = keyed(docs)
    windows = cut(benchmark_windows(benchmark))
    rare = rarest_terms(docs, windows)
    anchors = rare.select(F.col("t1").alias("term")).unionByName(rare.where("t2 IS NOT NULL").select(F.col("t2").alias("term"))).distinct()
    found = matches(postings(docs, anchors), rare)
    per_doc = cut(found.where("off_by = 0").groupBy("doc").agg(F.collect_set(F.struct("start", "n", "window")).alias("candidates")))
    measured = docs.mapInArrow(_measure(bitmap_of(per_doc, "doc", DOC_BITS)), "doc_id long, doc long, n_words long, text string")
    judged = cut(measured.join(per_doc, "doc", "left").select("doc_id", "doc", "n_words", "text", "candidates")
                 .mapInArrow(_confirm, "doc_id long, doc long, n_words long, n_hit long, windows array<long>"))
    owners = windows.select("window", "item_id").where("item_id IS NOT NULL").distinct()
    exact = judged.select("doc", F.explode("windows").alias("window")).distinct().join(owners, "window").select("doc", "item_id", F.lit(0).alias("near"))
    near = found.where("off_by <> 0").select("doc", "window").distinct().join(owners, "window").select("doc", "item_id", F.lit(1).alias("near"))
    items = (exact.unionByName(near).groupBy("doc", "item_id").agg(F.min("near").alias("near"))
             .groupBy("doc").agg(F.sort_array(F.collect_list(F.when(F.col("near") == 0, F.col("item_id")))).alias("items"), F.sum("near").alias("n_near")))
    none = F.array().cast("array<string>")
    return (judged.join(items, "doc", "left").withColumn("items", F.coalesce("items", none))
            .select("doc_id", "doc", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "items"))


def clean_only(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated; rows that share an id, or have none, are judged each by its own text."""
    dirty = judged.where("contaminated").select(F.col("doc").alias("_dirty")).distinct()
    return docs.join(dirty, F.xxhash64(docs.doc_id.cast("long"), docs.text) == F.col("_dirty"), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest([array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(10, len(ws)) + 2)]) AS w FROM b WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest([{'p': i, 'w': array_to_string(ws[i:i + n - 1], ' ')} FOR i IN range(1, len(ws) - n + 2)]) AS x FROM d, ns WHERE len(ws) >= n),
m AS (SELECT DISTINCT doc_id, x.p AS p, dw.n, item_id FROM dw JOIN bw ON bw.w = dw.x.w AND bw.n = dw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

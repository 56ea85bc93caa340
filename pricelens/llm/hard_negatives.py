"""Hard negatives: texts that score high with an anchor but have another label.

Method: segment summary filtering. A vector is cut into segments; each keeps its mean
and deviation. Over a segment of w components the product of two vectors
lies within w * (mean * mean -+ deviation * deviation), so the sums of those bound
the score from both sides. Pairs that the coarse segments leave open are bounded again by finer
ones, and scored exactly only if these leave them open too.

A search is anchors against all rows: anchors go out ``ROUND`` at a time (a broadcast of
that many vectors at most), each task reads its rows in blocks and keeps the
best few of each anchor, whose lowest score is the next block's bound; the tasks'
lists are merged by a limit per anchor. Nothing is shuffled but those lists.

Defined results: rows without id, label or vector, or with a null, NaN or infinite component, take no part;
a shorter vector counts as filled up with zeros (an empty one scores 0); a vector may have any length; the product of
two vectors' lengths must stay below 2**53, up to where scores are exact (else the task fails); higher scores come first, ties by smaller vec_id; repeated rows count each for itself, so a
repeated anchor is asked as often and is its own copy's positive; an anchor without positives or negatives has no row; an empty
table gives none. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stored

#: Components in a segment, level by level.
LEVELS = (16, 4)
#: Anchors that are sent to the tasks at a time.
ROUND = 16384
#: Rows and anchors of one block.
BLOCK, ANCHORS = 4096, 512
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
_NONE = -math.inf


class Side:
    """Vectors as rows of whole numbers, with the segment summaries of each level."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.levels = []
        for width in LEVELS:
            parts = vectors.reshape(len(vectors), -1, width)
            self.levels.append((parts.mean(axis=2), parts.std(axis=2)))
        #: The longest vector's length; two of them bound every score and every sum on the way to it.
        self.most = float(np.sqrt((vectors * vectors).sum(axis=1).max(initial=0)))

    def take(self, index: np.ndarray) -> Side:
        other = object.__new__(Side)
        other.exact, other.levels, other.most = self.exact[index], [(m[index], d[index]) for m, d in self.levels], self.most
        return other

    def as_wide_as(self, other: Side) -> Side:
        width = other.exact.shape[1]
        return self if self.exact.shape[1] == width else Side(widened(self.exact, width))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of float64, filled up with zeros to a multiple of the coarsest segment (and to ``width``)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(lists.flatten()).astype(np.float64)
    width = max(width, -(-int(lengths.max(initial=1)) // LEVELS[0]) * LEVELS[0], LEVELS[0])
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))


def _check(a: Side, b: Side) -> None:
    if a.most * b.most >= 2 ** 53:
        raise ArithmeticError("scores are not exact beyond 2**53")


def bounded_scores(a: Side, b: Side, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scores of all pairs that may lie between the anchors' ``low`` and ``high``; minus infinity for those whose bounds say no."""
    _check(a, b)
    rows, columns = np.arange(len(a.exact)), np.arange(len(b.exact))
    out = np.full((len(rows), len(columns)), _NONE)
    open_ = np.ones(out.shape, dtype=bool)
    for level, width in enumerate(LEVELS):
        (am, ad), (bm, bd) = a.levels[level], b.levels[level]
        middle, spread = am @ bm.T * width, ad @ bd.T * width
        slack = 1 + 1e-9 * (np.abs(middle) + spread)
        open_ &= (middle + spread + slack >= low[rows, None]) & (middle - spread - slack <= high[rows, None])
        r, c = open_.any(axis=1), open_.any(axis=0)
        if not r.any():
            return out
        if not (r.all() and c.all()):
            rows, columns, a, b, open_ = rows[r], columns[c], a.take(r), b.take(c), open_[np.ix_(r, c)]
    if open_.mean() > 0.1:
        out[np.ix_(rows, columns)] = np.where(open_, a.exact @ b.exact.T, _NONE)
    else:
        r, c = np.nonzero(open_)
        for k in range(0, len(r), BLOCK * 16):
            i, j = r[k:k + BLOCK * 16], c[k:k + BLOCK * 16]
            out[rows[i], columns[j]] = np.einsum("ij,ij->i", a.exact[i], b.exact[j])
    return out


class Best:
    """The first ``k`` (score, id) of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NONE)
        self.ids = np.zeros((n, k), dtype=np.int64)

    def least(self, lists: slice | np.ndarray) -> np.ndarray:
        """What a score has to reach to enter."""
        return self.scores[lists, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``lists`` x ``ids``; minus infinity is no entry."""
        least = self.least(lists)
        entry = (scores >= least[:, None]) & (scores > _NONE)
        if entry.sum() > 4 * self.k * len(lists) and scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
            entry &= scores >= least[:, None]
        i, j = np.nonzero(entry)
        touched = np.unique(i)
        if not len(touched):
            return
        where = lists[touched]
        owner = np.concatenate([np.searchsorted(touched, i), np.repeat(np.arange(len(touched)), self.k)])
        value = np.concatenate([scores[i, j], self.scores[where].ravel()])
        known = np.concatenate([ids[j], self.ids[where].ravel()])
        order = np.lexsort((known, -value, owner))
        owner, value, known = owner[order], value[order], known[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = place < self.k
        self.scores[where[owner[first]], place[first]] = value[first]
        self.ids[where[owner[first]], place[first]] = known[first]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Side]]:
    """Row number, id, label and vectors, at most ``BLOCK`` rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            row, ids, label = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            yield row, ids, label, Side(matrix(part.column("vector"), width))


def _search_same(anchors):
    """The best rows of the anchor's own label, without itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, label, vectors, _ = anchors.value
        best, own = Best(len(number), POSITIVES), Side(vectors)
        for row, ids, other, side in _blocks(batches, vectors.shape[1]):
            own = own.as_wide_as(side)
            for name in np.unique(other).tolist():
                columns, mine = np.flatnonzero(other == name), np.flatnonzero(label == name)
                for k in range(0, len(mine), ANCHORS):
                    lists = mine[k:k + ANCHORS]
                    scores = bounded_scores(own.take(lists), side.take(columns), best.least(lists), np.full(len(lists), math.inf))
                    scores[number[lists][:, None] == row[columns][None, :]] = _NONE
                    best.add(lists, scores, ids[columns])
        yield _found(number, np.zeros(len(number), dtype=np.int64), best)
    return run


def _search_other(anchors):
    """The best rows of other labels between the bounds that each positive sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, label, vectors, positives = anchors.value
        least, most = -(-positives * LOW // 100), positives * HIGH // 100  # a place without positive is NaN, which no score meets
        best, own = [Best(len(number), NEGATIVES) for _ in range(POSITIVES)], Side(vectors)
        for _, ids, other, side in _blocks(batches, vectors.shape[1]):
            own = own.as_wide_as(side)
            for k in range(0, len(number), ANCHORS):
                lists = np.arange(k, min(k + ANCHORS, len(number)))
                entry = [np.where(np.isnan(least[lists, p]), math.inf, np.maximum(least[lists, p], best[p].least(lists))) for p in range(POSITIVES)]
                scores = bounded_scores(own.take(lists), side, np.min(entry, axis=0), np.nan_to_num(most[lists], nan=_NONE).max(axis=1))
                scores[label[lists][:, None] == other[None, :]] = _NONE
                for p in range(POSITIVES):
                    inside = (scores >= entry[p][:, None]) & (scores <= most[lists, p][:, None])
                    if inside.any():
                        best[p].add(lists, np.where(inside, scores, _NONE), ids)
        for p in range(POSITIVES):
            yield _found(number, np.full(len(number), p), best[p])
    return run


def _found(number: np.ndarray, place: np.ndarray, best: Best) -> pa.RecordBatch:
    i, j = np.nonzero(best.scores > _NONE)
    arrays = [number[i], place[i], best.scores[i, j].astype(np.int64), best.ids[i, j]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["anchor", "place", "score", "vec_id"])


_FOUND = "anchor long, place long, score long, vec_id long"


def prepared(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(row, vec_id, label, vector): the rows that take part, each with a number of its own, components as floor(256 x). Stored."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return stored(embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
                  .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                          F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector")), "vectors")


def _in_rounds(rows: DataFrame, asked: DataFrame, search, name: str) -> DataFrame:
    """What ``search`` finds in each task for all of ``asked``, by ``ROUND`` anchors at a time. Stored."""
    spark = rows.sparkSession
    rounds = -(-asked.count() // ROUND)
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("row"), F.lit(max(1, rounds))))
    found = None
    for k in range(rounds):
        group = dealt.where(F.col("round") == k).drop("round").toArrow().combine_chunks()
        if not group.num_rows:
            continue
        positives = np.full((group.num_rows, POSITIVES), np.nan)
        if "positives" in group.column_names:
            for i, scores in enumerate(group.column("positives").to_pylist()):
                positives[i, :len(scores)] = scores
        anchors = spark.sparkContext.broadcast((group.column("row").to_numpy(), group.column("label").to_numpy(), matrix(group.column("vector")), positives))
        part = stored(rows.mapInArrow(search(anchors), _FOUND), name)
        anchors.unpersist()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _FOUND) if found is None else found


def hard_negatives(rows: DataFrame, anchors: Column) -> DataFrame:
    """Per anchor (a row where ``anchors`` holds) and positive: the negatives by rank. ``rows`` as ``prepared`` gives them."""
    asked = rows.where(anchors)
    order = [F.col("score").desc(), "vec_id"]
    near = _in_rounds(rows, asked, _search_same, "same")
    near = (near.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= POSITIVES)
            .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id"))).alias("p")))  # at most POSITIVES entries
    asked = stored(asked.join(near.withColumnRenamed("anchor", "row"), "row").withColumn("positives", F.col("p.score")), "asked")
    far = _in_rounds(rows, asked.select("row", "label", "vector", "positives"), _search_other, "other")
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= NEGATIVES)
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "p")
    positive = F.get("p", F.col("place").cast("int"))
    return (ranked.join(named, "anchor")
            .select("anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")))


def mined(embeddings: DataFrame) -> DataFrame:
    """The query: anchors are the rows whose vec_id is divisible by 100; labels of every seventh vec_id are one further."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(embeddings, shifted), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.n AS an, a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a, r WHERE a.vec_id % 100 = 0 AND a.n <> r.n),
p AS (
  SELECT an, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) AS k
  FROM s WHERE same QUALIFY k <= 5),
q AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.an, k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.an = p.an AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM q
"""

"""Deletion of repeated line runs by a suffix array over line ids, in DataFrame functions only.

Method. Lines get ids by content; only lines that occur more than once can be
part of a repeated run, so only those positions stay active. Prefix doubling
ranks suffixes: in round k the pair (rank of the 2**k lines here, rank of the
2**k lines after them) is ranked again, by sorting the distinct pairs that occur more
than once over many tasks; a position whose pair occurs once is done. Ranks keep the
suffix order and equal ranks are equal runs.

A run counts from ``min_words`` words on. So the suffixes whose longest common
prefix reaches that depth form one interval of the suffix array: for each
position the shortest run from it (and the shortest up to it) with that many
words, named by its two overlapping ranks of 2**k lines. Within an interval the
first occurrence by (doc_id, line) stays and the others are later copies. Runs that
overlap join to the maximal repeated runs; their lines are deleted. Since a run
of min_words words has at most min_words lines (lines without words are left
out of the sequence), the array is needed, and built, to that depth only.

Skew: lines and pairs are counted before they are shuffled, joins back to positions
are split when a line is hot, and no group is gathered but one document's lines.

Defined results: a null text stays null; an empty text is one line without words and
stays; lines without words are deleted only with a run around them; the
first place of any line is never deleted, also where copies overlap; of rows with equal
doc_id and text neither is later than the other, so both keep the same; equal doc_ids
with different texts are ordered by text hash; a null doc_id comes first. Other
columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

MIN_WORDS = 10
_KEYS = ["doc", "part"]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, part, line, pos, words, digest): one row per line with words; line counts all lines of the text, pos those with words."""
    lines = F.transform(F.split("text", "\n", -1), lambda content, line: F.struct(content.alias("content"), line.alias("line")))
    lines = F.filter(lines, lambda x: x["content"].rlike(r"[^\x20\x09-\x0D]"))
    return (docs.where("text IS NOT NULL").select(*_KEYS, F.posexplode(lines).alias("pos", "x"))
            .select(*_KEYS, F.col("x.line").alias("line"), "pos", F.regexp_count("x.content", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.unhex(F.md5("x.content")).alias("digest")))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Adds doc (order of documents; null first) and part (tells equal doc_ids apart)."""
    return docs.select(*more, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("part"))


def _ranked(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The groups of ``names`` that occur more than once, with order-preserving ranks: row ids of a range-sorted table rise with the key."""
    kept = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names)
    return cut(kept.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("rank", F.monotonically_increasing_id()))


def suffix_ranks(positions: DataFrame, depth: int) -> dict[int, DataFrame]:
    """{length: (doc, part, pos, rank)} for lengths 1, 2, 4, ... <= depth: ranks of the runs of that many lines that occur more than once."""
    level = positions.select(*_KEYS, "pos", "rank")
    levels, length = {1: level}, 1
    while length * 2 <= depth:
        after = F.first("rank").over(Window.partitionBy(*_KEYS).orderBy("pos").rangeBetween(length, length))
        pairs = level.withColumn("r2", after).where("r2 IS NOT NULL").withColumnRenamed("rank", "r1")
        level = cut(pairs.join(_ranked(pairs, ["r1", "r2"]), ["r1", "r2"]).select(*_KEYS, "pos", "rank"))
        length *= 2
        levels[length] = level
    return levels


def _shortest_runs(active: DataFrame, min_words: int) -> DataFrame:
    """(doc, part, a, b): for each active position the shortest run from it, and up to it, of active lines with at least min_words words."""
    by_pos = Window.partitionBy(*_KEYS).orderBy("pos")
    rows = active.withColumn("stretch", F.col("pos") - F.row_number().over(by_pos))
    stretch = Window.partitionBy(*_KEYS, "stretch")
    rows = rows.withColumn("total", F.sum("words").over(stretch.orderBy("pos"))).withColumn("before", F.col("total") - F.col("words"))
    # A run from p ends at the first line whose total reaches before(p) + min_words. Thresholds and totals are sorted together;
    # the last total passed on the way down is the nearest. Likewise from below for runs up to p.
    down = rows.select(*_KEYS, "stretch", F.col("total").alias("at"), "pos", F.lit(True).alias("mark")).unionByName(
        rows.select(*_KEYS, "stretch", (F.col("before") + min_words).alias("at"), "pos", F.lit(False).alias("mark")))
    up = rows.select(*_KEYS, "stretch", F.col("before").alias("at"), "pos", F.lit(True).alias("mark")).unionByName(
        rows.select(*_KEYS, "stretch", (F.col("total") - min_words).alias("at"), "pos", F.lit(False).alias("mark")))
    nearest = F.last(F.when(F.col("mark"), F.col("pos")), ignorenulls=True)
    so_far = (Window.unboundedPreceding, 0)
    ends = (down.withColumn("b", nearest.over(stretch.orderBy(F.desc("at"), F.desc("mark")).rowsBetween(*so_far)))
            .where("NOT mark AND b IS NOT NULL").select(*_KEYS, F.col("pos").alias("a"), "b"))
    begins = (up.withColumn("a", nearest.over(stretch.orderBy("at", F.desc("mark")).rowsBetween(*so_far)))
              .where("NOT mark AND a IS NOT NULL").select(*_KEYS, "a", F.col("pos").alias("b")))
    return ends.unionByName(begins).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, part, first_line, last_line): maximal stretches of lines that belong to later copies of repeated runs."""
    lines = line_table(docs)
    ids = _ranked(lines.select(*_KEYS, "digest"), ["digest"])
    active = cut(lines.join(ids, "digest").select(*_KEYS, "pos", "line", "words", "rank").dropDuplicates([*_KEYS, "pos"]))
    runs = cut(_shortest_runs(active, min_words).withColumn("n", F.col("b") - F.col("a") + 1))
    depth = runs.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    named = None
    for length, level in suffix_ranks(active, depth).items():
        own = runs.where((F.col("n") >= length) & (F.col("n") < 2 * length))
        head = level.select(*_KEYS, F.col("pos").alias("a"), F.col("rank").alias("r1"))
        tail = level.select(*_KEYS, (F.col("pos") + length - 1).alias("b"), F.col("rank").alias("r2"))
        found = own.join(head, [*_KEYS, "a"]).join(tail, [*_KEYS, "b"])
        named = found if named is None else named.unionByName(found)
    named = cut(named)
    place = F.struct(*_KEYS, "a")
    first = cut(named.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    later = named.join(first, ["n", "r1", "r2"]).where(place > F.col("first")).select(*_KEYS, "a", "b").distinct()
    spots = active.select(*_KEYS, "pos", "line")
    spans = (later.join(spots.select(*_KEYS, F.col("pos").alias("a"), F.col("line").alias("lo")), [*_KEYS, "a"])
             .join(spots.select(*_KEYS, F.col("pos").alias("b"), F.col("line").alias("hi")), [*_KEYS, "b"]))
    in_order = Window.partitionBy(*_KEYS).orderBy("lo", "hi")
    reached = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (spans.withColumn("new", F.when(F.col("lo") <= reached + 1, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*_KEYS, "run").agg(F.min("lo").alias("first_line"), F.max("hi").alias("last_line")).drop("run"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of later copies deleted from text, and ``deleted_runs``: array of (first_line, last_line)."""
    runs = (repeated_runs(_keyed(docs), min_words).groupBy(*_KEYS)
            .agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("runs")))
    rows = _keyed(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).join(runs, _KEYS, "left")
    lines = F.split("text", "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last_line"] + 1))
    stops = F.concat(F.transform("runs", lambda r: r["first_line"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("start"), stops.alias("stop")), lambda s: F.slice(lines, s["start"] + 1, s["stop"] - s["start"])))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    none = F.array().cast("array<struct<first_line:int,last_line:int>>")
    return rows.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.coalesce("runs", none).alias("deleted_runs"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
w AS (
  SELECT doc_id, line, content, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM l),
p AS (
  SELECT *, row_number() OVER o AS pos, sum(words) OVER o AS total FROM w WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
j AS (
  SELECT x.doc_id, x.pos AS a, y.pos AS b, y.total - x.total + x.words AS n FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + 9),
r AS (
  SELECT doc_id, a, min(b) AS b FROM j WHERE n >= 10 GROUP BY doc_id, a
  UNION
  SELECT doc_id, max(a) AS a, b FROM j WHERE n >= 10 GROUP BY doc_id, b),
c AS (
  SELECT r.doc_id, a, b, md5(string_agg(content, chr(10) ORDER BY pos)) AS h, min(line) AS lo, max(line) AS hi
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.pos BETWEEN a AND b GROUP BY r.doc_id, a, b),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS turn FROM c),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS line FROM k WHERE turn > 1),
t AS (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY line) AS text FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(g.n, 0) AS n_deleted
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)
"""

"""Prefix trie of conversations: what their common beginnings would save.

Method: depth-band rollup. A node is the hash of a sequence of turns; a row per
node holds its ancestors in its own band of ``BAND`` depths only. Sums inside a
band come from one explosion to those ancestors; the totals of band roots, which
are a trie of a ``BAND``-th of the depth and are completed the same way first, are then
handed to the band above. So a row explodes to at most ``BAND`` rows and the rounds are the
logarithm of the depth to the base ``BAND``.

A turn's hash is two 64-bit hashes of role and text; a prefix is the polynomial
of its turns, so that any stretch of a conversation can be hashed by itself and
a conversation that fills many tasks is put together from one row a task.
Texts do not travel: only their hash, their length and, to order turns
with the same number, the first ``ORDER_CHARS`` characters.

Defined results: rows without conv_id belong to no conversation and take no part; a null
turn comes first; null role or text is empty; rows of a conversation with the
same turn follow role, then text (by their first ``ORDER_CHARS`` characters, then by hash); repeated rows are
turns of their own; very long texts count whole; an empty table has no nodes, not even a root. Only conv_id,
turn, role and text are read, so other columns may have any name. The hash of the members that
end at a node is one SHA-256 after another by nature: its ids come in sorted chunks and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, stored

#: Depths in a band.
BAND = 8
#: Characters that order turns of the same number before their hashes do.
ORDER_CHARS = 64
#: Range of conv_id whose members are joined into one chunk before hashing.
CHUNK = 4096
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)
KEY = "struct<k1: bigint, k2: bigint>"
_SCANNED = "conv_id long, part int, at long, k1 long, k2 long, chars long, total boolean"


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, dtype=np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


def _column(batch: pa.RecordBatch, name: str, kind: type = np.int64) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and hash the prefixes of each conversation's stretch in this task; the totals of its first and last one follow."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, count, sums = None, 0, (0, 0)  # the conversation that the last batch ended in
    totals: list[tuple] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = _column(batch, "conv_id")
        new = np.ones(n, dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = conv is None or ids[0] != conv
        if new[0] and conv is not None and not totals:
            totals.append((conv, count, *sums))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        goes_on = np.cumsum(new) == 0
        at = np.arange(n) - start + np.where(goes_on, count, 0)
        up, down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        ahead = np.uint64(pow(_BASE, count, 1 << 64))
        lanes = []
        for lane, before in zip(("h1", "h2"), sums, strict=True):
            run = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_column(batch, lane).view(np.uint64) * up[:n], out=run[1:])
            own = (run[1:] - run[start]) * down[start]
            lanes.append(np.where(goes_on, np.uint64(before) + own * ahead, own))
        if not totals and new[1:].any():  # the first conversation ends inside this batch
            last = int(np.flatnonzero(new[1:])[0])
            totals.append((int(ids[last]), int(at[last]) + 1, int(lanes[0][last]), int(lanes[1][last])))
        conv, count, sums = int(ids[-1]), int(at[-1]) + 1, (int(lanes[0][-1]), int(lanes[1][-1]))
        yield _scanned(ids, part, at, *lanes, batch.column("chars"), False)
    if conv is not None:
        totals = [t for t in totals if t[0] != conv] + [(conv, count, *sums)]
        c, k, a, b = (np.array(x, dtype=np.uint64 if i > 1 else np.int64) for i, x in enumerate(zip(*totals, strict=True)))
        yield _scanned(c, part, k, a, b, pa.array([0] * len(c), pa.int64()), True)


def _scanned(ids: np.ndarray, part: int, at: np.ndarray, k1: np.ndarray, k2: np.ndarray, chars: pa.Array, total: bool) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(at, pa.int64()), pa.array(k1.view(np.int64)),
                                       pa.array(k2.view(np.int64)), chars, pa.array(np.full(n, total))], ["conv_id", "part", "at", "k1", "k2", "chars", "total"])


def _placed(before: dict[int, tuple]):
    """Add what earlier tasks hold of the one conversation that a task may go on with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = _column(batch, "conv_id"), _column(batch, "at").copy()
            part = _column(batch, "part")
            lanes = [_column(batch, x).view(np.uint64).copy() for x in ("k1", "k2")]
            for p in np.unique(part).tolist():
                if p in before:
                    conv, count, *sums = before[p]
                    mine = (part == p) & (ids == conv)
                    at[mine] += count
                    for lane, x in zip(lanes, sums, strict=True):
                        lane[mine] = np.uint64(x) + lane[mine] * np.uint64(pow(_BASE, count, 1 << 64))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(at), *(pa.array(x.view(np.int64)) for x in lanes), batch.column("chars")], ["conv_id", "at", "k1", "k2", "chars"])
    return run


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, k1, k2, chars): each turn's place from 0, the hash of the turns up to it, and its text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(role, F.lit(ORDER_CHARS)).alias("role"), F.left(text, F.lit(ORDER_CHARS)).alias("text"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "h1", "h2", "row"]
    scanned = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan, _SCANNED), "turns")
    before: dict[int, tuple] = {}
    totals = scanned.where("total").select("part", "conv_id", "at", "k1", "k2").collect()  # at most two rows a task
    reached: dict[int, tuple] = {}
    for row in sorted(totals, key=lambda r: (r["part"], r["conv_id"])):
        count, a, b = reached.get(row["conv_id"], (0, 0, 0))
        if count:
            before[row["part"]] = (row["conv_id"], count, a, b)
        step = pow(_BASE, count, 1 << 64)
        reached[row["conv_id"]] = (count + row["at"], (a + (row["k1"] & _MASK) * step) & _MASK, (b + (row["k2"] & _MASK) * step) & _MASK)
    return scanned.where("NOT total").mapInArrow(_placed(before), "conv_id long, at long, k1 long, k2 long, chars long")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of prefixes whose first ``h`` turns are replaced by ``m`` others."""
    for batch in batches:
        shift = _column(batch, "m") - _column(batch, "h")
        factor = np.where(shift < 0, _powers(_INVERSE, 8)[np.clip(-shift, 0, 7)], _powers(_BASE, 8)[np.clip(shift, 0, 7)])
        lanes = []
        for k in ("1", "2"):
            whole, own, other = (_column(batch, x + k).view(np.uint64) for x in ("k", "o", "b"))
            lanes.append(pa.array((other + (whole - own) * factor).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), *lanes, batch.column("chars"), batch.column("ends")], ["conv_id", "depth", "k1", "k2", "chars", "ends"])


def grafted(turns: DataFrame, donor: F.Column, h: F.Column, most: int) -> DataFrame:
    """Rows for ``trie`` of all conversations after their first ``h`` (at most ``most`` < 8) turns were replaced by the first ``h`` of conversation ``donor``.

    ``turns`` is what ``prefixes`` returns; ``donor`` and ``h`` are columns of conv_id. A donor that does not exist gives no turns.
    """
    own = (turns.withColumn("h", h).groupBy("conv_id")
           .agg((F.max("at") + 1).alias("length"), F.max(F.when(F.col("at") == F.col("h") - 1, F.struct("k1", "k2"))).alias("own")))
    first = (turns.where(F.col("at") < most).join(own.select(donor.alias("conv_id")).distinct(), "conv_id", "left_semi").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("at", "k1", "k2", "chars"))).alias("first")).withColumnRenamed("conv_id", "donor"))
    convs = own.withColumns({"donor": donor, "h": h}).join(first, "donor", "left").withColumn("m", F.least("h", F.coalesce(F.size("first"), F.lit(0))))
    convs = stored(convs.withColumns({"to": F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0)), "base": F.get("first", F.col("m") - 1)}), "conversations")
    zero = F.lit(0).cast("long")
    info = convs.select("conv_id", "h", "m", "to", *(F.coalesce(F.col(f"{c}.k{k}"), zero).alias(f"{c[0]}{k}") for c in ("own", "base") for k in (1, 2)))
    depth = F.col("at") - F.col("h") + F.col("m") + 1
    kept = (turns.join(info, "conv_id").where("at >= h").select("conv_id", depth.alias("depth"), "k1", "k2", "chars", (depth == F.col("to")).alias("ends"), "h", "m", "o1", "o2", "b1", "b2")
            .mapInArrow(_moved, "conv_id long, depth long, k1 long, k2 long, chars long, ends boolean"))
    given = (convs.where("m > 0").select("conv_id", "to", F.inline(F.slice("first", F.lit(1), F.col("m"))))
             .select("conv_id", (F.col("at") + 1).alias("depth"), "k1", "k2", "chars", (F.col("at") + 1 == F.col("to")).alias("ends")))
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), (F.col("to") == 0).alias("ends"))
    return kept.unionByName(given).unionByName(roots)


def _with_up(rows: DataFrame, band: int) -> DataFrame:
    """(conv_id, depth, key, chars, up): ``up`` is the keys above in the node's band; for a band root, those of the whole band above."""
    d = F.col("depth")
    inside, above = F.floor(d / band), F.floor(d / band) - 1
    is_root = (d % band == 0) & (d > 0)
    places = F.when(is_root, F.array(F.struct(inside.alias("band"), F.lit(False).alias("counts")), F.struct(above.alias("band"), F.lit(True).alias("counts")))).otherwise(
        F.array(F.struct(inside.alias("band"), F.lit(True).alias("counts"))))
    window = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("place", F.explode(places)).select("*", "place.band", "place.counts")
            .withColumn("up", F.collect_list("key").over(window)).where("counts").drop("place", "band", "counts"))


def _totals(nodes: DataFrame, rows: DataFrame, deepest: int, band: int) -> DataFrame:
    """(key, n_leaves, saved_tokens) summed over subtrees. nodes: (key, depth, up, n_leaves, saved_tokens); rows: (conv_id, depth, key) of all conversations."""
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    inside = F.when(F.col("depth") % band != 0, F.array_append("up", F.col("key"))).otherwise(F.array("key"))
    part = cut(nodes.select(F.explode(inside).alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(*sums))
    if deepest < band:
        return part
    upper = rows.where(F.col("depth") % band == 0).withColumn("depth", F.floor(F.col("depth") / band))
    heads = _with_up(upper, band).groupBy("key").agg(F.min(F.struct("conv_id", "depth", "up")).alias("r")).select("key", "r.depth", "r.up").join(part, "key")
    complete = _totals(heads, upper, deepest // band, band)
    handed = (nodes.where((F.col("depth") % band == 0) & (F.col("depth") > 0)).select("key", "up").join(complete, "key")
              .select(F.explode("up").alias("key"), "n_leaves", "saved_tokens"))
    return cut(part.unionByName(handed).groupBy("key").agg(*sums))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's comma-joined chunks, which come sorted; a stream, whatever the number of chunks."""
    last, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != last:
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if last is not None:
        yield _digests([(*last, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations that end at a node, in chunks of conv_id ranges."""
    chunks = (rows.where("ends").groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    return (chunks.select("key.k1", "key.k2", "chunk", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
            .mapInArrow(_digest, "k1 long, k2 long, ends_sha256 string").select(F.struct("k1", "k2").alias("key"), "ends_sha256"))


def trie(rows: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node.

    ``rows`` has (conv_id, depth, k1, k2, chars, ends) for each conversation and depth: the root (depth 0, k1 = k2 = 0) and each prefix;
    ``ends`` marks a conversation's whole sequence. A node is its smallest member (conv_id) and depth.
    """
    rows = stored(rows.select("conv_id", "depth", F.struct("k1", "k2").alias("key"), "chars", "ends"), "prefixes")
    kept = (_with_up(rows, band).groupBy("key").agg(F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "depth", "chars", "up")).alias("r"))
            .select("key", "n_convs", "r.*", F.try_element_at("r.up", F.lit(-1)).alias("parent")))
    nodes = stored(kept, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    valued = nodes.select("key", "depth", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = _totals(valued, rows.select("conv_id", "depth", "key"), deepest, band)
    whole = nodes.drop("up", "chars").join(totals, "key").join(_ends(rows), "key", "left")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (whole.join(above, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def regrafted_trie(conversations: DataFrame, most: int = 5, hundred: int = 100) -> DataFrame:
    """The trie after each conversation c took its first crc32(c) % (most + 1) turns from conversation c - c % hundred."""
    c = F.col("conv_id")
    return trie(grafted(prefixes(conversations), c - c % hundred, (F.crc32(c.cast("string")) % (most + 1)).cast("int"), most))


ORACLE = """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 100 AS b, xor(4294967295, list_reduce([4294967295] || [ord(s) FOR s IN string_split(CAST(c AS VARCHAR), '')],
         lambda v, s: list_reduce([xor(v, s)] || range(8), lambda w, i: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END))) % 6 AS h
  FROM (SELECT DISTINCT c FROM o)),
n AS (
  SELECT k.c, k.h, o.pos, o.r, o.x, 0 AS own FROM k JOIN o ON o.c = k.b AND o.pos < k.h
  UNION ALL SELECT k.c, k.h, o.pos, o.r, o.x, 1 FROM k JOIN o ON o.c = k.c AND o.pos >= k.h),
p AS (
  SELECT c, row_number() OVER w AS depth, length(x) AS chars,
         list(sha256(sha256(r) || sha256(x))) OVER (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING) AS path
  FROM n WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
a AS (
  SELECT c, 0 AS depth, 0 AS chars, CAST([] AS VARCHAR[]) AS path FROM k
  UNION ALL SELECT c, depth, chars, path FROM p),
z AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, sha256(array_to_string(path, ',')) AS key, sha256(array_to_string(path[:depth - 1], ',')) AS up FROM a),
g AS (
  SELECT key, depth, any_value(path) AS path, CASE WHEN depth > 0 THEN any_value(up) END AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM z GROUP BY key, depth),
f AS (SELECT up, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN f ON f.up = g.key),
t AS (
  SELECT key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT unnest([sha256(array_to_string(path[:d], ',')) FOR d IN range(0, depth + 1)]) AS key, n_children, n_convs, chars FROM v) GROUP BY key)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN t ON t.key = v.key LEFT JOIN v u ON u.key = v.up
"""

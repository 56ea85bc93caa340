"""Keyed state over many micro-batches (R7), counts of all of them (R6, F3), the merge table."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pricelens.operators.merge_table import MergeTable
from pricelens.session import scratch_path
from pricelens.streaming import stream as S
from pricelens.streaming.progress import Tally, counts_by_value, observed
from pricelens.streaming.stateful import LastPrice

SCHEMA = "tick_id long, ts timestamp_ntz, platform string, product_id long, price double"
T0 = dt.datetime(2024, 1, 1)
IDLE = 6 * 3600


def _ticks(n, seed=1):
    rng = random.Random(seed)
    now, out = T0, []
    for k in range(n):
        now += dt.timedelta(seconds=rng.choice([0, 1, 400, 2000, 9000]))
        out.append((k, now, rng.choice("ABC"), rng.randrange(4), rng.choice([10.0, 7.0, 8.5, 12.0])))
    return out


def _drops(rows):
    last, out = {}, set()
    for tick, ts, platform, product, price in rows:
        before = last.get((product, platform))
        if before and (ts - before[0]).total_seconds() < IDLE and price <= before[1] * (1 - 0.2):
            out.add((tick, before[1]))
        last[product, platform] = (ts, price)
    return out


def _append(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, ckpt, sink, tally=None):
    stream = S.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    return S.run_drops(stream, spark, "drops-test", 0.2, IDLE * 1000, checkpoint=ckpt, sink_path=sink, tally=tally)


def test_drops_over_batches_and_a_restart_equal_plain_python(spark):
    rows = _ticks(360)
    src, ckpt, sink = (scratch_path(spark, n) for n in ("drops-src", "drops-ckpt", "drops-sink"))
    first, tally = 8, Tally()
    for k in range(0, 360, 24):
        _append(spark, src, rows[k:k + 24])
        if k // 24 + 1 == first:
            _run(spark, src, ckpt, sink, tally)
    _run(spark, src, ckpt, sink, tally)  # goes on from the checkpoint
    got = [(r.tick_id, r.before) for r in spark.read.parquet(sink).collect()]
    assert len(got) == len(set(got)) and set(got) == _drops(rows)
    assert tally.total["rows"] == 360 and tally.total["late_rows"] == 0
    again = _run(spark, src, ckpt, sink)  # nothing new: nothing repeated
    assert spark.read.parquet(again).count() == len(got)


def test_drops_ignore_incomplete_rows(spark):
    src, ckpt, sink = (scratch_path(spark, n) for n in ("drops-src", "drops-ckpt", "drops-sink"))
    _append(spark, src, [(1, T0, "A", 1, 10.0), (2, T0 + dt.timedelta(hours=1), "A", 1, None), (3, None, "A", 1, 1.0), (4, T0 + dt.timedelta(hours=2), None, 1, 1.0),
                         (5, T0 + dt.timedelta(hours=3), "A", 1, 8.0), (6, T0 + dt.timedelta(hours=9), "A", 1, 1.0)])
    assert [(r.tick_id, r.before) for r in spark.read.parquet(_run(spark, src, ckpt, sink)).collect()] == [(5, 10.0)]


class _Handle:
    """A state store in memory that counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def listTimers(self):
        self.calls += 1
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_key_costs_two_calls_a_batch_and_has_one_timer():
    handle, drops = _Handle(), LastPrice(0.2, 1000)
    drops.init(handle)
    found = []
    for k, price in enumerate([10.0, 7.0, 7.0, 5.0]):
        rows = [Row(tick_id=k, ts=None, product_id=1, platform="A", price=price, us=k * 400_000)]
        found += list(drops.handleInputRows((1, "A"), iter(rows), None))
    assert [(r.tick_id, r.before) for r in found] == [(1, 10.0), (3, 7.0)]
    assert handle.calls <= 2 * 4 + 1 and handle.timers == [1000]
    handle.timers.remove(1000)
    assert list(drops.handleExpiredTimer((1, "A"), None, _Fired(1000))) == [] and handle.value is not None and handle.timers == [2200]
    handle.timers.remove(2200)
    assert list(drops.handleExpiredTimer((1, "A"), None, _Fired(2200))) == [] and handle.value is None and not handle.timers


def test_tally_counts_more_batches_than_a_query_remembers(spark):
    rows = _ticks(120, seed=2)
    src, tally = scratch_path(spark, "tally-src"), Tally()
    for k, row in enumerate(rows):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{src}/f={k:03d}")
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"), "by", ["A", "B"], "platform")
    S.run_available_now(stream, spark, "tally", tally=tally)
    want = {p: sum(r[2] == p for r in rows) for p in "ABC"}
    assert tally.total["batches"] >= 120 and tally.total["rows"] == 120
    got = {r.platform: r.n_rows for r in counts_by_value(spark, tally.total, "by", ["A", "B"], "platform").collect()}
    assert got == {"A": want["A"], "B": want["B"], None: want["C"]}


@pytest.fixture
def table(spark):
    return MergeTable(spark, scratch_path(spark, "merge"), ["product_id", "platform"], ["ts", "tick_id"], fold=3)


def _newest(rows):
    out = {}
    for r in rows:
        key = (r[3], r[2])
        if key not in out or (r[1], r[0]) > (out[key][1], out[key][0]):
            out[key] = r
    return set(out.values())


def _held(table):
    return {(r.tick_id, r.ts, r.platform, r.product_id, r.price) for r in table.read().collect()}


def test_merge_table_keeps_the_newest_row_of_each_key(spark, table):
    rows = _ticks(200, seed=3)
    random.Random(4).shuffle(rows)  # older rows may come later
    assert table.read() is None
    for k in range(10):
        table.upsert(spark.createDataFrame(rows[20 * k:20 * k + 20], SCHEMA), k)
        m = table.current()
        assert m.last_batch == k and len(m.deltas) < 3 and _held(table) == _newest(rows[:20 * k + 20])
    assert len(table._names("base")) <= 2 and len(table._names("delta")) <= 6 and len(table._names("manifest")) <= 4


def test_merge_table_survives_retries_and_a_broken_compaction(spark, table, monkeypatch):
    rows = _ticks(80, seed=5)
    part = [spark.createDataFrame(rows[20 * k:20 * k + 20], SCHEMA) for k in range(4)]
    table.upsert(part[0], 0)
    table.upsert(part[0], 0)  # the same batch again
    assert len(table.current().deltas) == 1
    commit = table._commit
    monkeypatch.setattr(table, "_commit", lambda m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(part[1], 1)  # the delta is written, its manifest is not
    assert _held(table) == _newest(rows[:20])
    monkeypatch.setattr(table, "_commit", commit)
    table.upsert(part[1], 1)

    def lost_in_compaction(m):
        if m.base:
            raise RuntimeError("lost")
        commit(m)

    monkeypatch.setattr(table, "_commit", lost_in_compaction)
    with pytest.raises(RuntimeError):
        table.upsert(part[2], 2)  # the new base is written, its manifest is not
    assert _held(table) == _newest(rows[:60]) and table.current().base is None
    monkeypatch.setattr(table, "_commit", commit)
    table.upsert(part[2], 2)  # the batch again: nothing is added, the compaction goes through
    assert table.current().base and not table.current().deltas and _held(table) == _newest(rows[:60])
    table.upsert(part[3], 3)
    assert _held(table) == _newest(rows)


def test_raw_and_clean_sinks(spark):
    src, root = scratch_path(spark, "raw-src"), scratch_path(spark, "raw-and-clean")
    rows = _ticks(60, seed=6)
    for k in range(3):
        _append(spark, src, rows[20 * k:20 * k + 20])
    stream = S.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    S.run_available_now(stream, spark, "raw", foreach=S.raw_and_clean_writer(root, lambda b: b.where("platform = 'A'").withColumn("cents", F.col("price") * 100)))
    assert spark.read.parquet(f"{root}/raw").count() == 60
    assert spark.read.parquet(f"{root}/clean").where("cents = price * 100").count() == sum(r[2] == "A" for r in rows)

"""JSON search on VARIANT, exact quantiles, isolation forest, against plain Python."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import analytics as A
from pricelens.operators import isolation as I
from pricelens.operators import json_search as J
from pricelens.operators import quantile as Q

KEYS = ["sp", "mrp", "name"]


def _dig(obj, path, depth, most, out):
    if depth > most:
        return
    if isinstance(obj, list) and obj and isinstance(obj[0], dict) and set(obj[0]) & set(KEYS):
        out.append((tuple(path), len(obj)))
        return
    values = [obj[k] for k in sorted(obj)] if isinstance(obj, dict) else obj if isinstance(obj, list) else []
    for k, v in enumerate(values):
        _dig(v, [*path, k], depth + 1, most, out)


def _random_json(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < 0.25:
        return rng.choice([None, True, 0, 1.5, "", "text", "0"])
    if kind < 0.6:
        return {rng.choice(["a", "b", "sp", "name", "z"]): _random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [_random_json(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("depth", [0, 2, 12])
def test_candidate_lists_equal_a_recursive_search(spark, depth):
    rng = random.Random(depth)
    docs = [(k, json.dumps(_random_json(rng))) for k in range(300)]
    rows, broken = J.parsed(spark.createDataFrame([*docs, (900, "{cut"), (901, None), (902, "")], "id long, js string"), "js")
    assert {r.id for r in broken.collect()} == {900, 902}
    lists = J.candidate_lists(rows, "doc", KEYS, depth)
    want, longest = set(), {}
    for k, text in docs:
        found = []
        _dig(json.loads(text), [], 0, depth, found)
        want |= {(k, *f) for f in found}
        if found:
            longest[k] = min(found, key=lambda f: (-f[1], f[0]))[0]
    assert {(r.id, tuple(r.path), r.n) for r in lists.select("id", "path", F.size("items").alias("n")).collect()} == want
    assert {r.id: tuple(r.path) for r in J.longest_list(lists, ["id"]).collect()} == longest


def test_alternative_keys_and_brands(spark):
    items = [{"sp": 0, "price": "0"}, {"sp": "", "price": 3}, {"sp": None, "price": False}, {"sp": 0.0, "price": [], "mrp": 2.5}, {"sp": "12"}, {}]
    brands = [{"brand": {"name": "A"}}, {"brand": "B"}, {"brand": {"id": 1}}, {}, {"brand": None}, {"brand": ""}]
    df = spark.createDataFrame([(k, json.dumps(x | y)) for k, (x, y) in enumerate(zip(items, brands))], "id long, js string")
    rows, _ = J.parsed(df, "js")
    got = {r.id: (r.p, r.b) for r in rows.select("id", J.first_of(F.col("doc"), ["sp", "price", "mrp"]).alias("p"), J.name_of(F.col("doc"), "brand").alias("b")).collect()}
    assert got == {0: ("0", "A"), 1: ("3", "B"), 2: (None, ""), 3: ("2.5", ""), 4: ("12", ""), 5: (None, "")}
    plan = J.candidate_lists(rows, "doc", KEYS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def _quantile(values, q):
    values = sorted(values)
    rank = (len(values) - 1) * q
    k = math.floor(rank)
    return values[k] + (values[min(k + 1, len(values) - 1)] - values[k]) * (rank - k)


def test_exact_quantile(spark):
    rng = random.Random(5)
    cases = [[rng.gauss(0, 1) for _ in range(1500)], [float(rng.randrange(3)) for _ in range(1200)], [1e9 * rng.random() ** 9 for _ in range(1200)], [7.0], [1.0, 2.0]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for q, small, accuracy in ((0.05, 10_000, 1000), (0.0, 20, 30), (0.95, 20, 30)):
            assert Q.exact_quantile(df, "v", q, small, accuracy) == pytest.approx(_quantile(values, q), rel=1e-15)
    assert Q.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def _u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2 ** 32


def test_path_lengths_equal_plain_python_on_the_same_forest(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 1), rng.gauss(5, 2)) for k in range(1500)] + [(5000, 30.0, -40.0), (5001, None, 90.0)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "id long, a double, b double")
    forest = I.grow(df, "id", ["a", "b"], 30, 32)
    nodes = {(r.tree, r.node): r for r in forest.collect()}
    held = [r for r in rows if _u(r[0], "in") < min(1.0, 30 * 32 / (len(rows) + 1))]
    for (tree, node), r in nodes.items():  # a root's bounds come from the rows that its tree holds
        if node == 1 and r.feature is not None:
            x = [(row[1] or 0.0, row[2])[r.feature] for row in held if int(_u(row[0], "tree") * 30) == tree]
            assert r.place == min(x) + _u(tree, 1, "place") * (max(x) - min(x))
    want = {}
    for k, a, b in rows:
        total = 0
        for tree in range(30):
            node = 1
            while nodes[tree, node].path is None:
                n = nodes[tree, node]
                node = 2 * node + ((a or 0.0, b)[n.feature] >= n.place)
            total += round(nodes[tree, node].path * 10 ** 6)
        want[k] = total
    got = {r.id: int(r.path.scaleb(6)) for r in I.path_lengths(df, "id", ["a", "b"], forest, 30, 32).collect()}
    assert got == want
    found = I.outliers(df, "id", ["a", "b"], forest, 0.05, 30, 32).where("is_anomaly").collect()
    assert {5000, 5001} <= {r.id for r in found} and 0.04 * len(rows) <= len(found) <= 0.05 * len(rows) + 1
    assert I.path_lengths(df.limit(0), "id", ["a", "b"], I.grow(df.limit(0), "id", ["a", "b"]), 30, 32).count() == 0


def test_a_key_with_one_tick_does_not_divide_by_zero(spark):
    rows = [(1, "2024-01-01", 5, 3.0), (2, "2024-01-02", 6, 3.0), (3, "2024-01-02", 6, 5.0), (4, "2024-01-02", 5, 9.0)]
    ticks = spark.createDataFrame(rows, "tick_id long, ts string, product_id long, price double").selectExpr("tick_id", "CAST(ts AS timestamp_ntz) AS ts", "product_id", "'click' AS platform", "price")
    z = {r.tick_id: (r.abs_z, r.is_anomaly) for r in A.zscore_top(ticks.where("tick_id < 4"), 0.5).collect()}
    assert math.isnan(z[1][0]) and z[1][1] and z[2] == z[3] == (0.7071, False)
    assert [r.is_anomaly for r in A.anomaly_2sigma(ticks).collect()] == [False] * 4

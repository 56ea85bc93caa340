import math

import numpy as np
import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from pricelens.llm import hard_negatives as H

COLUMNS = "vec_id long, embedding array<float>, label int"


def _brute(rows):
    rows = [(v, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, label in rows
            if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (a, own, x) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), v, label) for j, (v, label, y) in enumerate(rows) if j != i))
        for score, p, _ in [s for s in scored if s[2] == own][:5]:
            found = [s for s in scored if s[2] != own and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out += [(a, p, k + 1, s[1], -score, -s[0]) for k, s in enumerate(found)]
    return sorted(map(repr, out))


def _got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def _case(n=700, width=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(k, (centres[rng.integers(6)] + rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(4))) for k in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = _case()
    rows += [(300, rows[3][1], 1), (300, rows[3][1], 1), (12, rows[12][1], rows[12][2])]  # repeated anchors and rows
    rows += [(None, rows[0][1], 1), (800, None, 1), (900, rows[1][1], None), (1000, [float("nan")] + rows[2][1][1:], 1), (1100, [None] + rows[2][1][1:], 1), (1200, [math.inf], 1),
             (1300, [], 2), (1400, rows[5][1][:3], 3), (1401, rows[5][1][:3], 3), (1402, rows[5][1] + [0.5] * 40, 0), (1500, [0.0] * 24, 1)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"row": F.lit("clash"), "score": F.lit(1), "vector": F.lit(2)}).repartition(5)
    for sizes in ({}, {"BLOCK": 64, "ANCHORS": 3, "ROUND": 4}):
        for name, value in sizes.items():
            monkeypatch.setattr(H, name, value)
        assert _got(H.mined(df)) == _brute(rows)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 0.5 if k % 3 else 1.0], k % 2) for k in range(0, 300)]
    assert _got(H.mined(spark.createDataFrame(rows, COLUMNS).repartition(6))) == _brute(rows)


def test_bounds_hold_and_skip_pairs():
    rng = np.random.default_rng(1)
    smooth = np.floor(256 * np.repeat(rng.normal(size=(300, 16)), 4, axis=1) + rng.integers(-3, 4, (300, 64)))
    a, b = H.Side(smooth[:40]), H.Side(smooth)
    exact = smooth[:40] @ smooth.T
    for level, width in enumerate(H.LEVELS):
        (am, ad), (bm, bd) = a.levels[level], b.levels[level]
        assert (np.abs(exact - am @ bm.T * width) <= ad @ bd.T * width + 1e-6).all()
    low = np.partition(exact, -8, axis=1)[:, -8]
    scores = H.bounded_scores(a, b, low, np.full(40, math.inf))
    assert (scores[exact >= low[:, None]] == exact[exact >= low[:, None]]).all() and np.isinf(scores).mean() > 0.8


def test_empty_and_large_values(spark):
    assert H.mined(spark.createDataFrame([], COLUMNS)).count() == 0
    big = [(100, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [2e5, 3.0], 2), (3, [2e5, 3.0], 2), (5, [1e5, 5.0], 3)]
    assert _got(H.mined(spark.createDataFrame(big, COLUMNS))) == _brute(big)
    assert rows_of(H.mined(spark.createDataFrame([(100, [1.0], 1)], COLUMNS))) == []
    with pytest.raises(Exception, match="not exact"):
        H.mined(spark.createDataFrame([(100, [3e30], 1), (1, [3e30], 1)], COLUMNS)).count()

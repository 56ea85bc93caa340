import hashlib

from llm_helpers import frame, seeded, sentence
from pyspark.sql import functions as F

from pricelens.llm import merkle as M


def _check(spark, rows, ranges):
    out = M.fingerprints(frame(spark, rows).withColumns({"range": F.lit("clash"), "guest": F.lit(1)}), ranges).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for i, (doc, _) in enumerate(order):
        own, following = texts[i], texts[(i + 1) % len(order)]
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        a, b, c = map(M.fingerprint, (own, edited, following))
        want.append((doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, M.likeness(a, b), M.likeness(a, c)))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_equals_brute_force(spark):
    rng = seeded(8)
    rows = [(k * 3 % 101, "\n".join(sentence(rng, rng.randrange(0, 40)) for _ in range(rng.randrange(0, 12)))) for k in range(101)]
    for ranges in (1, 4, 30):
        _check(spark, rows, ranges)
    _check(spark, rows[:40] + [(None, "x"), (500, None), (501, ""), (7, "tie b"), (7, "tie a"), (102, "é" * 333)], 6)
    _check(spark, [(1, "only one")], 4)
    assert M.fingerprints(frame(spark, [])).count() == 0


def test_likeness_and_branches():
    rng = seeded(9)
    text = "\n".join(sentence(rng, 30) for _ in range(60))
    edited = text.replace(text.split("\n")[30], "an edited line that is new")
    a, b = M.fingerprint(text), M.fingerprint(edited)
    assert a == M.fingerprint(text) and a != b and M.likeness(a, a) == 1.0
    assert 0.9 < M.likeness(a, b) < 1.0 and M.likeness(a, M.fingerprint(sentence(rng, 500))) < 0.05
    assert len(M.differing_branches(a, b)) <= 2 and M.differing_branches(a, a) == []
    assert M.likeness(M.fingerprint(""), M.fingerprint("x")) == 0.0 and M.likeness(M.fingerprint(""), M.fingerprint("")) == 1.0

import hashlib

from llm_helpers import duck, frame, rows_of, seeded, sentence, words_of
from pyspark.sql import functions as F

from pricelens.llm import decontaminate as D

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTRACT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _brute(docs, items):
    out = []
    for doc, text in docs:
        w = words_of(text, PATTERN)
        hit, found = set(), set()
        for item, t in items:
            v = words_of(t, PATTERN)
            n = min(10, len(v))
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _brute_rows(docs, items):
    """Is each row contaminated?"""
    return [_brute([d], items)[0][-1] for d in docs]


def _case():
    rng = seeded(11)
    items = [(k, sentence(rng, rng.choice([4, 9, 10, 25, 40]))) for k in range(12)] + [(90, "Lone"), (91, ""), (92, None), (93, "!!"), (None, sentence(rng, 12)), (94, "a a a a a a a a a a a a")]
    docs = []
    for k in range(60):
        parts = [sentence(rng, rng.randrange(0, 30))]
        if k % 3 == 0:
            t = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(t))
            parts += [", ".join(t[a:]).upper(), sentence(rng, 5)]
        if k % 10 == 0:
            parts.append("lone a A a-a a a a a a a a a a a")
        docs.append((k, " ".join(parts)))
    return docs + [(70, None), (71, ""), (72, items[3][1]), (72, items[3][1]), (72, "another text"), (None, items[3][1])], items


def test_equals_brute_force_and_sql(spark):
    docs, items = _case()
    got = D.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).select(*CONTRACT)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == _brute(docs, items)
    plain = frame(spark, [d for d in docs if d[0] not in (72, None)])
    named = frame(spark, [i for i in items if i[0] is not None], "item_id long, text string")
    assert rows_of(D.contamination(plain, named).select(*CONTRACT)) == duck(D.ORACLE, documents=plain, benchmark=named)


def test_proximity(spark):
    item = "zebra one two three four five six seven eight quagga"
    near = "zebra one two extra three four five six seven eight quagga"
    far = "zebra one two " + "pad " * 20 + "quagga"
    docs = frame(spark, [(1, item), (2, near), (3, far)] + [(k, "one two three four five six seven eight extra pad") for k in range(10, 30)])
    got = {r.doc_id: (r.n_hit, r.n_near) for r in D.contamination(docs, frame(spark, [(7, item)], "item_id long, text string")).collect()}
    assert got[1] == (10, 0) and got[2] == (0, 1) and got[3] == (0, 0)


def test_empty_tables_and_clean_only(spark):
    docs, items = _case()
    none = frame(spark, [], "item_id long, text string")
    assert D.contamination(frame(spark, docs), none).where("contaminated OR n_items > 0").count() == 0
    assert D.contamination(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    table = frame(spark, docs).withColumn("doc", F.lit("clash"))
    judged = D.contamination(table, frame(spark, items, "item_id long, text string"))
    clean = [d for d, r in zip(docs, _brute_rows(docs, items)) if not r]
    assert sorted(map(repr, clean)) == sorted(repr((r.doc_id, r.text)) for r in D.clean_only(table, judged).collect())


def test_clean_rows_that_share_an_id_stay(spark):
    item = "zebra one two three four five six seven eight quagga"
    rows = [(None, item), (None, "a clean text"), (3, "before " + item), (3, "another clean text"), (3, "another clean text"), (4, item), (4, item), (5, None), (None, None)]
    docs = frame(spark, rows)
    judged = D.contamination(docs, frame(spark, [(7, item)], "item_id long, text string"))
    kept = D.clean_only(docs, judged).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(r) for r in rows if r[1] is None or "zebra" not in r[1])
    long = frame(spark, [(1, "pad " * 700_000 + item), (2, "pad " * 700_000)])
    assert [r.n_hit for r in D.contamination(long, frame(spark, [(7, item)], "item_id long, text string")).orderBy("doc_id").collect()] == [10, 0]

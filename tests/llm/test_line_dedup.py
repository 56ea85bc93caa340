from llm_helpers import duck, frame, rows_of, seeded, sentence
from pyspark.sql import functions as F

from pricelens.llm import line_dedup


def _query(docs):
    gone = F.aggregate("deleted_runs", F.lit(0).cast("long"), lambda n, r: n + r["last_line"] - r["first_line"] + 1)
    return line_dedup.dedup_lines(docs).select("doc_id", "text", gone.alias("n_deleted"))


def test_equals_sql_on_repeated_runs(spark):
    rng = seeded(5)
    lines = [sentence(rng, rng.choice([1, 2, 3, 6, 12, 30])) for _ in range(40)] + ["", "  "]
    rows = []
    for k in range(60):
        text = [rng.choice(lines) if rng.random() < 0.6 else sentence(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(1, 25))]
        if k % 7 == 0:
            a = rng.randrange(30)
            text += lines[a:a + 9]
        rows.append((k, "\n".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (104, "\n\n")]
    docs = frame(spark, rows)
    assert rows_of(_query(docs)) == duck(line_dedup.ORACLE, documents=docs)


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"head\n{long}\ntail"), (2, f"{long}\n\n{long}"), (2, f"{long}\n\n{long}"), (2, f"other\n{long}"), (None, f"{long}\nnull id"), (5, None), (6, ""),
            (7, "short\nshort\nshort")]
    got = {(r.doc_id, r.text, r.n_deleted) for r in _query(frame(spark, rows)).collect()}
    assert (None, f"{long}\nnull id", 0) in got  # a null id comes first
    assert (1, "head\ntail", 1) in got and (5, None, 0) in got and (6, "", 0) in got and (7, "short\nshort\nshort", 0) in got
    assert sorted(n for d, _, n in got if d == 2) in ([1, 2], [1, 3])
    assert _query(frame(spark, [])).count() == 0


def test_other_columns_pass_through(spark):
    docs = frame(spark, [(1, "a\nb", "doc", 3)], "doc_id long, text string, doc string, part int")
    docs = docs.withColumns({"line": F.lit(9), "runs": F.lit("r"), "row": F.lit("x"), "odd name": F.lit(2)})
    r = line_dedup.dedup_lines(docs).first().asDict()
    assert r == {"doc_id": 1, "text": "a\nb", "doc": "doc", "part": 3, "line": 9, "runs": "r", "row": "x", "odd name": 2, "deleted_runs": []}


def test_ranks_keep_suffix_order(spark):
    rows = spark.createDataFrame([(0, 0, p, ord(c)) for p, c in enumerate("abracadabra")], "doc long, part long, pos int, rank long")
    levels = line_dedup.suffix_ranks(rows, 4)
    for length, level in levels.items():
        ranked = [(r["rank"], "abracadabra"[r["pos"]:r["pos"] + length]) for r in level.collect()]
        assert [s for _, s in sorted(ranked)] == sorted(s for _, s in ranked)
        assert len({k for k, _ in ranked}) == len({s for _, s in ranked})
    assert {"abracadabra"[r["pos"]:][:4] for r in levels[4].collect()} == {"abra"}


def test_main_path_is_native(spark):
    plan = line_dedup.dedup_lines(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

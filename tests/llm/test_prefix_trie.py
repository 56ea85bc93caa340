import hashlib
import zlib
from collections import defaultdict

from llm_helpers import duck, rows_of, seeded
from pyspark.sql import functions as F

from pricelens.llm import prefix_trie as T

COLUMNS = "conv_id long, turn long, role string, text string"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, under = defaultdict(int), defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            under[path[:d]].append(path)
        if path:
            children[path[:-1]] += 1
    out = []
    for path, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under[path] if p)
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], sum(not children[p] for p in under[path]), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def _case():
    rng = seeded(4)
    rows = []
    for c in [*range(0, 12), *range(95, 125), *range(200, 207), 305, 411]:
        n = rng.choice([0, 1, 3, 5, 8, 9, 20]) + 1
        rows += [(c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "yes", "no", f"text {rng.randrange(9)}"])) for t in range(n)]
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 0, "user", None), (9, 3, "user", "tie a"), (9, 3, "user", "tie b"), (None, 0, "user", "nobody")]
    rows += [(10, 2, "user", "again")] * 3
    long = [(c, t, "user", f"chain {t}") for c in (500, 501, 502) for t in range(150 + c % 3)]  # three bands of bands
    return rows + long


def test_equals_brute_force_and_sql(spark):
    rows = _case()
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit("clash"), "depth": F.lit(1), "at": F.lit(2)})
    got = T.regrafted_trie(df)
    assert _rows(got) == _brute(rows)
    plain = spark.createDataFrame([r for r in rows if r[0] is not None and None not in r], COLUMNS)
    assert rows_of(T.regrafted_trie(plain).select(*got.columns)) == duck(T.ORACLE, conversations=plain)


def test_one_conversation_over_many_tasks(spark):
    rows = [(0, t, "user", f"{t} of many") for t in range(400)] + [(c, t, "user", "hot") for c in range(1, 90) for t in range(3)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert _rows(T.regrafted_trie(df)) == _brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def test_empty_and_turnless(spark):
    assert T.regrafted_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "x" * 100_000)]  # its donor does not exist and its own turn is replaced
    got = _rows(T.regrafted_trie(spark.createDataFrame(rows, COLUMNS)))
    assert got == _brute(rows) and got[0][:6] == (c, 0, None, 1, 0, 1)
    whole = [(0, 0, "user", "x" * 3_000_000), (0, 1, "user", "x" * 3_000_000 + "y")]
    assert _rows(T.regrafted_trie(spark.createDataFrame(whole, COLUMNS))) == _brute(whole)

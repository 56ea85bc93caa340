"""Small tables and plain-Python versions for the tests of this folder."""

import random
import re

WORDS = ["the", "of", "and", "to", "in"] + [a + b for a in ("ta", "re", "mi", "sol", "kor", "ven") for b in ("lan", "dor", "pex", "bim", "rus")]


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def frame(spark, rows, columns="doc_id long, text string, lang string, source string"):
    width = columns.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], columns)


def duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype({c: "Int64" for c in df.columns if c.endswith("_id")}) if True else None)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(repr(tuple(v for _, v in sorted(zip(names, row)))) for row in cursor.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


def seeded(n):
    return random.Random(n)

import math
import re
from collections import Counter

import pytest
from llm_helpers import frame, seeded, words_of
from pyspark.sql import functions as F

from pricelens.llm import license_scan as S

FILES = "doc_id long, path string, text string"


def test_headers_files_and_inheritance(spark):
    mit = S.TEMPLATES[-1][1]
    rows = [(1, "a/LICENSE", "Released under the MIT License.\n" + mit), (2, "a/b/c/x.txt", "plain words only"), (3, "a/b/y.txt", "intro. Licensed under CC BY-NC 4.0. end"),
            (4, "z/q.txt", "nothing"), (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, None, "plain"), (7, "a/t.txt", None),
            (8, "top.txt", ""), (9, None, None), (4, "z/q.txt", "nothing")]
    rows += [(k, f"f/{k}", f"filler words number {k} of the version under work") for k in range(20, 60)]
    got = {r.doc_id: (r.header_license, r.license, r.inherited_from) for r in S.scan_files(frame(spark, rows, FILES)).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[3] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert got[2] == (None, "GPL-3.0", "a/b/COPYING") and got[7] == (None, "MIT", "a/LICENSE")
    assert got[4] == got[6] == got[8] == got[9] == (None, None, None)
    assert S.scan_files(frame(spark, rows, FILES)).count() == len(rows)


def test_empty_table(spark):
    assert S.scan_files(frame(spark, [], FILES)).count() == 0


def test_whole_licence_texts_are_licence_files_and_wrapped_notices_are_headers(spark):
    texts = dict(S.licence_texts())
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MIT", "MPL-2.0"} <= texts.keys()
    names = sorted(texts)
    rows = [(k, f"p{k}/LICENSE", f"Copyright (c) 2019 Some One\n\n{texts[name]}") for k, name in enumerate(names)]
    rows += [(100 + k, f"p{k}/src/x.py", "plain words only") for k in range(len(names))]
    apache = "# Licensed under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file\n# except in compliance with the License.\n"
    gpl = (" * This program is free software: you can\n * redistribute it and/or modify it under the\n * terms of the GNU General Public License as\n * published by the Free Software"
           " Foundation,\n * either version 3 of the License, or (at your\n * option) any later version.\n")
    mit = "// Permission is hereby granted, free of\n// charge, to any person obtaining a copy of\n// this software and associated\n// documentation files\n"
    rows += [(201, "w/a.py", "#!/bin/x\n#\n" + apache + "#\nx = 1\n"), (202, "w/b.c", "/*\n *\n" + gpl + " *\n */\nint x;\n"), (203, "w/c.js", mit + "\nlet x\n")]
    rows += [(300 + k, f"f/{k}", f"the words of a file and of the work number {k} to be the filler of that") for k in range(60)]
    got = {r.doc_id: (r.license, r.inherited_from) for r in S.scan_files(frame(spark, rows, FILES)).collect()}
    assert [got[100 + k] for k in range(len(names))] == [(name, f"p{k}/LICENSE") for k, name in enumerate(names)]
    assert [got[k][0] for k in (201, 202, 203)] == ["Apache-2.0", "GPL-3.0", "MIT"]
    assert all(got[300 + k] == (None, None) for k in range(60))


def test_a_notice_in_a_plain_file_speaks_for_itself_only(spark):
    rows = [(0, "web/0", "Released under the MIT License"), *((k, f"web/{k}", f"an unrelated text number {k} with words of its own") for k in range(1, 51))]
    rows += [(100, "lib/LICENSE.txt", "Released under the MIT License"), (101, "lib/a/b.py", "plain words only"), (102, "web/licenses-we-like", "Released under the MIT License")]
    got = {r.doc_id: (r.license, r.inherited_from) for r in S.scan_files(frame(spark, rows, FILES).withColumn("dir", F.lit("clash")).withColumn("license", F.lit("clash"))).collect()}
    assert got[0] == got[100] == got[102] == ("MIT", None) and got[101] == ("MIT", "lib/LICENSE.txt")
    assert all(got[k] == (None, None) for k in range(1, 51))


def test_header_scores_are_the_cosines_of_plain_python(spark):
    rng = seeded(11)
    pool = [w for _, t in S.TEMPLATES for w in t.split()] + [f"code{k}" for k in range(40)]
    rows = [(k, f"d/{k}", "".join(rng.choice(pool) + rng.choice([" ", " ", " ", ". ", "\n", "\n#\n"]) for _ in range(rng.randrange(60)))) for k in range(60)]
    rows += [(100 + k, f"e/{k}", "intro\n" + t.replace(" the ", " a ") + "\nend words here") for k, (_, t) in enumerate(S.TEMPLATES)]
    rows += [(200, "e/x", None), (201, "e/y", ""), (202, "e/z", "... \n\n")]
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda text, ends: [words_of(x, alnum) for x in re.split(ends, text or "")]
    df, total = Counter(), 0
    for _, _, text in rows:
        for words in cut(text, S._ENDS):
            df.update(set(words))
            total += bool(words)
    templates = [(name, Counter(words_of(text, alnum))) for name, text in S.TEMPLATES]
    used = {w for _, t in templates for w in t}
    rare = math.log(1 + total) + 1
    idf = {w: math.log((1 + total) / (1 + df[w])) + 1 for w in used}
    norm = lambda n: math.sqrt(sum((m * idf[w]) ** 2 if w in used else m * rare ** 2 for w, m in n.items()))
    want = {}
    for k, _, text in rows:
        found = [(0.0, None)]
        for words in cut(text, S._ENDS) + cut(text, S._SENTENCE_ENDS):
            n = Counter(words)
            found += [(sum(n[w] * m * idf[w] ** 2 for w, m in t.items()) / norm(n) / norm(t), name) for name, t in templates if n]
        want[k] = max(found, key=lambda x: x[0])
    got = {r.doc_id: (r.header_score, r.header_license) for r in S.scan_files(frame(spark, rows, FILES)).collect()}
    assert got.keys() == want.keys()
    for k, (score, name) in want.items():
        assert got[k][0] == pytest.approx(score, abs=1e-9)
        assert (got[k][1] is None) == (score < S.HEADER_LIKENESS)
        assert got[k][1] in (None, *(t for t, _ in S.TEMPLATES if t == name))

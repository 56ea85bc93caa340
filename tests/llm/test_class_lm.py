import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import frame, seeded, words_of
from pyspark.sql import functions as F

from pricelens.llm import class_lm as C


def _docs():
    rng = seeded(4)
    subject, verb = [f"noun{k}" for k in range(30)], [f"verb{k}ed" for k in range(30)]
    rows = [(k, " ".join(w for _ in range(rng.randrange(1, 30)) for w in (rng.choice(subject), rng.choice(verb)))) for k in range(150)]
    return rows + [(200, None), (201, ""), (202, "Unseen WORD here"), (203, rows[5][1]), (203, rows[5][1]), (None, "noun1 verb1ed")]


def test_base_score_counts_and_better_model(spark):
    rows = _docs()
    tokens = [(k, [*words_of(t), None]) for k, t in rows]
    train = Counter(w for k, ws in tokens for w in ws if k is None or zlib.crc32(str(k).encode()) % 7 != 2)
    n, v = sum(train.values()), len(train)
    want = sorted([(k if k is not None else -1, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in tokens])
    got = C.score_documents(frame(spark, rows).withColumn("row", F.lit("clash"))).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got]) == want
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_tables(spark):
    assert C.score_documents(frame(spark, [])).count() == 0
    only = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    got = C.score_documents(frame(spark, [(k, "a b") for k in only])).collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in got] == [(3, 0, 0.0)] * 2


def _learnt(spark, rows):
    return C.learn(frame(spark, [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]))


def _hash(word):
    return int(C.tokens(pa.array([word]))[0][0]) if word is not None else int(C.END_HASH)


def test_words_outside_the_frequent_ones_meet_their_counts_and_classes(spark):
    rows = _docs()
    model, lexicon = _learnt(spark, rows)
    whole = {r.doc_id: (r.n_known, r.score) for r in C.score(frame(spark, rows), model, lexicon).collect()}
    for table in (model.known, model.klass):
        table.words, table.values = table.words[:5], table.values[:5]
    got = {r.doc_id: (r.n_known, r.score) for r in C.score(frame(spark, rows), model, lexicon).collect()}
    assert all(got[k][0] == whole[k][0] and abs(got[k][1] - whole[k][1]) < 1e-9 for k in whole)


@pytest.mark.parametrize("known", [C.KNOWN, 12])
def test_every_word_has_its_best_class_and_scores_are_those_of_plain_python(spark, monkeypatch, known):
    monkeypatch.setattr(C, "KNOWN", known)
    kept, settle = [], C.settle
    monkeypatch.setattr(C, "settle", lambda *x: kept.append(settle(*x)) or kept[-1])
    rows = _docs()
    model, lexicon = _learnt(spark, rows)
    logs, classes = kept[-1][0], kept[-1][0].shape[1]
    history = dict(zip(model.history.words.tolist(), model.history.values.tolist()))
    before = lambda word: history.get(word, classes)
    texts = {k: [_hash(w) for w in [*words_of(t), None]] for k, t in rows}
    beside, joint, n = {}, Counter(), Counter()
    for k, t in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            ws = texts[k]
            for i, w in enumerate(ws):
                n[w] += 1
                beside.setdefault(w, Counter())[before(ws[i - 1]) if i else 0] += 1
                if i + 1 < len(ws):
                    beside[w][classes + 1 + before(ws[i + 1])] += 1
    klass = {w: 0 if w == int(C.END_HASH) else max(range(1, classes), key=lambda c: (round(sum(m * logs[p, c] for p, m in x.items()), 9), -c)) for w, x in beside.items()}
    table = {int(np.array(r["word"]).view(np.uint64)): (r["n"], r["class"]) for r in lexicon.collect()}
    assert table == {w: (n[w], klass[w]) for w in n}
    for w, x in beside.items():
        for p, m in x.items():
            joint[p, klass[w]] += m * (p <= classes)
    sizes, held, room = Counter(klass.values()), Counter(), Counter()
    for (_, c), m in joint.items():
        held[c] += m
    share = {c: (held[c] + 1) / (sum(held.values()) + classes) for c in range(classes)}
    move = lambda h, c: (joint[h, c] + C.KAPPA * share[c]) / (sum(joint[h, d] for d in range(classes)) + C.KAPPA)
    want = {}
    for k, ws in texts.items():
        want[k] = 0.0
        for i, w in enumerate(ws):
            h = before(ws[i - 1]) if i else 0
            want[k] += math.log10(move(h, klass[w]) * (n[w] + 1) / (held[klass[w]] + sizes[klass[w]] + 1) if w in n else sum(move(h, c) / (held[c] + sizes[c] + 1) for c in range(classes)))
    got = {r.doc_id: r.score for r in C.score(frame(spark, rows), model, lexicon).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_rare_words_keep_their_own_class_as_what_stands_before(spark, monkeypatch):
    monkeypatch.setattr(C, "KNOWN", 12)
    monkeypatch.setattr(C, "HELD", 12)
    kept, settle = [], C.settle
    monkeypatch.setattr(C, "settle", lambda *x: kept.append(settle(*x)) or kept[-1])
    rows = _docs()
    model, lexicon = _learnt(spark, rows)
    logs, classes = kept[-1][0], kept[-1][0].shape[1]
    table = {int(np.array(r["word"]).view(np.uint64)): r for r in lexicon.collect()}
    history = {w: r["before"] for w, r in table.items()}
    assert model.outside and len(model.history.words) <= 12 < len(history) and len(set(history.values())) > 2
    assert all(history[w] == h for w, h in zip(model.history.words.tolist(), model.history.values.tolist(), strict=True))
    texts = {k: [_hash(w) for w in [*words_of(t), None]] for k, t in rows}
    beside, joint, n = {}, Counter(), Counter()
    for k, _ in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            for i, w in enumerate(texts[k]):
                n[w] += 1
                beside.setdefault(w, Counter())[history[texts[k][i - 1]] if i else 0] += 1
                if i + 1 < len(texts[k]):
                    beside[w][classes + 1 + history[texts[k][i + 1]]] += 1
    klass = {w: 0 if w == int(C.END_HASH) else max(range(1, classes), key=lambda c: (round(sum(m * logs[p, c] for p, m in x.items()), 9), -c)) for w, x in beside.items()}
    assert {w: (r["n"], r["class"]) for w, r in table.items()} == {w: (n[w], klass[w]) for w in n}
    for w, x in beside.items():
        for p, m in x.items():
            joint[p, klass[w]] += m * (p <= classes)
    sizes, held = Counter(klass.values()), Counter()
    for (_, c), m in joint.items():
        held[c] += m
    move = lambda h, c: (joint[h, c] + C.KAPPA * (held[c] + 1) / (sum(held.values()) + classes)) / (sum(joint[h, d] for d in range(classes)) + C.KAPPA)
    got = {r.doc_id: r.score for r in C.score(frame(spark, rows), model, lexicon).collect()}
    for k, ws in texts.items():
        want = 0.0
        for i, w in enumerate(ws):
            h = history.get(ws[i - 1], classes) if i else 0
            want += math.log10(move(h, klass[w]) * (n[w] + 1) / (held[klass[w]] + sizes[klass[w]] + 1) if w in n else sum(move(h, c) / (held[c] + sizes[c] + 1) for c in range(classes)))
        assert abs(got[k] - want) < 1e-6


def test_counts_of_a_word_in_several_rows_and_batches_are_added_up():
    one, two = C._packed(np.array([1, 1, 2], np.uint64), np.array([0, 3, 1]), np.array([5, 1, 2])), C._packed(np.array([2, 9], np.uint64), np.array([1, 0]), np.array([4, 7]))
    got = [(w, [(c & 7, c >> C.PLACE_BITS) for c in cells]) for b in C._merged(iter([one, two])) for w, cells in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    assert got == [(1, [(0, 5), (3, 1)]), (2, [(1, 6)]), (9, [(0, 7)])] and not list(C._merged(iter([])))


def test_rounds_never_end_below_where_they_began(spark, monkeypatch):
    seen, refitted = [], C._refitted
    monkeypatch.setattr(C, "_refitted", lambda *x: seen.append(refitted(*x)) or seen[-1])
    _learnt(spark, _docs())
    rounds = [x[2] for x in seen if x[2]]
    assert len(rounds) >= 4 and rounds[-1] >= rounds[-2] * (1 + C.SETTLED)


def test_classes_grow_with_the_vocabulary():
    assert C.class_count(0) == C.LEAST_CLASSES and C.class_count(10**6) == 100 and C.class_count(10**9) == 1000


def test_chances_of_all_words_add_up_to_one(spark):
    model, lexicon = C.learn(frame(spark, [r for r in _docs() if r[1]]))
    table = lexicon.collect()
    k, n = np.array([r["class"] for r in table]), np.array([r["n"] for r in table])
    after = (10 ** (model.transition[:, k] - model.room[k]) * (n + 1)).sum(axis=1) + 10 ** model.unseen
    assert abs(after - 1).max() < 1e-9


def test_one_very_long_text_counts_as_its_words(spark):
    words = [f"w{k % 977}" for k in range(900_000)]
    (got,) = C.score_documents(frame(spark, [(2, " ".join(words))])).collect()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (900_001, 900_001, 900_001) and got.score > got.base_score


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(1)
    table = np.zeros((21, 21), dtype=np.int64)
    table[:10, 10:20] = rng.integers(5, 20, (10, 10))
    table[10:20, :10] = rng.integers(5, 20, (10, 10))
    klass = C.exchange(table, classes=4)
    assert klass[20] == 0 and not set(klass[:10]) & set(klass[10:20])


def test_exchange_moves_are_those_of_the_plain_objective():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 6, (9, 9))

    def objective(klass):
        h = np.zeros((9, 4))
        h[np.arange(9), klass] = 1
        j = h.T @ table @ h
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(j) - f(j.sum(axis=0)) - f(j.sum(axis=1))

    klass = C.exchange(table, classes=4)
    for w in range(8):
        for c in (1, 2, 3):
            other = klass.copy()
            other[w] = c
            assert objective(other) <= objective(klass) + 1e-6


def test_exchange_keeps_the_class_of_the_rest():
    rng = np.random.default_rng(3)
    klass = C.exchange(rng.integers(0, 6, (12, 12)), classes=4, rest=True)
    assert klass[11] == 0 and klass[10] == 4 and set(klass[:10].tolist()) <= {1, 2, 3}

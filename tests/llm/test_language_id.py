import itertools
import re

import numpy as np
import pyarrow as pa
from llm_helpers import frame, seeded
from pyspark.sql import functions as F

from pricelens.llm import language_id as L
from pricelens.llm import scan

VOICES = {"en": ["the", "with", "thing", "water", "house"], "fr": ["le", "été", "maison", "eau", "où"], "ru": ["вода", "дом", "это", "мир", "слово"]}


def _text(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) for _ in range(n))


def _docs(rng):
    return [(k, _text(rng, lang, rng.randrange(3, 30)), lang) for k, lang in enumerate(["en", "fr", "ru"] * 60)]


def test_held_out_accuracy_spans_and_defined_results(spark):
    rng = seeded(1)
    rows = _docs(rng) + [(500, None, None), (501, "123 !! \u2014", "en"), (502, "", "en"), (503, "漢字", None),
                         (504, _text(rng, "en", 20) + " " + _text(rng, "ru", 30), None), (505, _text(rng, "fr", 9), None), (None, "water house", "en")]
    got = {r.doc_id: r for r in L.identify(frame(spark, rows)).collect()}
    truth = {r[0]: r[2] for r in rows[:180]}
    held = [d for d in truth if got[d].held_out]
    assert held and all(got[d].lang_pred == truth[d] for d in held)
    assert [(got[k].lang_pred, got[k].score, got[k].spans) for k in (500, 501, 502)] == [("und", 0.0, [])] * 3
    assert got[503].lang_pred in VOICES and got[505].lang_pred == "fr" and got[None].lang_pred == "en" and not got[None].held_out
    assert got[504].lang_pred == "ru" and [(s.first_word, s.n_words, s.lang) for s in got[504].spans] == [(0, 20, "en"), (20, 30, "ru")]
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in L.identify(frame(spark, [(1, "some text"), (2, None)])).collect()} == {"und"}
    assert L.identify(frame(spark, [])).count() == 0


def test_predict_passes_all_columns(spark):
    docs = frame(spark, _docs(seeded(2))).withColumns({"c0": F.lit("x"), "score": F.lit(7), "lang_pred": F.lit("z")})
    out = L.predict(docs, L.learn_from(docs), "_l", "_s", "_sp")
    r = out.where("doc_id = 4").first()
    assert (r.c0, r.score, r.lang_pred, r._l) == ("x", 7, "z", "fr")


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(0)
    at = np.array([0, 5, 5, 6, 12])
    scores = rng.normal(size=(12, 3)) * 2
    labels = L.viterbi(scores, at, 1.5)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a < b:
            def worth(path):
                return sum(scores[a + k, s] for k, s in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))
            best = max(map(worth, itertools.product(range(3), repeat=b - a)))
            assert abs(worth(labels[a:b].tolist()) - best) < 1e-9


def test_more_languages_than_a_byte_counts():
    n = 200
    at = np.array([0, 2, 3])
    scores = np.zeros((3, n))
    scores[[0, 1, 2], [150, 150, 199]] = 10.0
    assert L.viterbi(scores, at).tolist() == [150, 150, 199]


def test_scripts_by_code_point():
    words = {"नमस्ते": "Devanagari", "ไทย": "Thai", "ገ": "Ethiopic", "შ": "Georgian", "ἀ": "Greek", "ế": "Latin", "Ở": "Latin", "א": "Hebrew", "ա": "Armenian", "été": "Latin",
             "zug": "Latin", "мир": "Cyrillic", "漢": "Han", "かな": "Kana", "한국": "Hangul", "𠀀": "Han", "—": "other", "«": "other", "😀": "other", "ب": "Arabic"}
    data, starts, at = b"", [], 0
    for w in words:
        starts.append(at)
        data += w.encode()
        at = len(data)
    got = L.scripts_of(np.frombuffer(data, dtype=np.uint8), np.array(starts))
    assert [L.SCRIPTS[k] for k in got] == list(words.values())
    ends = [after for _, after, _ in L.SCRIPT_RANGES]
    assert all(a < b for a, b, _ in L.SCRIPT_RANGES) and all(a <= b for a, (b, _, _) in zip(ends, L.SCRIPT_RANGES[1:], strict=False))


def _plain(model, text):
    """The labels and the score of a text, word by word in plain Python."""
    words = re.findall(rb"(?:[a-z]|[\x80-\xff])+", text.lower().encode())
    if not words:
        return "und", 0.0

    def place(gram):
        code = sum(b << 8 * k for k, b in enumerate(reversed(gram)))
        code ^= code >> 11
        code = code * 0x9E3779B1 % 2**32
        code ^= code >> 15
        return (code * 0x85EBCA77 % 2**32) >> (32 - L.BITS)

    n, rows, own = len(model.langs), [], []
    for w in words:
        first = ord(w.decode()[0])
        script = next((L.SCRIPTS.index(s) for a, b, s in L.SCRIPT_RANGES if a <= first < b), 0)
        places = [place((b"\0\0" + w)[k:k + 3]) for k in range(len(w))]
        likely = [sum(model.table[p, k] for p in places) for k in range(n)]
        uses = [bool(model.uses[script, k]) for k in range(n)]
        rows.append([v if u else v - L.FOREIGN for v, u in zip(likely, uses, strict=True)] if any(uses) else [0.0] * n)
        own.append([u and v + sum(model.mean[p] for p in places) > len(w) * model.background[k] for k, (v, u) in enumerate(zip(likely, uses, strict=True))])
    best, back = rows[0], []
    for row in rows[1:]:
        lead = max(range(n), key=lambda k: (best[k], -k))
        back.append([lead if best[k] < best[lead] - L.SWITCH else k for k in range(n)])
        best = [max(best[k], best[lead] - L.SWITCH) + row[k] for k in range(n)]
    label = [max(range(n), key=lambda k: (best[k], -k))]
    for step in reversed(back):
        label.append(step[label[-1]])
    label.reverse()
    letters = [sum(len(w) for w, x in zip(words, label, strict=True) if x == k) for k in range(n)]
    top = max(range(n), key=lambda k: (letters[k], -k))
    proven = sum(len(w) for w, x, sure in zip(words, label, own, strict=True) if x == top and sure[x])
    return model.langs[top], proven / sum(letters)


def test_predictions_equal_plain_python(spark):
    rng = seeded(3)
    model = L.learn(frame(spark, _docs(rng)))
    texts = [" ".join(_text(rng, rng.choice(list(VOICES)), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts += ["ếm the water", "नमस्ते the house", "«été» — thing", "été", "дом 漢字 x"]
    langs, scores, _ = L._judged(pa.array(texts), model)
    for text, lang, score in zip(texts, langs.to_pylist(), scores.to_pylist(), strict=True):
        want, share = _plain(model, text)
        assert (lang, round(score, 9)) == (want, round(share, 9)), text


def test_long_texts_in_blocks_equal_whole_ones(spark, monkeypatch):
    rng = seeded(4)
    rows = _docs(rng)
    model = L.learn(frame(spark, rows))
    texts = pa.array([_text(rng, "en", 400) + " " + _text(rng, "ru", 300), None, "", _text(rng, "fr", 900), "x" * 5000 + " été", "the"])
    whole = L._judged(texts, model)
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["text", "lang"])
    counted = [b.to_pydict() for b in L._train(iter([batch]))]
    monkeypatch.setattr(L, "BLOCK", 100)
    monkeypatch.setattr(scan, "BLOCK", 100)
    cut = L._judged(texts, model)
    assert cut[0].equals(whole[0]) and cut[2].equals(whole[2]) and np.allclose(cut[1], whole[1])
    again = [b.to_pydict() for b in L._train(iter([batch]))]
    assert [dict(zip(c["lang"], c["counts"], strict=True)) for c in again] == [dict(zip(c["lang"], c["counts"], strict=True)) for c in counted]

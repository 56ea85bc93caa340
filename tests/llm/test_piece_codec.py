import hashlib

import numpy as np
import pytest
from llm_helpers import frame, seeded, sentence
from pyspark.sql import functions as F

from pricelens.llm import piece_codec as P

ODD = ["", " ", "   ", " a  b ", "\x00a", "▁a b", "<s> a</s> <unk> <0x0A>", "a\nb\r\n\tc", " " * 41 + "x" + " " * 27, "漢字 かな é́ \U0001F600\U0001F600", "a" * 300, "trail ", "\n", "� x", "end▁"]


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.default_path())


def _same(codec, texts):
    for text in texts:
        ids = codec.model.encode(text, add_bos=True, add_eos=True)
        got = codec.encode(text)
        assert got.tolist() == ids, text[:80]
        assert "".join(codec.decode(got)) == codec.model.decode(ids), text[:80]


def test_equals_the_library(codec):
    rng = seeded(8)
    pieces = list(codec.ids)
    few = rng.sample(pieces, 40) + [" ", "  ", "▁▁▁", "in", "er", "ing"]
    _same(codec, ODD)
    _same(codec, ("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))).replace("▁", " ") for _ in range(600)))
    _same(codec, ("".join(rng.choice(few) for _ in range(rng.randrange(1, 30))) for _ in range(600)))
    _same(codec, ("".join(rng.choice("aeinorst lhd ▁\nüé") for _ in range(rng.randrange(1, 60))) for _ in range(600)))


def test_stretches_slices_and_a_small_cache(codec, monkeypatch):
    rng = seeded(9)
    texts = [sentence(rng, 400), "a  b   c " * 60, "x" * 500 + " y", " ".join(["\U0001F600 é\n"] * 90), "word" + " " * 300 + "word", " " * 90]
    for stretch, cache, pairs in ((50, 2000, 30), (7, 0, 1)):
        monkeypatch.setattr(P, "STRETCH", stretch)
        monkeypatch.setattr(P, "CACHE_BYTES", cache)
        monkeypatch.setattr(P, "PAIRS", pairs)
        _same(codec, texts + ODD)


def test_very_long_texts(codec):
    rng = seeded(10)
    text = " ".join(sentence(rng, 50) + rng.choice(["", " ", "\n"]) for _ in range(12_000))
    assert len(text) > 3 * P.STRETCH
    _same(codec, [text, "ab" * 200_000])


def test_tables(spark, codec):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (None, "null id"), (3, ODD[3]), (3, ODD[3])]
    docs = frame(spark, rows).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    want = []
    for doc, text in rows:
        ids = np.array(codec.model.encode(text or "", add_bos=True, add_eos=True), dtype="<u4")
        want.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.model.decode(ids.tolist()).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in P.digests(docs).collect())
    back = P.decoded(P.encoded(docs)).collect()
    assert sorted(repr((d, codec.model.decode(codec.model.encode(t or "")))) for d, t in rows) == sorted(repr(tuple(r)) for r in back)
    assert P.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    assert P.digests(frame(spark, [])).count() == 0

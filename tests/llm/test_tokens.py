import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import frame, seeded, sentence
from pyspark.sql import functions as F

from pricelens.llm import token_files as T
from pricelens.llm import tokens

ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "a\n b", "a \nb", "tab\t x", "x\ty", "no\u00a0break space", "a\u00a0 b", "it's we'll", "1 2  3", "<|endoftext|> a <|endoftext|>b",
       "\x1c a \x1d", "\x85 x", "漢字 かな", "émile Zola", "a\n\nb c", "!! ??  ..", "x" * 3000, " \n ", "end\n"]


def _plain(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    return [np.array(e.ids, dtype="<u4") for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rng = seeded(3)
    texts = ODD + ["".join(rng.choice(" \n\tab'1.é!\u00a0") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + [sentence(rng, 50) for _ in range(20)]
    for cache in (tokens.CACHE, 5):
        monkeypatch.setattr(tokens, "CACHE", cache)
        tokens.encoder.cache_clear()
        for part in (texts[:200], texts[200:], texts):
            got = tokens.token_ids(pa.array(part, pa.string()), tokens.default_path(), 9)
            assert all((g[:-1] == w).all() and g[-1] == 9 and len(g) == len(w) + 1 for g, w in zip(got, _plain(part), strict=True))


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300, 4000):
        for top in (1, 3, 1000):
            values = np.concatenate(([0], np.cumsum(rng.integers(0, top + 1, n)))).astype(np.int64)
            ef = T.EliasFano.of(values)
            assert (ef.all() == values).all() and [ef.select(i) for i in range(n + 1)] == values.tolist()
    values = np.cumsum(rng.integers(1, 2000, 10_000))
    ef = T.EliasFano.of(values)
    assert (len(ef.low.tobytes()) + len(ef.high.tobytes()) + len(ef.samples.tobytes())) * 8 < 10_000 * (2 + 10 + 1.5)


def test_round_trip(spark):
    rng = seeded(6)
    rows = [(k * 7 % 211, sentence(rng, rng.randrange(0, 60))) for k in range(211)] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(5, "tie"), (None, "null id")]
    docs = frame(spark, rows).withColumns({"start": F.lit(1), "file": F.lit("clash")})
    segments = T.write_segments(docs, segment_ids=500)
    got = T.read_documents(segments).orderBy(F.col("doc_id").asc_nulls_last(), "start").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [np.append(x, np.uint32(0)).astype("<u4") for x in _plain([t for _, t in order])]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    assert [tuple(r) for r in got] == [(d, int(a), len(x), zlib.crc32(x.tobytes())) for (d, _), a, x in zip(order, starts, ids, strict=False)]
    assert segments.count() > 3 and [r.ids for r in T.document_ids(segments, 1013).collect()] == [ids[[d for d, _ in order].index(1013)].tolist()]
    assert T.read_documents(T.write_segments(frame(spark, []))).count() == 0

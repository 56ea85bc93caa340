import zlib

import numpy as np
from llm_helpers import frame, seeded, sentence
from pyspark.sql import functions as F

from pricelens.llm import packing as P
from pricelens.llm import tokens


def _plain(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    return np.append(np.array(whole.encode(text or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(2)).astype("<u4")


def test_pieces_cover_documents_and_sequences_have_no_gaps(spark):
    rng = seeded(12)
    rows = [(k, sentence(rng, rng.choice([0, 1, 5, 50, 200, 900]))) for k in range(120)] + [(500, None), (501, ""), (None, "null id")]
    docs = frame(spark, rows).withColumns({"piece": F.lit("clash"), "length": F.lit(1)})
    packed = P.pack_documents(docs, with_ids=True)
    by_doc, by_sequence = {}, {}
    for r in packed.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {d for d, _ in rows}
    for doc, text in rows:
        ids, pieces = _plain(text), sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024) and all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            own = ids[r.start:r.start + r.length]
            assert own.tolist() == r.ids and zlib.crc32(own.tobytes()) == r.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for p in by_sequence.values() for r in p)
    assert len(by_sequence) <= 1.2 * total / 1024 + 8
    whole = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    assert all(len(whole[s]) == sum(r.length for r in p) for s, p in by_sequence.items())


def test_repeats_and_empty_table(spark):
    packed = P.pack_documents(frame(spark, [(1, "a b"), (1, "a b")]))
    assert packed.count() == 2 and packed.select("sequence_id", "offset").distinct().count() == 2
    assert P.pack_documents(frame(spark, [])).count() == 0


def test_cuts():
    assert [P.piece_bounds(n, 4) for n in (1, 4, 5, 8, 11)] == [[0, 1], [0, 4], [0, 1, 5], [0, 4, 8], [0, 3, 7, 11]]


def test_best_fit_with_few_open_bins():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1025, 20_000).tolist()
    for most in (4, 64, 4096):
        bins, used = P.Bins(1024, most, 0), {}
        for n in sizes:
            where, offset = bins.place(n)
            assert used.get(where, 0) == offset and offset + n <= 1024 and bins.open <= most
            used[where] = offset + n
        if most == 4096:
            assert len(used) < 1.03 * sum(sizes) / 1024


def test_the_best_fit_is_chosen_and_the_fullest_closes():
    bins = P.Bins(100, 2, 0)
    assert bins.place(60) == (0, 0) and bins.place(70) == (1, 0) and bins.place(30) == (1, 70)  # fills 1 exactly
    assert bins.place(80) == (2, 0) and bins.place(90) == (3, 0)  # 0 has 40 free, 2 had 20: 2 closed
    assert bins.place(15) == (0, 60) and bins.place(10) == (3, 90)

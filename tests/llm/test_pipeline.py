import ast
import inspect

import corpus_pipeline
from conftest import SF_SMALL
from llm_helpers import frame, seeded, words_of

import __spark_entry__ as entry
from pricelens.llm import registry
from pricelens.llm.base import stored

VOICES = {"en": ["the", "with", "thing", "water", "house"], "fr": ["le", "été", "maison", "eau", "où"]}


def _text(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(n))


def test_stages_take_effect_and_clean_documents_stay(spark, tmp_path):
    rng = seeded(21)
    clean = [(k, _text(rng, "en" if k % 2 else "fr", 60), "en" if k % 2 else "fr") for k in range(60)]
    passage, item = _text(rng, "en", 70), _text(rng, "fr", 25)
    near = clean[7][1].split()
    near[30] = "changed"
    planted = [(100, clean[5][1], "en"), (101, " ".join(near), "en"), (102, _text(rng, "en", 40) + "\n" + passage, "en"), (103, _text(rng, "fr", 40) + "\n" + passage, "fr"),
               (104, _text(rng, "fr", 40) + " " + item, "fr"), (105, "12 34 !!", "en"), (106, None, None), (107, "", "en")]
    docs = frame(spark, clean + planted, "doc_id long, text string, lang string, source string, n_chars long")
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stored(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    ids = {d for d, _, _ in clean}
    assert kept["language"].keys() == ids | {100, 101, 102, 103, 104}
    assert kept["lines"].keys() == kept["language"].keys() - {100} and passage in kept["lines"][102].text and passage not in kept["lines"][103].text
    assert kept["lines"][103].n_chars == len(kept["lines"][103].text)
    assert kept["near_copies"].keys() == kept["lines"].keys() - {101} and kept["benchmark"].keys() == ids | {102, 103} == kept["packing"].keys()


def test_language_stage_drops_unlearned_scripts_and_even_mixtures(spark):
    rng = seeded(22)
    clean = [(k, _text(rng, "en" if k % 2 else "fr", 60), "en" if k % 2 else "fr") for k in range(60)]
    greek, han = "\u03b7 \u03b3\u03bb\u03ce\u03c3\u03c3\u03b1 \u03b5\u03af\u03bd\u03b1\u03b9 " * 8, "\u8fd9\u662f \u6587\u672c " * 8
    known = " ".join(["house water"] * 10)
    rows = [(100, greek, None), (101, han, None), (102, known + " " + greek * 9, None), (103, known * 9 + " " + greek, None), (104, "qzxj vkqw jxzq " * 9, None)]
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, frame(spark, clean + rows), None).collect()}
    assert kept == {d: lang for d, _, lang in clean} | {103: "en"}


def test_no_labels_and_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    unlabelled = frame(spark, [(1, "the house by the water"), (2, None), (None, "12 34")], columns)
    assert corpus_pipeline.language(spark, unlabelled, None).collect() == unlabelled.collect()
    frame(spark, [], columns).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert out.count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_queries_are_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []
    assert registry.QUERIES.keys() <= entry.queries().keys() and "pipeline" in entry.queries() and registry.ORACLES.items() <= entry.oracle_sql().items()


def test_only_the_entry_guards_imports():
    import pricelens.llm as package

    for module in (corpus_pipeline, registry):
        assert not [n for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, ast.Try)]
    assert package.__doc__ and words_of("A b") == ["a", "b"]

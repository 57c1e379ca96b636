"""Stages on a small fixture against brute force."""

import random

import corpus_pipeline
from vouchline.llm import simhash

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    prose = [" ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice("aeiou") for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(20, prose[0], "en", "s", 1), (21, prose[1] + " " + BENCH, "en", "s", 1), (22, "short text", "en", "s", 1), (23, None, None, None, None)]
    rows += [(24, prose[2] + " token = abcdef123456 " + prose[3], "en", "s", 1), (25, "# $ % " * 30, "en", "s", 1), (3, prose[3], "en", "s", len(prose[3]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [{*range(12), 20, 21, 24}, {*range(12), 21, 24}, {*range(12), 24}, {*range(12), 24}, {*range(12), 24}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=True):
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert {r.doc_id for r in found} == ids, name
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert len(found) == len(ids)
        if name == "secret_scans":
            text = next(r for r in found if r.doc_id == 24)
            assert "abcdef123456" not in text.text and text.n_chars == len(text.text)
        docs = spark.createDataFrame(found, out.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 13


def test_one_row_of_each_component(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 2), (5, "x y z w", 3), (4, "X y z w", 4), (4, "other words here", 5)], "doc_id long, text string, fp int")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == ["X y z w", "a b c", "other words here"]

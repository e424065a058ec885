"""The pipeline's stages, each against what it must do to its own input, and the registered queries."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from caseloom.llm import byte_cnn
from tests.llm.cases import awkward_docs, empty_docs, near_copies
from tests.llm.test_corpus_operators import _classes

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixed", "tokens"]
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_near_duplicates_keeps_the_smallest_of_each_group(spark):
    texts = near_copies()
    rows = [(i, t, "x", 1, 2, i) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _once int, rows int, `row.key` int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in _classes(texts, 5, 80)})


def test_stages_take_awkward_rows(spark):
    for docs in (awkward_docs(spark), empty_docs(spark)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SF)
            assert name == "sentencepiece_ids" or out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() if name in ("quality_classifier", "ngram_jaccard_join") else n >= docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert all(r.n_tokens == len(r.ids) and r.ids[0] == 1 and r.ids[-1] == 2 for r in rows)
    network = byte_cnn.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id: r.text for r in byte_cnn.classify(docs, network).where("predicted = 1").join(docs, "doc_id").collect()}
    ids = sorted(good)
    kept = {ids[c] for _, _, c in _classes([good[i] for i in ids], 5, 80)}
    assert {r.doc_id for r in rows} == kept
    clean = corpus_pipeline.personal_data(spark, docs, SF).collect()
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9]+\.example\.com", r.text) for r in clean)

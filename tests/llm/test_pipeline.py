"""Each stage of the pipeline on its own input."""

import re

import corpus_pipeline
from vellum.llm import pii, queries


def test_stages(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good, unique, clean, private, _ = (f for _, f in corpus_pipeline.STAGES)

    kept = good(spark, docs, small)
    verdict = {r.doc_id: r.kept for r in queries.op6_quality_classifier(spark, small).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in verdict.items() if v)

    one = unique(spark, docs, small)
    classes = {r.doc_id: r.component_id for r in queries.op8_ngram_join(spark, small).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))

    free = clean(spark, docs, small)
    bad = {r.doc_id for r in queries.op5_decontamination(spark, small).collect()}
    assert bad and free.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in free.collect()} == bad

    safe = private(spark, docs, small)
    assert safe.columns == docs.columns and safe.count() == docs.count()
    spans = {r.doc_id: r.found for r in pii.find(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in safe.collect():
        assert r.n_chars == len(r.text)
        if not spans[r.doc_id]:
            assert r.text == before[r.doc_id]
        for s in spans[r.doc_id]:
            assert re.search(r"\[[A-Z_]+\]", r.text) and s


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas()
    assert len(out) and (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    assert out.groupby("sequence_id").length.sum().max() <= 4096

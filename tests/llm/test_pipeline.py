"""The corpus pipeline: each stage on what the one before kept, and its registered queries."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as cp
from rillspark.llm import jaccard, kneserney, language, mixing


def test_stages(spark, sf):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"]), name
            out = cp.stored(out)
        if name == "language_id":
            good = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.4}
            assert {r.doc_id for r in out.select("doc_id").collect()} == good
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kneserney.classify(docs, labels).collect() if r.kept)
        if name == "jaccard_join":
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in jaccard.link_classes(docs).collect() if r.doc_id == r.component_id)
        if name == "source_mixing":
            named = {r.doc_id: r for r in docs.collect()}
            assert all(named[r.doc_id] == r for r in out.collect())
            words = sum(r.taken for r in mixing.mix(docs).collect())
            got = sum(len(r.text.split()) for r in out.collect())
            assert abs(got - words) < 0.2 * words
        docs = out
    pieces = docs.collect()
    assert 0 < len(pieces) and len({r.doc_id for r in pieces}) <= start


def test_queries_registered():
    import __spark_entry__ as e
    from rillspark.llm import queries

    names = set(queries.QUERIES) | {"pipeline"}
    assert names <= set(e.queries()) and set(queries.SQL) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))

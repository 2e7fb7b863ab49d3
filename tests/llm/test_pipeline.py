"""The corpus pipeline against a brute-force version of its stages."""

from collections import Counter

import corpus_pipeline
from millrace.llm import language, pii
from tests.llm.test_operators import check_packing, plain_classes


def test_stages(spark, sf):
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "redact_pii", "mix_sources", "pack_sequences"]
    docs, seen = first, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns
        docs = spark.createDataFrame(docs.collect(), first.schema)
        seen.append(docs.collect())
    coders = language.Compressors(language.learn(first))
    kept = [r for r in first.collect() if not coders.classify(r.text)[2]]
    assert Counter(kept) == Counter(seen[0])
    classes = plain_classes(sorted((r.doc_id, r.text) for r in kept))
    ones = [r for r in kept if classes[r.doc_id] == r.doc_id]
    assert Counter(ones) == Counter(seen[1])
    trees = pii.trained()
    assert {r.doc_id: r.text for r in seen[2]} == {r.doc_id: pii.redact_text(r.text, trees) for r in ones}
    assert set(Counter(r.doc_id for r in seen[3]).values()) <= {1, 2, 3}
    check_packing([(r.doc_id, r.text) for r in seen[3]], corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0

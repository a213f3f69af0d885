"""The pipeline's stages in a row on the smallest tables."""

from __future__ import annotations

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0

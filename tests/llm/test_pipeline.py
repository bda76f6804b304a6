"""The corpus pipeline, stage by stage and as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skarn.llm import contamination, near
from tests import expected


def test_stages(spark):
    docs = spark.read.parquet(f"{expected.SF_DIR}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, expected.SF_DIR).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert 0 < docs.count() <= n, name
        n = docs.count()
        if name == "near_dedup":
            assert near.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontaminate":
            bench = spark.read.parquet(f"{expected.SF_DIR}/benchmark.parquet")
            assert contamination.decontaminate(docs, bench).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, expected.SF_DIR)
    assert packed.select("doc_id").distinct().count() == n


def test_run(spark):
    assert corpus_pipeline.run(spark, expected.SF_DIR).count() > 0


ODD = [
    (1, "the and of the house is on the hill and the road goes to the sea", "en", "web", 1), (1, "the and of the house is on the hill and the road goes to the sea", "en", "web", 1), (2, None, None, None, None), (None, "the and of the night was long and cold", None, "web", 3),
    (3, "", "en", "", 0), (4, "the word and the line of the text " * 40_000, "en", "web", 5), (5, "\n\n \n", "fr", "web", 5), (6, "12 %%\nthe and of the and\nthe and of the and", "en", "web", 6),
]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_bears_odd_documents(spark, name):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names a stage uses itself."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "kept", "score", "lang_pred", "contaminated", "length", "offset", "row", "node", "d", "whole")})
    key = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
    got = key(stage(spark, docs, expected.SF_DIR))
    assert key(stage(spark, clashing, expected.SF_DIR)) == got
    ids = [r.doc_id for r in stage(spark, docs, expected.SF_DIR).select("doc_id").distinct().collect()]
    assert {1, 4} <= set(ids)
    assert name == "language_id" or None in ids
    assert stage(spark, docs.limit(0), expected.SF_DIR).count() == 0

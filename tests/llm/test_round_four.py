"""Models that learn from all labelled rows: findings of the third review."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.llm import quality, urls


def test_urls_are_learnt_from_all_rows(spark, monkeypatch):
    seen, cut = [], urls.cut
    monkeypatch.setattr(urls, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.when(F.col("id") % 3 == 0, ".net/es/x").when(F.col("id") % 3 == 1, ".com/a").otherwise(".org/b")).alias("url"))
    assert urls.filter_urls(pages).count() == 12_000
    assert seen[0].count() == 8_000


def test_quality_is_learnt_from_all_labelled_rows(spark, monkeypatch):
    seen, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "Plain words follow each other here ").otherwise("$$ || 99 ## "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")).where("doc_id < 8000")
    ranking = quality.learn(docs, labels)
    assert seen[0].count() == 8_000
    got = quality.score_quality(docs, ranking).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("predicted").alias("p")).collect()
    assert {r.odd: round(r.p) for r in got} == {0: 1, 1: 0}

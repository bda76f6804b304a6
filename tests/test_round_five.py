"""Hashes instead of text in shuffles: findings of the third review on growth."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from skarn.operators import audits, features, grams, resampling


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_terms_are_not_shuffled(spark):
    rows = spark.createDataFrame([(k, f"Alpha beta w{k % 3} {'beta ' * (k % 4)}", k % 5 != 0) for k in range(40)] + [(40, None, True), (41, "", False)], "id long, text string, learn boolean")
    df = features.tfidf(rows, "id", "text", F.col("learn"), 3, 8)
    assert "Exchange" not in _plan(df)
    got = df.collect()
    assert len({r.idx for r in got}) == 8 and {r.id for r in got} == set(range(40))
    assert all(abs(sum(r.weight**2 for r in got if r.id == k) - 1) < 1e-9 for k in range(40))
    terms = {r.term: r.df for r in features.vocabulary(rows.where("learn"), "text", 3, 8).collect()}
    assert terms["alpha"] == terms["beta"] == terms["alpha beta"] == 32


def test_ngrams_of_groups_are_shuffled_once(spark):
    rows = spark.createDataFrame([("x", "a b c d"), ("x", "a b c z"), ("y", "q a b c"), (None, "a b c"), ("z", "a b"), (None, None)], "grp string, text string")
    df = audits.cross_group_reuse(rows, "grp", "text", 3)
    assert _plan(df).count("hashpartitioning(h") == 1
    rows = {(r.grp, r.n_grams, r.n_shared) for r in df.collect()}
    assert rows == {("x", 3, 1), ("y", 2, 1), (None, 1, 1)}


def test_phrases_are_counted_by_hashes(spark, monkeypatch):
    plans, kept = [], grams.kept
    monkeypatch.setattr(grams, "kept", lambda df: plans.append(_plan(df)) or kept(df))
    rows = spark.createDataFrame([("b c d a b c",), ("B c d",), ("a b c",), ("x y z",), (None,), ("x y",)], "text string")
    assert [tuple(r) for r in audits.top_phrase(rows, "text", 3, 2).collect()] == [("a b c", 2), ("b c d", 2)]
    assert [tuple(r) for r in audits.top_phrase(rows, "text", 3, 4).collect()] == [("a b c", 2), ("b c d", 2), ("c d a", 1), ("d a b", 1)]
    assert plans and all("hashpartitioning(h" in p and "phrase" not in p for p in plans)


def test_digests_of_numpy():
    for size in (0, 3, 4, 7, 20, 55):
        texts = np.random.default_rng(size).integers(0, 256, (9, size), np.uint8)
        want = [np.frombuffer(hashlib.md5(t.tobytes()).digest(), ">u4").tolist() for t in texts]
        assert resampling.md5_words(texts).tolist() == want


def test_draws_are_counted_without_a_shuffle(spark, monkeypatch):
    for n in (0, 1, 3, 47):
        blocks = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("x"), (F.col("id") % 5 / 4).alias("y"), F.lit(1).alias("one"))
        monkeypatch.setattr(resampling, "KINDS", 15)
        monkeypatch.setattr(resampling, "AT_ONCE", 8 if n == 47 else 1 << 15)
        counted = resampling.drawn_sums(blocks, "k", ["x", "y", "one"], 123, 9)
        assert not n or "Exchange" not in _plan(counted)
        monkeypatch.setattr(resampling, "KINDS", 0)
        joined = resampling.drawn_sums(blocks, "k", ["x", "y", "one"], 123, 9)
        assert counted.dtypes == joined.dtypes
        assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in joined.collect()}

"""Whole results at size: findings of the third review."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skarn.functions import diff, verify
from skarn.operators import process, reuse


def _common_run(a: list[str], b: list[str]) -> int:
    best, row = 0, np.zeros(len(b) + 1, int)
    other = np.array(b)
    for w in a:
        row[1:] = np.where(other == w, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def test_runs_of_many_open_places_are_few_rows(spark, monkeypatch):
    """Texts put together from the same phrases: each place is open, so runs between all of them would be their square."""
    rnd = random.Random(3)
    phrases = [[f"p{k}w{j}" for j in range(7)] for k in range(6)]
    texts = [[w for _ in range(150) for w in rnd.choice(phrases)] for _ in range(6)]
    texts.append(texts[0][100:700] + ["odd"] + texts[1][300:520])
    records = [(k, f"g{k % 3}" if k < 6 else "g9", " ".join(w)) for k, w in enumerate(texts)]
    made, windows = [], reuse._windows

    def counted(*args):
        df = windows(*args)
        made.append(df.count())
        return df

    monkeypatch.setattr(reuse, "_windows", counted)
    got = {r.id: r.longest for r in reuse.reuse(spark.createDataFrame(records, "id int, grp string, text string"), "id", "grp", "text", 6).collect()}
    want = {i: max(_common_run(texts[i], texts[j]) for j, h, _ in records if h != g) for i, g, _ in records}
    assert got == want
    assert sum(made) < 40 * sum(map(len, texts))


def test_what_the_corpus_lacks_is_not_shuffled(spark):
    answers = spark.createDataFrame([(k, " ".join(f"a{k}x{j}" for j in range(40)) + " one two three four five six seven") for k in range(500)], "id int, text string")
    corpus = spark.createDataFrame([("c", "zero one two three four five six seven eight")], "item string, text string")
    df = reuse.against(answers, corpus, "id", "text", "item", "text", 6)
    assert {(r.covered, r.longest) for r in df.collect()} == {(7, 7)}
    assert "BroadcastHashJoin" in reuse.against(answers, corpus, "id", "text", "item", "text", 6, runs=False)._jdf.queryExecution().executedPlan().toString()


def test_groups_of_equal_record_ids_in_two_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "id int, text string")
    got = reuse.against(rows, rows.withColumn("text", F.concat(F.lit("z "), "text")), "id", "text", "id", "text", 6).collect()
    assert {(r.id, r.n_words, r.covered, r.longest) for r in got} == {(1, 7, 7, 7), (2, 0, 0, 0)}


def test_process_measures_broadcast_no_history(spark):
    commits = spark.createDataFrame([(1, "a", "2024-01-01", "fix x"), (2, "a", "2024-01-02", "add y")], "id long, author string, ts string, subject string").withColumn("ts", F.to_date("ts"))
    changes = spark.createDataFrame([(1, "d/x", 1, 0), (2, "d/x", 2, 1)], "id long, path string, added long, deleted long")
    df = process.process_measures(commits, changes)
    assert sorted((r.id, r.nuc, r.ndev, r.exp, r.sexp) for r in df.collect()) == [(1, 0.0, 0.0, 0, 0), (2, 1.0, 1.0, 1, 1)]
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_cosmetic_diffs_are_split_once(spark):
    told = diff.cosmetic_only(F.col("d"))
    rows = spark.createDataFrame([("+++ b/a.py\n-# x\n+# y",), ("+++ b/a.JS\n-// x\n+a",), ("+++ b/a\n-a  b\n+ a b",), ("-# x\n+# y",), ("+++ b/a.html\n+<!-- x",), ("+++ b/a.py\n+",)], "d string")
    assert [r[0] for r in rows.select(told).collect()] == [True, False, True, False, True, False]
    assert rows.select(told)._jdf.queryExecution().analyzed().toString().count("split(") == 2  # the expression and the column's name


def test_prose_looks_for_what_was_removed_once(spark):
    rows = spark.createDataFrame([("The `part_x` method was removed.", "-def part_y()"), ("The `part_x` method was removed.", "-def part_x()"), ("Nothing here.", "+x")], "p string, d string")
    told = verify.phantom_removal(F.col("p"), F.col("d"))
    assert [r[0] for r in rows.select(told).collect()] == ["says 'part_x' was removed, but no removed line in the diff mentions it", None, None]
    assert rows.select(told)._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= 12

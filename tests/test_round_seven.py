"""Shuffles that grow with the input: findings of the fourth review."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from skarn.functions import text
from skarn.operators import grams, process, reuse


def _history(spark):
    rnd = random.Random(5)
    commits = [(k, rnd.choice(["ann", "bob", "eve", None]), None if k % 29 == 0 else 86400 * rnd.randrange(90), rnd.choice(["fix it", "add", None])) for k in range(160)]
    paths = ["a/x", "a/b/x", "a/b/y", "c/x", "top", None]
    changes = [(k, p, rnd.randrange(9), rnd.choice([None, 1, 2])) for k in range(-2, 150) for p in rnd.sample(paths, rnd.randrange(5))]
    return commits, changes, spark.createDataFrame(commits, "id int, author string, s long, subject string").withColumn("ts", F.timestamp_seconds("s")).drop("s"), spark.createDataFrame(changes, "id int, path string, added int, deleted int")


def _measured(commits, changes):
    """nuc, ndev, lt, exp, sexp of each commit, by looking at all others."""
    by = {c[0]: c for c in commits}
    before = lambda a, b: None not in (a[2], b[2]) and (a[2], a[0]) < (b[2], b[0])
    sub = lambda p: p.split("/")[0] if p and "/" in p else "."
    for c in commits:
        own = [x for x in changes if x[0] == c[0]]
        old = [[x for x in changes if x[1] == p and x[0] in by and before(by[x[0]], c)] for _, p, _, _ in own if p is not None]
        mean = lambda f: round(sum(map(f, old)) / len(old), 6) if old else 0.0
        mine = {d[0] for d in commits if d[1] == c[1] is not None and before(d, c)}
        subs = {sub(x[1]) for x in own}
        yield (
            c[0], mean(len), mean(lambda o: len({by[x[0]][1] for x in o} - {None})), mean(lambda o: sum(x[2] - (x[3] or 0) for x in o)), len(mine), sum(x[0] in mine and sub(x[1]) in subs for x in changes),
        )


def test_process_measures_in_order_and_by_month(spark, monkeypatch):
    commits, changes, c, x = _history(spark)
    want = sorted(_measured(commits, changes))
    found = []
    for rows in (1000, 0):  # 0: all paths and authors are dealt by month
        monkeypatch.setattr(process, "PATH_ROWS", rows)
        monkeypatch.setattr(process, "AUTHOR_ROWS", rows)
        found.append(sorted(tuple(r) for r in process.process_measures(c, x).collect()))
        got = sorted((r.id, r.nuc, r.ndev, r.lt, r.exp, r.sexp) for r in process.process_measures(c, x).collect())
        assert got == want
    assert found[0] == found[1]


def test_process_measures_shuffle_each_history_once(spark):
    _, _, c, x = _history(spark)
    plan = process.process_measures(c, x.repartition("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(path") == 1 and plan.count("hashpartitioning(author") == 1
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 8


def test_keys_that_go_beyond_batches():
    for size in range(1, 9):
        keys = [None, None, 1, 1, 2, 3, 3, 3, 3, 3, 4]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size], pa.int64())], ["k"]) for k in range(0, len(keys), size)]
        parts = [t.column(0).to_pylist() for t in process.whole_keys([batches[0].slice(0, 0), *batches])]
        assert sum(parts, []) == keys and all(a[-1] != b[0] or a[-1] is None for a, b in zip(parts, parts[1:], strict=False))


def test_words_hashed_by_bytes_are_those_of_the_pattern(spark):
    rnd = random.Random(8)
    texts = ["", None, "a", "a b", "Ab_9 ab_9!", "ÄbÇd K_İx", "x" * 8, "x" * 9, "\x00a\x00", "é", "ends", "", None, "begins " + "y" * 17] + ["".join(rnd.choice("ab_ 9ZÉ.ß\n") for _ in range(rnd.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    both = rows.select("k", F.lower("t").alias("low"), text.words(F.coalesce("t", F.lit(""))).alias("w")).orderBy("k").collect()
    for size in (1, 40, 1 << 20):
        grams.SLICE_BYTES, old = size, grams.SLICE_BYTES
        found, at = [], 0
        for first, end, h, offs in grams.text_slices(pa.array(["skipped", *(r.low for r in both)]).slice(1)):
            assert first == at and len(offs) == end - first + 1
            found += [h[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            at = end
        grams.SLICE_BYTES = old
        assert [len(x) for x in found] == [len(r.w) for r in both]
        names = {(a, b) for x, r in zip(found, both, strict=True) for a, b in zip(x, r.w, strict=True)}
        assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})


def test_only_places_that_may_be_shared_are_rows(spark, monkeypatch):
    """Most words are of one text only; the shared ones are few, so few rows are made and shuffled."""
    rows = [(k, f"g{k % 4}", " ".join(f"t{k}w{j}" for j in range(400)) + (" one two three four five six seven" if k % 3 else "")) for k in range(60)]
    rows += [(60, "g0", "same group again only here and there"), (61, "g0", "same group again only here and there"), (62, None, rows[1][2]), (63, "g1", None)]
    made, kept = [], grams.kept
    monkeypatch.setattr(reuse, "_kept", lambda df: made.append(kept(df)) or made[-1])
    got = {r.id: (r.n_words, r.covered, r.longest) for r in reuse.reuse(spark.createDataFrame(rows, "id int, grp string, text string"), "id", "grp", "text", 6).collect()}
    assert got == {k: ((407, 7, 7) if k % 3 else (400, 0, 0)) for k in range(60)} | {60: (7, 0, 0), 61: (7, 0, 0), 62: (407, 0, 0), 63: (0, 0, 0)}
    assert made[0].count() < 400  # of 24,000 places


def test_what_is_not_among_many_values(spark, monkeypatch):
    monkeypatch.setattr(grams, "BROADCAST_RUNS", 10)
    df = grams.kept(spark.range(5000).select(F.xxhash64(F.col("id") % 900).alias("h"), "id"))
    values = grams.kept(df.where("id % 3 = 0").select("h").distinct())
    for some in (values, values.limit(5), values.where("h is null")):
        want = {r.h for r in some.collect()}
        assert sorted(r.id for r in grams.among(df, some).collect()) == sorted(r.id for r in df.collect() if r.h in want)
        assert sorted(r.id for r in grams.among(df, some, inside=False).collect()) == sorted(r.id for r in df.collect() if r.h not in want)

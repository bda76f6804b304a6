"""Operators of analyses against plain Python versions, on made-up cases that the tables don't hold."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skarn.functions import patch, verify
from skarn.operators import grading, process, ranks, resampling, reuse
from skarn.sources import sinks

TWO_FILES = """commit abc
    -not a removed line
diff --git a/one.py b/one.py
index 1..2 100644
--- a/one.py
+++ b/one.py
@@ -1,4 +1,5 @@ class Top:
 def f(n):
-    for i in range(1, n):
-        pass
+    for i in range(1, n + 1):
+        g(i)
+        h(i)

-def old(): pass
@@ -40,2 +41,2 @@
 x = 1
-y = 2
+y = 3
\\ No newline at end of file
diff --git a/two.txt b/two.txt
--- a/two.txt
+++ b/two.txt
@@ -0,0 +1 @@
+new
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_columns_of_a_diff(spark):
    rows = [tuple(r) for r in one(spark, patch.side_by_side(F.lit(TWO_FILES)))]
    assert rows == [
        (None, "@@ -1,4 +1,5 @@ class Top:", None, "@@ -1,4 +1,5 @@ class Top:", "hunk"),
        (1, "def f(n):", 1, "def f(n):", "context"), (2, "    for i in range(1, n):", 2, "    for i in range(1, n + 1):", "change"), (3, "        pass", 3, "        g(i)", "change"),
        (None, None, 4, "        h(i)", "change"), (4, "", 5, "", "context"), (5, "def old(): pass", None, None, "change"),
        (None, "@@ -40,2 +41,2 @@", None, "@@ -40,2 +41,2 @@", "hunk"), (40, "x = 1", 41, "x = 1", "context"), (41, "y = 2", 42, "y = 3", "change"),
        (42, "\\ No newline at end of file", 43, "\\ No newline at end of file", "context"), (None, "@@ -0,0 +1 @@", None, "@@ -0,0 +1 @@", "hunk"), (None, None, 1, "new", "change"),
    ]
    assert one(spark, patch.side_by_side(F.lit(""))) == [] and one(spark, patch.side_by_side(F.lit("no diff\n-at all"))) == []


def test_index_of_new_lines(spark):
    rows = {(r.path, r.line): r.offset for r in one(spark, patch.line_index(F.lit(TWO_FILES)))}
    text = TWO_FILES.split("\n")
    assert rows[("one.py", 2)] == 1 + text.index("+    for i in range(1, n + 1):") and rows[("one.py", 5)] == 1 + text.index("")
    assert rows[("one.py", 42)] == 1 + text.index("+y = 3") and rows[("two.txt", 1)] == 1 + text.index("+new") and len(rows) == 8
    assert one(spark, patch.line_index(F.lit(""))) == []


def test_places_of_changed_lines(spark):
    rows = [(r.path, r.old_no, r.new_no, r.text.strip(), r.enclosing) for r in one(spark, patch.changed_places(F.lit(TWO_FILES)))]
    assert rows == [
        ("one.py", 2, None, "for i in range(1, n):", "f"), ("one.py", 3, None, "pass", "f"), ("one.py", None, 2, "for i in range(1, n + 1):", "f"), ("one.py", None, 3, "g(i)", "f"),
        ("one.py", None, 4, "h(i)", "f"), ("one.py", 5, None, "def old(): pass", "old"), ("one.py", 41, None, "y = 2", None), ("one.py", None, 42, "y = 3", None), ("two.txt", None, 1, "new", None),
    ]
    assert one(spark, patch.changed_places(F.lit(""))) == []


def longest_common(a: list[str], b: list[str]) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else 0
            best = max(best, row[j])
    return best


def test_reuse_equals_all_pairs(spark):
    rnd = random.Random(8)
    stock = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 14))) for _ in range(12)]
    records = [(i, rnd.choice("xyz"), " ".join(rnd.choice([rnd.choice(stock), rnd.choice("pqrstuvw")]) for _ in range(rnd.randint(0, 9)))) for i in range(70)]
    records += [(70, "x", None), (71, "x", "a b"), (72, "y", records[0][2]), (73, "z", records[0][2]), (74, None, records[1][2])]
    n, words = 3, {i: (t or "").split() for i, _, t in records}
    got = {r.id: r for r in reuse.reuse(spark.createDataFrame(records, "id int, grp string, text string"), "id", "grp", "text", n).collect()}
    assert len(got) == len(records)
    for i, g, _ in records:
        others = [words[j] for j, h, _ in records if g is not None and h is not None and h != g]
        grams = {tuple(w[k : k + n]) for w in others for k in range(len(w) - n + 1)}
        covered = {p for k in range(len(words[i]) - n + 1) if tuple(words[i][k : k + n]) in grams for p in range(k, k + n)}
        longest = max((longest_common(words[i], w) for w in others), default=0)
        assert (got[i].covered, got[i].longest) == (len(covered), longest if longest >= n else 0), i


def test_phrase_of_many_records_makes_no_pairs(spark):
    rows = spark.range(100_000).select("id", (F.col("id") % 3).alias("grp"), F.concat(F.lit("w"), "id", F.lit(" the same seven words in every record v"), "id").alias("text"))
    got = reuse.reuse(rows, "id", "grp", "text", 6).agg(F.min("longest"), F.max("longest"), F.min("covered"), F.count(F.lit(1))).first()
    assert tuple(got) == (7, 7, 7, 100_000)


def test_bootstrap_of_blocks(spark):
    rnd = random.Random(2)
    rows = [(i // 2, t := rnd.random() < 0.5, t if rnd.random() < 0.9 else not t, rnd.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, True, True, True), (7, None, True, True)], "pair int, t boolean, a boolean, b boolean")
    got = resampling.bootstrap_separation(df, "pair", F.col("t"), F.col("a"), F.col("b"), 500, 3).first()
    share = lambda k, true: sum(r[k] for r in rows if r[1] == true) / sum(r[1] == true for r in rows)
    observed = share(2, True) - share(2, False) - share(3, True) + share(3, False)
    assert got.n == 400 and got.blocks == 200 and abs(got.observed - observed) < 1e-6 and got.low < observed < got.high and got.p == 0
    same = resampling.bootstrap_separation(df, "pair", F.col("t"), F.col("a"), F.col("a"), 100, 3).first()
    assert (same.observed, same.low, same.high, same.p) == (0, 0, 0, 1)
    assert resampling.bootstrap_mean_difference(df, "pair", F.col("a").cast("int"), F.col("b").cast("int"), 300, 1).first().blocks == 200


def test_draws_are_with_replacement(spark):
    blocks = spark.range(101).select(F.col("id").alias("k"), F.lit(1).alias("one"), F.pow(F.lit(2.0), -F.col("id")).alias("x"))
    drawn = resampling.drawn_sums(blocks, "k", ["one", "x"], 40, 9).collect()
    assert len(drawn) == 40 and all(r.one == 101 for r in drawn) and len({r.x for r in drawn}) == 40


def test_measures_of_odd_commits(spark):
    commits = spark.createDataFrame([(1, "ann", 0, None), (2, "ann", 0, "Bug"), (3, "bob", 864000, "x"), (4, "ann", 31557600, "PATCH it")], "id int, author string, s long, subject string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    changes = spark.createDataFrame([(1, "a/b/c.py", 10, 0), (2, "a/b/c.py", 5, 1), (2, "top", None, None), (3, "a/x.py", 1, 1), (3, "a/b/c.py", 0, 4)], "id int, path string, added int, deleted int")
    got = {r.id: r.asDict() for r in process.process_measures(commits, changes).collect()}
    zeros = dict.fromkeys(("ns", "nd", "nf", "la", "ld", "sexp"), 0) | dict.fromkeys(("entropy", "lt", "ndev", "age", "nuc"), 0.0)
    assert got[4] == zeros | {"id": 4, "fix": 1, "exp": 2, "rexp": 1.0}
    assert got[1] == zeros | {"id": 1, "fix": 0, "ns": 1, "nd": 1, "nf": 1, "la": 10, "exp": 0, "rexp": 0.0}
    assert got[2] == {"id": 2, "fix": 1, "ns": 2, "nd": 2, "nf": 2, "la": 5, "ld": 1, "exp": 1, "sexp": 1, "entropy": 0.0, "lt": 5.0, "ndev": 0.5, "age": 0.0, "nuc": 0.5, "rexp": 1.0}
    assert got[3] == {"id": 3, "fix": 0, "ns": 1, "nd": 2, "nf": 2, "la": 1, "ld": 5, "exp": 0, "sexp": 0, "entropy": 0.918296, "lt": 7.0, "ndev": 0.5, "age": 10.0, "nuc": 1.0, "rexp": 0.0}


def kept_and_dropped(spark, prose, before="", after="", diff="", measured=True, broken=False):
    row = one(spark, verify.filtered_prose(*(F.lit(x) for x in (prose, before, after, diff, measured, broken))))
    return row.kept, row.dropped


def test_sentences_pass_one_by_one(spark):
    split = lambda t: one(spark, verify.prose_sentences(F.lit(t)))
    assert len(split("Calls h.Cache.Set(k, v) now. It failed in 0.12s.")) == 2 and split("One sentence only") == ["One sentence only"] and split("") == []
    assert kept_and_dropped(spark, "The output changed from 10 to 15.", "10", "15") == ("The output changed from 10 to 15.", [])
    kept, dropped = kept_and_dropped(spark, "This is safe. It does not affect behavior.", measured=False)
    assert kept == "" and len(dropped) == 2
    diff = "-old\n+    c.EventCache.Version()\n"
    kept, dropped = kept_and_dropped(spark, "The `Version` method was removed from it. This causes the program to fail at `c.EventCache`.", diff=diff)
    assert kept.startswith("This causes") and dropped == ["says 'Version' was removed, but no removed line in the diff mentions it"]
    assert kept_and_dropped(spark, "This removes the `old` value and the rest.", diff=diff)[1] == []
    assert kept_and_dropped(spark, "The function removes the leading zeros here. A write racing a `Clear` is dropped.", diff=diff)[1] == []
    assert kept_and_dropped(spark, "It says 'it is not' and nothing is broken.", measured=False)[1] == ["claims the change is harmless ('nothing is broken') with nothing measured"]
    assert kept_and_dropped(spark, None) == ("", []) and kept_and_dropped(spark, "The run gives 7 and 8 now.", "7", "9")[1] == ["invented ['8']"]


def test_verdict_from_reading(spark):
    args = [F.lit(x) for x in ("This change does not affect anything.", "", "", "")] + [F.lit(False), F.lit(False)]
    assert one(spark, verify.verdict(*args)) == "claims the change is harmless ('does not affect') with nothing measured" and one(spark, verify.verdict(*args, may_judge=True)) is None


def test_signed_rank_counts_all_signs(spark):
    rnd = random.Random(6)
    for n in (1, 5, 9):
        d = rnd.sample([k * rnd.choice([-1, 1]) for k in range(1, 40)], n)
        order = sorted(d, key=abs)
        plus = sum(k + 1 for k, x in enumerate(order) if x > 0)
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
        low = min(plus, n * (n + 1) // 2 - plus)
        got = ranks.signed_rank(spark.createDataFrame([(x, 0) for x in [*d, 0, None]], "x int, y int"), F.col("x"), F.col("y")).first()
        assert (got.n, got.w_plus) == (n, plus) and abs(got.p - min(1, 2 * sum(s <= low for s in sums) / (1 << n))) < 1e-6
    tied = ranks.signed_rank(spark.createDataFrame([(x,) for x in [1] * 30 + [-1] * 10 + [2] * 20], "x int"), F.col("x"), F.lit(0)).first()
    mean, sd = 60 * 61 / 4, (60 * 61 * 121 / 24 - (40**3 - 40 + 20**3 - 20) / 48) ** 0.5
    assert (tied.w_plus, tied.w_minus) == (30 * 20.5 + 20 * 50.5, 10 * 20.5) and abs(tied.p - math.erfc((mean - 205) / sd / 2**0.5)) < 1e-6
    assert ranks.signed_rank(spark.createDataFrame([(1,)], "x int"), F.col("x"), F.col("x")).first().p is None


def test_rank_correlation_of_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (3, 7), (None, 1), (9, None)], "x int, y int")
    assert tuple(ranks.spearman(df, F.col("x"), F.col("y")).first()) == (4, 0.833333)
    assert ranks.spearman(df, F.lit(1), F.col("y")).first().rho is None


def test_sinks_refuse_and_leave_nothing(spark, tmp_path):
    rows = [(f"prompt {i} a.py", f"Target {i} says something of its own about a.py here.", ("train", "val", "test")[i % 3], i % 2) for i in range(30)]
    schema = "prompt string, target string, split string, label int"
    gates = [sinks.no_repeated_target("target"), sinks.no_repeated_sentence("target"), sinks.no_unseen_file("prompt", "target"), sinks.whole_splits("split", "label", ("train", "val", "test"))]
    good = spark.createDataFrame(rows, schema)
    assert sinks.publish(good, f"{tmp_path}/good", gates, by=("split",)) == []
    assert spark.read.schema(good.schema).json(f"{tmp_path}/good").count() == 30 and [p.name for p in tmp_path.iterdir()] == ["good"]
    bad = {
        "one string": [*rows, *[("p a.py", "Same.", "train", 1)] * 4], "one sentence": [*rows, *((f"p{i} a.py", f"Own {i}. It is the very same sentence of more than eight words.", "val", 0) for i in range(5))],
        "name a file": [*rows, ("p", "see b.py", "test", 1)], "empty: test": [r for r in rows if r[2] != "test"], "single label: val": [r for r in rows if r[2] != "val" or r[3]], "empty: train, val, test": [],
    }
    for said, own in bad.items():
        with pytest.raises(sinks.Refused, match=said):
            sinks.publish(spark.createDataFrame(own, schema), f"{tmp_path}/bad", gates)
        assert [p.name for p in tmp_path.iterdir()] == ["good"]
    assert len(sinks.publish(spark.createDataFrame(bad["name a file"], schema), f"{tmp_path}/warned", gates, refuse=False)) == 1
    with pytest.raises(FileExistsError):
        sinks.publish(good, f"{tmp_path}/good", gates)


def test_grounding(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n window.Promise here\n-x = old_name(buf, size, limit)\n+x = fooBar(buf, size)"
    plain = "--- a/m.c\n+++ b/m.c\n@@ -1 +1 @@\n-buf\n+len"
    cases = [
        (None, "calls `old_name` late", diff, False, True), ("b.py", "calls old_name late", diff, False, False), ("a.py", "fooBar is wrong", diff, False, True), ("a.py", "touches window.Promise", diff, False, False),
        ("a.py", "touches window.Promise", diff, True, True), ("", "buf and size overflow", diff, False, False), ("", "buf, size and limit overflow", diff, False, True), ("", "the buf overflows", plain, False, True), (None, None, plain, False, False), (None, "buf", "", False, False),
    ]
    for file, said, code, context, want in cases:
        assert one(spark, grading.grounded(F.lit(file).cast("string"), F.lit(said).cast("string"), F.lit(code), context)) == want, said
    assert one(spark, grading.fix_agreement(F.lit("empty check in parse"), F.lit("+ parse(x) check"))) == 2 / 3 and one(spark, grading.fix_agreement(F.lit("a"), F.lit(""))) is None

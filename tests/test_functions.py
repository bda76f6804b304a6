"""Functions, sources and streaming on small literal tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skarn.functions import answers, claims, coerce, diff, patch, text
from skarn.operators import metrics, ranking
from skarn.sources import records
from skarn.streaming import ingest

EDIT = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n keep\n-old\n+new\n+more\n"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_reverse_hunks_twice_is_the_same(spark):
    rows = spark.createDataFrame([(1, EDIT), (2, "@@ -1 +1 @@\n-a\n+b"), (3, "")], "id int, diff string")
    once = F.expr("diff")
    back = rows.select("id", patch.reversed_diff(patch.reversed_diff(once)).alias("diff"))
    assert dict(back.collect()) == dict(rows.collect())
    mixed = "@@ -1,2 +3,4 @@ f\n+a\n-b\n c\n+d"
    got = one(spark, patch.reversed_diff(F.lit(mixed)).alias("a"), patch.reversed_diff(F.lit(mixed), flip=False).alias("b"))
    assert list(got) == ["@@ -3,4 +1,2 @@ f\n-a\n+b\n c\n-d", "@@ -1,2 +3,4 @@ f\n-b\n+a\n c\n+d"]


def test_changed_lines_and_sides(spark):
    d = F.lit(EDIT)
    removed, added = diff.sides(d)
    assert list(one(spark, removed.alias("r"), added.alias("a"), F.size(diff.changed_lines(d)).alias("n"))) == ["old", "new\nmore", 3]


def test_risk_band_and_nan(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.75,), (0.5,), (0.1,)], "s double")
    assert [r[0] for r in rows.select(coerce.risk_band(F.col("s"), 0.5)).collect()] == ["UNSCORED", "UNSCORED", "HIGH", "MEDIUM", "LOW"]


def test_run_class(spark):
    cases = [((True, False, False), "fixes"), ((False, True, False), "breaks"), ((False, False, True), "same"), ((True, True, False), "changes")]
    for given, want in cases:
        assert one(spark, claims.run_class(*map(F.lit, given)).alias("c"))[0] == want


def test_confusion_of_one_row_each(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False), (None, True)], "t boolean, p boolean")
    r = metrics.confusion(rows, F.col("t"), F.col("p"), []).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (1, 1, 1, 1, 0.5)


def test_threshold_without_positives_gives_no_row(spark):
    rows = spark.createDataFrame([(False, 0.1)], "t boolean, score double")
    assert metrics.threshold_for_recall(rows, F.col("t"), "score", 0.95).count() == 0


def test_bucketed_rank_equals_plain_rank(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"), "id")
    out = ranking.bucketed_rank(rows.withColumn("b", F.shiftright("v", 60)), ["k"], "b", ["v"]).collect()
    for k in range(3):
        own = sorted((r for r in out if r["k"] == k), key=lambda r: r["v"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_json_lines_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"commit_id": "a", "diff": "+x"}\n\n{"commit_id": "b", "diff": ""}\nbroken\n')
    got = records.read_json_lines(spark, str(path), records.COMMIT, need="diff").collect()
    assert [r["commit_id"] for r in got] == ["a"]
    records.write_json_lines(spark.createDataFrame([("a", None), ("b", "x")], "id string, v string"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=str) == sorted([{"id": "a"}, {"id": "b", "v": "x"}], key=str)


def test_append_new_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    records.append_new(rows, path, "id")
    records.append_new(rows.union(spark.createDataFrame([(3,)], "id int")), path, "id")
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_stream_equals_table(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{source}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "events"))
    stream = ingest.file_stream(spark, str(tmp_path / "events"), "*.parquet")
    streamed = ingest.run_to_table(ingest.tumbling(stream, "ts", "1 hour", ["event_type"], "value"), "tumbled", "complete", str(tmp_path / "ck"))
    want = ingest.tumbling(rows, "ts", "1 hour", ["event_type"], "value")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, want.collect()))


def test_variant_index_equals_zlib(spark):
    import zlib

    from skarn.functions import coerce

    rows = spark.range(50).select("id", coerce.variant_index(F.concat(F.lit("case"), "id"), F.col("id") % 5, 7, "check").alias("v")).collect()
    assert all(r["v"] == (zlib.crc32(f"case{r['id']}:check".encode()) // 7 + r["id"] % 5) % 7 for r in rows)


def test_kappa_at_full_chance_agreement(spark):
    from skarn.operators import metrics

    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "a")], "id int, a string, b string")
    kappa = lambda **k: metrics.kappa(rows, F.col("a"), F.col("b"), [], **k).first()["kappa"]
    assert kappa() is None and kappa(at_chance=1.0) == 1.0


def test_clean_paths_of_verify(spark):
    from skarn.operators import labels

    rows = spark.createDataFrame([(1, True, "s", []), (2, True, "s", None), (3, False, "s", ["x" * 30] * 3), (4, True, " ", ["x" * 5])], "id int, buggy boolean, summary string, explanations array<string>")
    got = lambda hinted: [r["reason"] for r in labels.verify_reason(rows, hinted).orderBy("id").collect()]
    assert got(True) == ["SZZ says buggy, teacher found nothing"] * 2 + ["SZZ says clean, teacher found several defects", "explanation too thin to learn from"]
    assert got(False)[:2] == ["ok", "ok"]


TWO = "diff --git a/tests/t.py b/tests/t.py\nindex 1..2\n--- a/tests/t.py\n+++ b/tests/t.py\n@@ -1 +1,3 @@\n+a\n+b\n-c\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,6 +1,6 @@\n 1\n 2\n 3\n-old\n+new\n 4\n 5\n"


def test_files_of_a_diff(spark):
    d = F.lit(TWO)
    row = one(spark, diff.split_diff(d).alias("s"), diff.hunks_for(d, F.lit("x.py")).alias("h"), diff.entry_file(d, F.array(F.lit("z"))).alias("e"), diff.hunks_for(d, F.lit("y")).alias("none"))
    assert [p["path"] for p in row.s] == ["tests/t.py", "x.py"] and "".join(p["text"] for p in row.s) == TWO
    assert row.h == "@@ -1,6 +1,6 @@\n 1\n 2\n 3\n-old\n+new\n 4\n 5" and row.none == "" and row.e == "x.py"
    bare = one(spark, diff.split_diff(F.lit("+a")).alias("s"), diff.split_diff(F.lit(" \n")).alias("blank"), diff.entry_file(F.lit("+a"), F.array(F.lit("z"))).alias("e"), diff.entry_file(F.lit(TWO.split("diff --git a/x")[0]), F.array(F.lit("z"))).alias("t"))
    assert [tuple(p) for p in bare.s] == [("", "+a")] and bare.blank == [] and bare.e == "z" and bare.t == "tests/t.py"


def test_narrow_context(spark):
    d = F.lit(TWO)
    row = one(spark, diff.narrow_context(d, 1).alias("n"), diff.narrow_context(d, 9).alias("all"), diff.narrow_context(F.lit(" a\n b"), 1).alias("same"))
    assert row.n == TWO.replace(" 1\n 2\n", "").replace(" 5\n", "").rstrip("\n") and row.all == TWO.rstrip("\n") and row.same == " a\n b"


def test_json_in_answers(spark):
    cases = {
        '{"explanation": "a"}': ('{"explanation": "a"}', None),
        'x {"n": 1} then {"explanation": "b", "k": [1,],} y': ('{"explanation": "b", "k": [1]}', "trailing-comma"),
        '{"a": {"explanation": "in"}, "b": 1': ('{"explanation": "in"}', None),
        '{"explanation": "cut \\': ('{"explanation": "cut "}', "truncated"),
        '{"explanation": "k", "next":': ('{"explanation": "k"}', "truncated"),
        '{"n": 1}': ('{"n": 1}', None),
        "{'explanation': 'p', 'ok': True}": ('{"explanation": "p", "ok": true}', "python-repr"),
        '{"explanation": "got {"d": 0} here"}': ('{"explanation": "got {\\"d\\": 0} here"}', "explanation-only"),
        "{'explanation': 'q', (1, 2): b'y'}": ('{"explanation": "q", "(1, 2)": "b\'y\'"}', "python-repr"),
        '{"explanation": "\\ud800", }': ('{"explanation": "\\ud800"}', "trailing-comma"),
        '{"explanation":"a"} and more': ('{"explanation": "a"}', None), '3 apples {"explanation": 2}': ('{"explanation": 2}', None), '{"n": 1} {"explanation": "b"}': ('{"explanation": "b"}', None),
        '{"explanation": "tail"}] x }': ('{"explanation": "tail"}', None), '{"explanation": "a } b", "k": "{"}': ('{"explanation": "a } b", "k": "{"}', None),
        '{"explanation": "keeps , ] inside", "k": [1,]}': ('{"explanation": "keeps , ] inside", "k": [1]}', "trailing-comma"), '{"explanation": "line\nbreak"}': ('{"explanation": "line\\nbreak"}', None),
        '{"explanation": "one", "two": "x" "explanation": "y"': ('{"explanation": "one"}', "explanation-only"), '"{" {"explanation": "q"}': ('{"explanation": "q"}', None),
        '[{"explanation": "x"}]': ('{"explanation": "x"}', None), "": (None, None), "none": (None, None), "{": ("{}", "truncated"),
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", answers.repaired_json(F.col("t")).alias("r"), answers.extract_json(F.col("t")).alias("s"))
    for r in rows.collect():
        assert tuple(r.r) == cases.get(r.t, (None, None)), r
    strict = {r.t: r.s for r in rows.collect()}
    assert strict["[{\"explanation\": \"x\"}]"] == '[{"explanation": "x"}]' and strict['{"explanation": "cut \\'] is None and strict["{"] is None
    assert strict['{"explanation":"a"} and more'] == '{"explanation": "a"}' and strict['3 apples {"explanation": 2}'] == '{"explanation": 2}' and strict['{"n": 1} {"explanation": "b"}'] == '{"n": 1}'
    assert one(spark, answers.extract_json(F.lit('see ```json\n{"a": 1}\n``` {"b": 2}')).alias("s")).s == '{"a": 1}'


def test_scrub_and_frame(spark):
    cases = {
        "can't open '/tmp/wt-abc/t/main.py'": "can't open '<repo>/t/main.py'", "3 passed in 0.12s": "3 passed in <dur>", "took 450ms": "took <dur>", "done in 9 seconds": "done in <dur>", "built 2026-09-03T19:11:02Z": "built <time>",
        "passes (verified 41s ago)": "passes (verified <ago>)", "started 11:02:33": "started <time>", "\x1b[32mok\x1b[0m": "ok", "10%\r50%\rdone": "done", "10%\r50%\r\nnext": "50%\nnext", "a\r\nb": "a\nb",
        "sum_to(5) = 15": "sum_to(5) = 15", "10\n9\n2": "10\n9\n2", "total 100": "total 100", "width 5m": "width 5m", "": "", "tail  \n  x\t": "tail\n  x", "2 HOURS 3h": "<dur> <dur>",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.scrub(F.col("t"), F.lit("/tmp/wt-abc")).alias("x"))
    assert {r.t: r.x for r in rows.collect()} == cases
    assert one(spark, text.scrub(F.lit(None).cast("string")).alias("a"), text.frame(F.lit("the  f1 of 12 Items a_b X9")).alias("b")) == ("", "ID ID ID N Items ID X9")

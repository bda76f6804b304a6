"""Samples, features and lasting streams against plain Python versions and over restarts."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skarn.functions import profile
from skarn.operators import features, metrics, sampling
from skarn.operators.ranking import hash_key
from skarn.plans import catalog
from skarn.streaming import ingest
from tests import expected


def drawn_in_turn(sizes: dict[int, int], want: int) -> dict[int, int]:
    taken = dict.fromkeys(sizes, 0)
    while want > 0 and any(taken[b] < sizes[b] for b in sizes):
        for b in sorted(sizes):
            if want > 0 and taken[b] < sizes[b]:
                taken[b], want = taken[b] + 1, want - 1
    return taken


def test_water_level(spark):
    rng = random.Random(3)
    for _ in range(5):
        sizes = {b: rng.choice([0, 1, 2, rng.randrange(30)]) for b in rng.sample(range(9), rng.randrange(1, 7))}
        for want in (0, 1, rng.randrange(60), sum(sizes.values()), 1000):
            got = sampling.water_level(spark.createDataFrame(list(sizes.items()), "b int, n long"), "b", F.lit(want)).collect()
            assert {r.b: r.taken for r in got} == drawn_in_turn(sizes, want), (sizes, want)


def test_quotas_hold_and_shortfall_is_given_back(spark):
    # cell (0, py) is short by 20 of its 28; (0, js) has some to spare but js may only have its share
    cells = [(0, "py", 12, 8), (0, "js", 6, 90), (1, "py", 6, 90), (1, "js", 6, 1), (2, "go", 0, 500)]
    got = {(r.bin, r.lang): r.taken for r in sampling.quotas(spark.createDataFrame(cells, "bin int, lang string, pos long, neg long"), ["bin", "lang"], {}, 0.3).collect()}
    assert all(got[b, lang] <= neg for b, lang, _, neg in cells) and got[2, "go"] == 0
    for key, share in ((0, 18), (1, 12)):
        assert sum(n for (b, _), n in got.items() if b == key) <= round(share * 7 / 3)
    for key, share in (("py", 18), ("js", 12)):
        assert sum(n for (_, lang), n in got.items() if lang == key) <= round(share * 7 / 3)
    # js of bin 0 gives more than its own 14, as js of bin 1 is short
    assert got[0, "js"] == 27 and got[0, "py"] == 8 and got[1, "js"] == 1 and got[1, "py"] == 27
    assert sampling.quotas(spark.createDataFrame([], "bin int, lang string, pos long, neg long"), ["bin", "lang"], {}, 0.3).count() == 0
    assert [r.taken for r in sampling.quotas(spark.createDataFrame([(0, "py", 0, 9)], "bin int, lang string, pos long, neg long"), ["bin", "lang"], {}, 0.3).collect()] == [0]


def test_slack_bounds_structure(spark):
    cells = [(0, True, 5, 100), (0, False, 5, 0)]
    got = {r.s: r.taken for r in sampling.quotas(spark.createDataFrame(cells, "bin int, s boolean, pos long, neg long"), ["bin", "s"], {"s": 0.12}, 0.3).collect()}
    assert got == {True: math.floor(0.62 * 23), False: 0}


def test_matched_sample_of_odd_rows(spark):
    rows = [(j, None if j % 4 == 0 else "py", j % 3 == 0, "x") for j in range(90)] + [(900, "py", None, "x")]
    df = spark.createDataFrame(rows, "id long, lang string, b boolean, taken string")
    got = sampling.matched_sample(df.drop("taken"), F.col("b"), ["lang"], {}, 0.5, 1, "id").collect()
    kept = collections.Counter((r.lang, r.positive) for r in got)
    assert kept[None, True] == kept[None, False] and kept["py", True] == kept["py", False] and len({r.id for r in got}) == len(got)
    assert sampling.matched_sample(df.drop("taken").where("id < 0"), F.col("b"), ["lang"], {}, 0.5, 1, "id").count() == 0


def test_restored_share_keeps_all_where_few(spark):
    df = spark.createDataFrame([(j, j < 6, j % 2) for j in range(10)], "id long, p boolean, b int")
    assert sampling.restore_share(df, F.col("p"), "b", 0.3, 1, "id").count() == 10
    assert sampling.restore_share(df.where("not p"), F.col("p"), "b", 0.3, 1, "id").count() == 0


def test_family_splits_leave_no_family_on_both_sides(spark):
    rows = [(j, f"f{j % 11}", j % 11 < 4 and j % 2 == 0) for j in range(660)] + [(1000, None, True), (1001, "f1", None)]
    df = spark.createDataFrame(rows, "id long, family string, p boolean")
    got = sampling.family_splits(df, "family", F.col("p"), 5, 0.1, 7, "id").collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.split == "cross"].add(r.family)
    assert len(got) == 660 and not by[True] & by[False]
    positive = {f"f{j}" for j in range(4)}
    assert len(by[True] & positive) == round(5 * 4 / 11) and len(by[True] - positive) == 5 - round(5 * 4 / 11)
    rest = collections.Counter(r.positive for r in got if r.split != "cross")
    assert collections.Counter(r.positive for r in got if r.split == "within") == {k: round(n * 0.1) for k, n in rest.items()}
    # families of one kind only
    assert {r.split for r in sampling.family_splits(df.where("p"), "family", F.col("p"), 2, 0.5, 7, "id").collect()} == {"cross", "within", "train"}


def plain_tfidf(texts: dict[int, str | None], learnt: set[int], min_df: int, size: int) -> dict[int, dict[str, float]]:
    def terms(t):
        w = re.findall(r"\w\w+", (t or "").lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    df, total = collections.Counter(), collections.Counter()
    for k in learnt:
        df.update(set(terms(texts[k])))
        total.update(terms(texts[k]))
    top = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(learnt)) / (1 + df[t])) + 1 for t in top}
    out = {}
    for k, text in texts.items():
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in collections.Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        if raw:
            out[k] = {t: x / norm for t, x in raw.items()}
    return out


def test_weights_of_terms(spark):
    rng = random.Random(5)
    words = ["fix", "a", "Überlauf", "null", "in", "parser", "x1", "the", "größe", "of"]
    texts = {j: " ".join(rng.choices(words, k=rng.randrange(12))) for j in range(80)} | {80: None, 81: "", 82: "...", 83: "unknown only", 84: "null, null; null"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = collections.defaultdict(dict)
    for r in features.tfidf(df, "id", "text", F.col("id") % 4 != 0, 3, 25).collect():
        got[r.id][r.term] = r.weight
    want = plain_tfidf(texts, {k for k in texts if k % 4}, 3, 25)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and all(abs(got[k][t] - want[k][t]) < 1e-9 for t in want[k]), k
    assert features.tfidf(df.where("id < 0"), "id", "text", F.col("id") % 4 != 0).count() == 0


def test_vector_has_a_fixed_width(spark):
    weights = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.25)], "id long, idx int, weight double")
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, m double")
    got = features.dense(df, weights, "id", 4, ["m"]).select("id", vector_to_array("features").alias("v")).collect()
    assert {r.id: r.v for r in got} == {1: [0.5, 0, 0, 0.25, 2.0], 2: [0, 0, 0, 0, 0]}


def test_standardised_measures(spark):
    df = spark.createDataFrame([(1, 3.0, 5), (2, -4.0, 5), (3, None, 5), (4, 100.0, 5)], "id long, m double, same long")
    got = {r.id: r for r in features.standardised(df, ["m", "same"], F.col("id") < 4).collect()}
    logs = [math.log(4), 0.0, 0.0]
    mu = sum(logs) / 3
    sd = math.sqrt(sum((x - mu) ** 2 for x in logs) / 3)
    assert abs(got[1].m - (math.log(4) - mu) / sd) < 1e-12 and got[2].m == got[3].m and abs(got[4].m - (math.log(101) - mu) / sd) < 1e-12
    assert abs(got[4].same) < 1e-12


@pytest.mark.parametrize("kind", ["trees", "perceptron"])
def test_heads_tell_held_out_documents_apart(spark, kind):
    """Quality by terms and length, learnt from four fifths."""
    docs = catalog.table(spark, "/root/testdata/sf0.01", "documents").join(catalog.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("doc_id", "text", "n_chars", "quality")
    size, learnt = 100, F.col("doc_id") % 5 != 0
    rows = features.dense(features.standardised(docs, ["n_chars"], learnt), features.tfidf(docs, "doc_id", "text", learnt, 3, size), "doc_id", size, ["n_chars"])
    rows = features.class_weighted(rows, F.col("quality") == 0).repartition(8, "doc_id").cache()
    sums = rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert abs(sums[0].w - sums[1].w) < 1e-6
    model = features.head(kind, 1, size + 1).fit(rows.where(learnt))
    scored = model.transform(rows.where(~learnt)).withColumn("score", vector_to_array("probability")[1])
    auc = metrics.auc(scored, F.col("label") == 1, "score").first().auc
    rows.unpersist()
    assert auc >= 0.6, auc


def test_unknown_head():
    with pytest.raises(ValueError, match="unknown head"):
        features.head("forest")


def test_capped_stream_over_restarts_equals_its_batches(spark, tmp_path):
    """Three runs over growing input, with repeated ids and one broken-off batch, give what one count over all gives."""
    source, own = tmp_path / "in", tmp_path / "out"
    rng, order = random.Random(11), hash_key(1, "id")
    batches = [[(b * 100 + j, rng.choice(["de", "en", None])) for j in range(30)] for b in range(3)]
    batches[1] += batches[0][:10]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, lang string").coalesce(1).write.mode("append").parquet(str(source))
        if b == 1:  # what a batch leaves that ended before its counts were written
            spark.createDataFrame([(-1, "de")], "id long, lang string").write.parquet(str(own / "rows" / "batch=1"))
        stream = spark.readStream.schema("id long, lang string").parquet(str(source))
        ingest.capped_sink(stream, str(own), "lang", 16, "id", order, str(own / "checkpoint")).awaitTermination()
    got = {(r.id, r.lang) for r in spark.read.schema("id long, lang string").parquet(str(own / "rows")).collect()}
    import hashlib

    taken, seen, want = collections.Counter(), set(), set()
    for rows in batches:
        for i, lang in sorted(rows, key=lambda r: hashlib.md5(f"1:{r[0]}".encode()).hexdigest()):
            if i not in seen and taken[lang] < 16:
                taken[lang] += 1
                want.add((i, lang))
            seen.add(i)
    assert got == want and max(taken.values()) == 16
    last = spark.read.schema("lang string, taken long").parquet(str(own / "taken" / "batch=2")).collect()
    assert {r.lang: r.taken for r in last} == dict(taken)


def test_unsettled_tasks(spark):
    tasks = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    tried = spark.createDataFrame([(1, "failed"), (1, "reproduced"), (2, "failed"), (None, "reproduced")], "id long, status string")
    left = lambda settled: {r.id for r in ingest.unsettled(tasks, tried, "id", "status", settled).collect()}
    assert left(["reproduced"]) == {2, 3, None} and left(None) == {3, None}


def test_even_sample_and_negatives(spark):
    df = spark.createDataFrame([(j, "big" if j > 4 else "small", j % 10 == 0) for j in range(100)], "id long, g string, p boolean")
    assert collections.Counter(r.g for r in sampling.even_sample(df, "g", 20, 1, "id").collect()) == {"big": 10, "small": 5}
    got = sampling.random_negatives(df, "g", F.col("p"), 3, 1, "id").collect()
    assert collections.Counter(r.g for r in got) == {"big": 27, "small": 3} and all(r.id % 10 for r in got)


def test_matched_queries_are_not_vacuous(spark):
    rows = catalog.QUERIES["matched_quotas"](spark, expected.SF_DIR).collect()
    assert any(0 < r.taken < r.neg for r in rows) and any(r.taken == r.neg for r in rows)


def test_noise_of_commits(spark):
    code = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-x = 1\n+x = 2\n+\n+# why"
    cases = [
        (["x.py"], code, (2, False, ".py")), (["x.py", "a/b.java"], code, (2, False, ".java")), (["x.py"], code.replace("x = 2", "x += 2"), (2, True, ".py")),
        ([], code, None), (["x.txt"], code, None), (["x.py", "y.h"], code, None), (["x.py", "d/Setup.py"], code, None), ([f"{j}.py" for j in range(6)], code, None),
        ([".py"], code, None), (["x.PY"], code, None), (["x.py"], "", None), (["x.py"], None, None), (None, code, None), (["x.py"], "+# a\n+  \n-// b", None),
        (["x.py"], "+import a\n-from b import c", None), (["x.py"], "+import a\n+a()", (2, False, ".py")), (["x.mjs"], "+x\n" * 500, (500, False, ".js")), (["x.mjs"], "+x\n" * 501, None),
    ]
    df = spark.createDataFrame([(j, f, d) for j, (f, d, _) in enumerate(cases)], "id int, f array<string>, d string")
    got = {r.id: tuple(r.x) if r.x else None for r in df.select("id", profile.commit_profile(F.col("f"), F.col("d")).alias("x")).collect()}
    assert got == {j: want for j, (_, _, want) in enumerate(cases)}

"""Less work for the same results: findings on op1 and op10."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skarn.llm import lines, suffixes


def test_intervals_of_one_symbol_are_not_taken_apart(monkeypatch):
    """Twelve copies of a passage between unlike bytes: the copies of a string, which mostly follow one symbol, are not sorted by it row by row."""
    rng = random.Random(3)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = some(1500)
    texts = [some(50) + passage[: 1500 - 10 * k] + some(70) for k in range(12)]
    rows, argsort = [], np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, **k: rows.append(len(x)) or argsort(x, **k))
    got = suffixes.repeats(texts, np.arange(12), np.zeros(12, np.int64), np.zeros(12, bool), 400)
    assert sum(rows) < 3 * sum(map(len, texts))

    places = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 399):
            places.setdefault(t[j : j + 400], []).append((i, j))
    hit = {(i, k) for at in places.values() if len(at) > 1 for i, j in at for k in range(j, j + 400)}
    assert {(i, k) for i, lo, hi in got for k in range(lo, hi)} == hit
    assert hit


def test_passages_shorter_than_a_string_stay(spark):
    """n_bytes is the input's length, whatever is removed; a shared passage goes from 400 bytes on."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    short, long_ = words(60), words(80)[:400]  # 359 bytes in 60 words; the bars beside them are equal, too
    docs = [(k, f"{words(20)}|{p}|{words(30)}") for k, p in enumerate((short, short, long_, long_))]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k].n_bytes for k in range(4)] == [len(t) for _, t in docs]
    assert [got[k].n_removed for k in range(4)] == [0, 0, 402, 402]


def test_shingles_of_lines_need_no_regular_expression(spark):
    """Sets of shingles by characters, not bytes, and bits that differ in as many places as the sets at most."""
    odd = ["", "ab", "\U0001f600\U0001f600é\U0001f600x\U0001f600", "aaaaaaaaaaaa", "naïve façade — naïve façades", "日本語の行は短い" * 3, "x" * 3 + "yz" * 400, "plain words of a plain line " * 9]
    df = spark.createDataFrame(list(enumerate(odd)), "node long, line string")
    made = df.select("node", F.size(lines.hashed(F.col("line"), 5)).alias("n"))
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
    sets = [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in odd]
    assert [r.n for r in made.orderBy("node").collect()] == [len(x) for x in sets]
    rows = {r.node: r for r in lines.bits_of(df).collect()}
    for i, x in enumerate(sets):
        assert rows[i]["size"] == len(x)
        for j, y in enumerate(sets):
            differ = sum(((rows[i][f"b{k}"] ^ rows[j][f"b{k}"]) & ((1 << 64) - 1)).bit_count() for k in range(lines.BIT_LONGS))
            assert differ <= len(x ^ y) and (differ - len(x ^ y)) % 2 == 0

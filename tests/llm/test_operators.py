"""The ten training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import contamination, exact, language, licenses, lines, linking, near, packing, quality, queries, suffixes, urls
from skarn.llm.common import components
from tests import expected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + j, t, "en", "s", len(t or "")) for j, t in enumerate(texts)], SCHEMA)


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}x{rng.randrange(9)}" for _ in range(n)]


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# --- op1


@pytest.mark.parametrize("group", [2, 250])
def test_repeats_equal_brute_force(spark, group):
    rng, length = random.Random(5), 40
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (40, 55, 90, 39)]
    texts = [None, "", "short"]
    for _ in range(40):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) + rng.choice([*shared, ""]) for _ in range(3)]
        texts.append("".join(parts))
    texts += [texts[5], "ab" * 60, "x" * 41]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs_of(spark, texts), length=length, anchor=16, group=group).collect()}
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for j, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        r = got[j]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


# --- op2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("bit_words", [near.BIT_WORDS, 0])
def test_edit_distance_equals_table(monkeypatch, bit_words):
    monkeypatch.setattr(near, "BIT_WORDS", bit_words)
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))]
        limit, want = rng.randrange(8), edits(a, b)
        assert near.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (want if want <= limit else None)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    shared = prose(rng, 40)
    texts = [None, "", "...", "one", "One!"]
    for _ in range(8):
        base = prose(rng, 120)
        texts.append(" ".join(base))
        for _ in range(5):
            other = list(base)
            for _ in range(3):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    texts += [" ".join(shared + prose(rng, 80)) for _ in range(60)]  # a passage that unlike documents share
    texts += [texts[5]] * 3
    got = {r["doc_id"]: r for r in near.near_duplicates(docs_of(spark, texts)).collect()}
    w = [words_of(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(w)), 2) if abs(len(w[i]) - len(w[j])) <= 30 and (not w[i] and not w[j] or edits(w[i], w[j]) <= 0.2 * max(len(w[i]), len(w[j])) + 1e-9)]
    want = union_find(range(len(w)), links)
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == set(want.values())


def test_near_duplicates_of_a_template_equal_brute_force(spark):
    rng = random.Random(17)
    template = prose(rng, 70)
    texts = []
    for _ in range(100):
        own = prose(rng, 28, 10**6)
        other = [x if j % 2 else f"v{rng.randrange(10**6)}" for j, x in enumerate(own)]
        texts += [" ".join(x for j in range(14) for x in template[5 * j : 5 * j + 5] + words[2 * j : 2 * j + 2]) for words in (own, other)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs_of(spark, texts)).collect()}
    code = {x: j for j, x in enumerate({x for t in texts for x in t.split()})}
    w = [np.array([code[x] for x in t.split()], np.uint64) for t in texts]
    want = union_find(range(len(w)), [(i, j) for i, j in combinations(range(len(w)), 2) if near.edit_distance(w[i], w[j], 19) is not None])
    assert len(set(want.values())) == 100
    assert got == want


@pytest.mark.parametrize(("n", "share", "least"), [(5, 0.2, 0.98), (10, 0.2, 0.98), (22, 0.18, 0.98), (50, 0.2, 0.95), (60, 0.2, 0.95), (150, 0.05, 1.0), (150, 0.1, 1.0), (150, 0.15, 0.98), (150, 0.2, 0.9), (600, 0.2, 0.9)])
def test_sketches_find_edited_texts(n, share, least):
    rng, texts = random.Random(23), []
    for _ in range(300):
        a = prose(rng, n, 10**6)
        b = list(a)
        for at in rng.sample(range(n), int(share * n + 1e-9)):
            b[at] = "changed"
        texts += [" ".join(a), " ".join(b)]
    data = [t.encode() for t in texts]
    words, bounds = near.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    sketch, kinds = near.all_sketches(words, bounds)
    ends = np.cumsum(kinds) - kinds
    found = [bool((sketch[ends[j]] == sketch[ends[j + 1]]).any() or (sketch[ends[j] + kinds[j] - 1] == sketch[ends[j + 1] + kinds[j] - 1]).any()) for j in range(0, len(texts), 2)]
    assert sum(found) >= least * len(found)


def test_crowded_bucket_compares_all_classes(spark):
    n = 300  # node and node + n are similar, all share one key
    members = spark.range(2 * n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"))
    verify = lambda pairs: pairs.where(f"b - a = {n}")
    for plausible in (lambda x, y: F.lit(True), lambda x, y: x("half") == y("half")):
        got = linking.link_classes(members, members.select("node", (F.col("node") % n).alias("half"), F.lit(9).alias("size")), plausible, verify, 0.8)
        assert {(r["node"], r["comp"]) for r in got.collect()} == {(k, k % n) for k in range(2 * n)}


def test_few_links_in_a_crowded_bucket(spark):
    # 20 planted links among 260 nodes of one bucket, sizes up to a fifth apart
    members = spark.range(260).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"))
    size = F.when(F.col("node") % 2 == 0, 100).otherwise(80)
    got = linking.link_classes(members, members.select("node", size.alias("size")), lambda x, y: F.lit(True), lambda pairs: pairs.where("a >= 200 and a < 220 and b = a + 21"), 0.8)
    pairs = [(k, k + 21) for k in range(200, 220)]
    want = union_find({x for p in pairs for x in p}, pairs)
    assert {(r["node"], r["comp"]) for r in got.collect()} == set(want.items())


def test_bits_never_exclude_what_aligns():
    rng = random.Random(19)
    for _ in range(300):
        a = prose(rng, rng.randrange(1, 60), 5)
        b = [x for x in a if rng.random() > 0.1] + prose(rng, rng.randrange(3), 5)
        data = " ".join([*a, "\n", *b]).encode()
        words, bounds = near.word_hashes(np.frombuffer(data, np.uint8), np.array([0, data.index(b"\n"), len(data)]))
        x, y = near.word_bits(words, bounds).reshape(2, -1)
        assert sum(int(k).bit_count() for k in (x ^ y).view(np.uint64)) <= 2 * edits(a, b) - abs(len(a) - len(b))


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = union_find({x for p in links for x in p}, links)
    assert got == {n: want[n] for p in links if p[0] != p[1] for n in p}


# --- op3, op8


def test_language_held_out_accuracy(spark):
    out = queries.op3_language_id(spark, expected.SF_DIR).join(queries.table(spark, expected.SF_DIR, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = out.where("held_out and lang is not null and length(text) > 40").collect()
    assert len(rows) >= 20
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_letters(spark):
    rows = docs_of(spark, ["the and of the and"] * 3 + [None, "", "12 %%", "\U000f0001\U000e0041", "Zzzq", "\U00020010"])
    got = language.identify(rows, language.learn(rows.where("doc_id < 3"))).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en"] * 3 + ["und"] * 4 + ["en"] * 2


def test_quality_held_out_ranking(spark):
    sf = expected.SF_DIR.replace("0.001", "0.01")
    out = queries.op8_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out")
    rows = out.select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert good and bad
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.75
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


# --- op4


def test_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(1, 12) for _ in range(rng.randrange(9))]
        target = rng.randrange(30)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= target}
        chosen = packing.fill(dict(Counter(lengths)), target)
        assert sum(chosen) == max(sums)
        assert not Counter(chosen) - Counter(lengths)


@pytest.mark.parametrize("char", [" ", "\n", "a", "7", ".", " \n\t", "\u3000"])
def test_ids_of_very_long_runs(char):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, text = str(public_tokenizers.path("byte_bpe_50k.json")), "x" + char * 1_500_000
    read = packing.byte_reader(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), path)
    assert read(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_texts_that_are_not_utf8(spark):
    """Parquet holds any bytes in strings; what is broken counts as U+FFFD."""
    broken = spark.sql("SELECT 0L AS doc_id, cast(concat(cast('the and of ' AS binary), unhex('FFC328E282')) AS string) AS text UNION ALL SELECT 1L, 'the and'")
    mended = docs_of(spark, ["the and of \ufffd\ufffd(\ufffd", "the and"])
    drop = lambda df: sorted(tuple(r) for r in df.drop("sequence_id", "offset").collect())
    assert drop(packing.pack(broken)) == drop(packing.pack(mended))
    model = language.learn(docs_of(spark, ["the and of the and"] * 3))
    assert drop(language.identify(broken, model)) == drop(language.identify(mended, model))


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r["text"] for r in queries.table(spark, expected.SF_DIR, "documents").collect()] + [None, "", "a<|endoftext|>b", "\u200d\U0001f600 x\n\n\n  y\t" * 30, "z" * 30000]
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = packing.pack(docs_of(spark, texts)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for j, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[j], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] >= 1
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in got)
    assert len(sequences) <= tokens / 2048 * 1.02 + 8  # one short sequence a task


# --- op5, op6: SQL


@pytest.mark.parametrize("name", sorted(queries.EXPECTED_SQL))
def test_query_equals_sql(spark, name):
    expected.check(spark, name, queries.QUERIES[name], queries.EXPECTED_SQL[name])


def test_exact_dedup_nulls_and_ties(spark):
    rows = docs_of(spark, ["a", None, "", "a", "A", "b"]).union(spark.createDataFrame([(0, "a", None, None, None), (None, "b", None, None, None)], SCHEMA))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(rows).collect()), key=str)
    assert got == sorted([(0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True), (1, 2, 2, False), (2, 2, 2, True), (4, 4, 1, True), (5, 5, 2, True), (None, 5, 2, False)], key=str)


def test_decontamination_paths_agree(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "two words"), (3, None), (4, "..."), (1, "Also one"), (5, " ".join(["ha"] * 12))], "item_id long, text string")
    texts = [" ".join(prose(rng, 20) + item[a : a + n] + prose(rng, 20)) for a, n in ((0, 10), (3, 9), (5, 25), (0, 30))] + ["x TWO, words also one", "ha " * 25, None, "", "two"]
    a = sorted(map(tuple, contamination.decontaminate(docs_of(spark, texts), bench).collect()))
    b = sorted(map(tuple, contamination.decontaminate(docs_of(spark, texts), bench, broadcast_words=0).collect()))
    assert a == b
    assert [(r[0], r[2], r[3]) for r in a] == [(0, 10, 1), (1, 0, 0), (2, 25, 1), (3, 30, 1), (4, 4, 2), (5, 25, 1), (6, 0, 0), (7, 0, 0), (8, 0, 0)]


# --- op7


def test_runs_of_a_word_make_few_pairs():
    item, text = b"same " * 2000, b"same " * 3000 + b"other " * 5
    words = lambda raw: contamination.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    bench = contamination.Bench([("1", words(item)[0])], 10, contamination.K)
    assert len(bench.fp) <= 40
    lo, hi, _ = bench.hits(*words(text))
    covered = np.zeros(3005, bool)
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        covered[x:y] = True
    assert covered[:3000].all() and not covered[3000:].any() and len(lo) <= 3000 * 40


def test_urls_equal_brute_force(spark):
    given = [None, "", "nothing", "http://Example.COM/en/a?x=1", "https://www.example.com/en/b", "ftp://a.www.example.com/en/c#f", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/1?q", "http://x.net/de/", "http://x.org?/en/", "a://b://c/d"]
    given += [f"http://s{j}.{t}/{p}/{j}" for j in range(60) for t, p in (("net", "es"), ("example.com", "en"), ("shop.com", "x"))]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    for r in urls.filter_urls(rows).collect():
        url = given[r["page_id"]]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] in ("allow", "block")
        if fits:
            assert r["verdict"] == max(fits)[2]


# --- op9


def test_license_places_equal_brute_force(spark):
    texts = [r["text"] for r in queries.table(spark, expected.SF_DIR, "documents").collect()]
    texts += [None, "", "The MIT-License, the mit license; CC BY!", "released under the mit license", "apache license " * 40, "gnu general public", "This program is free software: you can redistribute it and/or modify it under the terms of a licence"]
    for r in licenses.scan_licenses(docs_of(spark, texts)).collect():
        w = words_of(texts[r["doc_id"]])
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        base = ",".join(sorted({x for _, x in found}))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(found), min(at, default=None), max(at, default=None), base)
        assert set(base.split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def verified_shares(w):
    """(label, share) of every merged span of a document's words, by comparing words."""
    for text, label in licenses.TEMPLATES.items():
        t = text.split()
        k = licenses.K_LONG if len(t) >= licenses.LONG_FROM else licenses.K_SHORT
        size = len(t) - k + 1
        spans = []
        for _, i, j in sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(size) if w[i : i + k] == t[j : j + k]):
            if not spans or i - j - (spans[-1][-1][0] - spans[-1][-1][1]) > licenses.GAP:
                spans.append([])
            spans[-1].append((i, j))
        for span in spans:
            best = 0
            for first, _ in span:
                window = sorted(h for h in span if first <= h[0] < first + size + max(licenses.GAP, size // 4))
                chain = []
                for n, (i, j) in enumerate(window):
                    chain.append(1 + max((chain[m] for m in range(n) if window[m][0] < i and window[m][1] < j), default=0))
                best = max(best, *chain)
            yield label, best / size


def test_license_notices_equal_brute_force(spark):
    rng, notices = random.Random(31), list(licenses.TEMPLATES)
    texts = ["all rights all rights", "under the under the under the under the", "all rights reserved", " ".join(notices), "rights reserved all rights"]
    for notice in notices:
        for _ in range(12):
            w = notice.split() * rng.randrange(1, 3)
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(w))
                cut = rng.randrange(at, len(w) + 1)
                w[at:at] = rng.choice([["other"], ["or", "so"], w[at:cut][:6], list(reversed(w[at:cut]))[:4]])
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[j]["labels"] for j in range(3)] == ["", "", "all-rights-reserved"]
    for j, text in enumerate(texts):
        found = [(label, share) for label, share in verified_shares(words_of(text)) if share >= licenses.COVER]
        base = set(got[j]["base_labels"].split(",")) - {""}
        assert got[j]["labels"] == ",".join(sorted(base | {label for label, _ in found})), text
        assert got[j]["score"] == pytest.approx(max([share for _, share in found] + [1.0] * bool(base), default=0.0)), text


# --- op10


def test_lines_equal_brute_force(spark):
    rng = random.Random(21)
    base = [" ".join(prose(rng, 25)) for _ in range(6)]
    near_by = [b.replace("w1", "v1", 1).replace("w2", "v2", 1) for b in base]
    unique = [" ".join(prose(rng, 25)) for _ in range(30)]
    texts = ["\n".join([base[0], unique[0], "", base[1]]), None, "", "\n".join([near_by[0], unique[1], base[1], base[1]]), "\n".join([base[2], near_by[2]]), near_by[3], base[3], "ab\nab\n \nab", *unique[2:]]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}

    def jaccard(a, b):
        a, b = ({x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in (a, b))
        return len(a & b) / len(a | b)

    every = sorted({x for t in texts for x in (t or "").split("\n") if x.strip()})
    group = union_find(every, [(a, b) for a, b in combinations(every, 2) if jaccard(a, b) >= 0.8])
    seen = set()
    for j, t in enumerate(texts):
        if t is None:
            assert got[j]["text"] is None and got[j]["n_lines"] == 0
            continue
        kept = []
        for x in t.split("\n"):
            if not x.strip() or group[x] not in seen:
                kept.append(x)
                if x.strip():
                    seen.add(group[x])
        assert got[j]["text"] == "\n".join(kept), j
        assert got[j]["n_removed"] == len(t.split("\n")) - len(kept)


@pytest.mark.parametrize("n", [2, 3, 5, 8, 12, 20, 40, 100])
def test_line_bands_find_similar_lines(spark, n):
    """Pairs edited until their Jaccard similarity would fall under 0.8: the hardest ones."""
    rng, pairs = random.Random(n), []
    shingles = lambda t: {t} if len(t) < 5 else {t[i : i + 5] for i in range(len(t) - 4)}
    while len(pairs) < 150:
        a = b = " ".join(prose(rng, n, 10**6))
        while True:
            at = rng.randrange(len(b))
            c = rng.choice([b[:at] + "q" + b[at + 1 :], b[:at] + b[at + 1 :], b[:at] + "Q" + b[at:]])
            x, y = shingles(a), shingles(c)
            if len(x & y) < 0.8 * len(x | y):
                break
            b = c
        if a != b:
            pairs.append((a, b))
    rows = spark.createDataFrame([(2 * j + k, t) for j, p in enumerate(pairs) for k, t in enumerate(p)], "node long, line string")
    keyed = lines.band_keys(lines.signatures(rows))
    found = keyed.groupBy((F.col("node") / 2).cast("long").alias("pair"), "key").agg(F.countDistinct("node").alias("n")).where("n = 2").select("pair").distinct().count()
    assert found >= 0.9 * len(pairs)


def test_lines_of_the_documents_equal_brute_force(spark):
    """Real lines of all lengths and similarities, through the whole operator."""
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, expected.SF_DIR.replace("0.001", "0.01"), "documents").where("doc_id < 400").select("doc_id", "text").collect()]
    every = sorted({x for _, t in docs for x in (t or "").split("\n") if x.strip()})
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in every]
    rare = Counter(s for own in sets for s in own)
    at = defaultdict(list)
    for j, own in enumerate(sets):  # sets of a similarity of 0.8 share one of their rarest fifth and one
        for s in sorted(own, key=lambda s: (rare[s], s))[: len(own) - -(-len(own) * 4 // 5) + 1]:
            at[s].append(j)
    pairs = {p for own in at.values() for p in combinations(own, 2)}
    group = union_find(range(len(every)), [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert sum(group[j] != j for j in group) > 20
    number, seen, want = {x: group[j] for j, x in enumerate(every)}, set(), {}
    for doc, t in sorted(docs):
        want[doc] = 0
        for x in (t or "").split("\n"):
            if x.strip():
                want[doc] += number[x] in seen
                seen.add(number[x])
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[d] != want[d] for d in want) <= 2, [(d, got[d], want[d]) for d in want if got[d] != want[d]]


def test_lines_without_words_equal_brute_force(spark):
    rng = random.Random(29)
    every = ["=====", "==========", "----", "-----", "------", "||||||", "*-*-*-*-*-*-*", "*-*-*-*-*-*-*-*", "\u2500" * 7, "\u2500" * 9, "\U0001f600" * 6, "\U0001f600" * 8, "abc", "abd"]
    for alphabet in ("0123456789abcdef", "".join(map(chr, range(0xE01, 0xE2F))), "".join(map(chr, range(0x4E00, 0x4F00))), "<>/=+*&%$#"):
        for n in (10, 14, 24, 40, 64):
            for at in (0, n // 2, n - 1):
                a = "".join(rng.choice(alphabet) for _ in range(n))
                every += [a, f"{a[:at]}!{a[at + 1:]}", a + "?"]
    every = list(dict.fromkeys(every))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in every]
    want = union_find(range(len(every)), [(i, j) for i, j in combinations(range(len(every)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs_of(spark, every)).collect()}
    assert got == {j: int(want[j] != j) for j in range(len(every))}


# --- cases that every operator must bear


def _lang(df):
    return language.identify(df, language.learn(df))


def _quality(df):
    return quality.score_quality(df, quality.learn(df, df.select("doc_id", F.lit(1).alias("quality"))))


OPERATORS = {
    "suffixes": suffixes.remove_repeats, "near": near.near_duplicates, "language": _lang, "packing": packing.pack, "exact": exact.exact_dedup,
    "contamination": lambda df: contamination.decontaminate(df, df.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")),
    "urls": lambda df: urls.filter_urls(df, id_col="doc_id", url_col="text"), "quality": _quality, "licenses": licenses.scan_licenses, "lines": lines.dedup_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs_of(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = docs_of(spark, [None, "", "same text here", "same text here", "word " * 50_000]).union(spark.createDataFrame([(2, "same text here", None, None, None), (None, "null id", None, None, None), (None, None, None, None, None)], SCHEMA))
    clash = ["score", "kept", "d", "h", "key", "node", "comp", "row_id", "rule", "host", "n_words", "sequence_id", "a", "b", "x", "label", "n_lines"]
    rows = rows.select("*", *(F.lit("clash").alias(c) for c in clash))
    out = OPERATORS[name](rows)
    assert out.count() == 8 if name != "packing" else out.select("doc_id").distinct().count() == 6

"""Bin completion, prefix trie and hard negatives against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import completion, near, negatives, queries, tries
from skarn.llm.common import mix64
from tests.expected import SF_DIR


def fewest_bins(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            go(i + 1, [*bins[:j], room - items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_fewest():
    rnd, better = random.Random(1), 0
    for _ in range(250):
        capacity = rnd.choice([20, 50, 100])
        items = [rnd.randint(1, capacity) if rnd.random() < 0.3 else rnd.randint(capacity // 6, capacity // 2 + 1) for _ in range(rnd.randint(0, 12))]
        counts = collections.Counter(items)
        made, packed = completion.plan(counts, capacity), collections.Counter()
        for times, filling in made:
            assert times > 0 and sum(x * n for x, n in filling) <= capacity
            for x, n in filling:
                packed[x] += times * n
        assert packed == counts
        want, got = fewest_bins(items, capacity), sum(t for t, _ in made)
        assert completion.fewest(counts, capacity) <= want == got
        better += sum(t for t, _ in completion.best_fit(counts, capacity)) > want
    assert better  # the search is put to use


def test_plan_of_many_pieces_stays_small():
    rnd = random.Random(2)
    counts = {rnd.randint(1, 2048): rnd.randint(1, 10**9) for _ in range(1500)}
    made = completion.plan(counts, nodes=2000)
    assert len(made) < 8192
    assert sum(t * n * x for t, f in made for x, n in f) == sum(x * n for x, n in counts.items())


def test_dominated_fillings_go():
    assert completion.fillings({50: 1, 30: 1, 20: 1}, 50, 10) == [((50, 1),)]
    found = completion.fillings({40: 1, 30: 1, 10: 1, 9: 1}, 50, 20)
    assert ((40, 1), (10, 1)) in found and ((30, 1), (10, 1), (9, 1)) not in found


def check_packing(docs: list[tuple], rows: list) -> None:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(-(-len(ids) // 2048))]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_bin_completion_keeps_every_id(spark):
    rows = queries.op11_bin_completion(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check_packing([tuple(d) for d in docs], rows)


def test_bin_completion_of_odd_texts(spark):
    odd = [
        None, "", "ΑΣ  İx ß ſ é́ à\u0085b c d\x0be\x1cf", "x<|endoftext|>y <|startoftext|>", " " * 1_000_000, "a" * 200_000, "1" * 300_000, "\n" * 700_000 + "z",
        "it's WE'LL d'x 's", "." * 300_000, "́ ́a 가가", "word " * 400_000, "same", "same",
    ]
    docs = list(enumerate(odd))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"length": F.lit("x"), "piece": F.lit(1)})
    check_packing(docs, completion.complete_bins(df).collect())
    assert completion.complete_bins(df.limit(0)).count() == 0


def test_bin_completion_of_broken_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF20C328') AS string) AS text")
    rows = completion.complete_bins(df).collect()
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("a� �(", add_special_tokens=False).ids
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array([*ids, 0], "<u4").tobytes())]


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_prefixes(rows: list[tuple]) -> list[tuple]:
    convs: dict[int, list] = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += children[k] == 0
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(whole[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def check_trie(df, rows: list[tuple]) -> None:
    assert sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=repr) == trie_by_prefixes(rows)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_trie(queries.op12_prefix_trie(spark, SF_DIR), rows)


@pytest.mark.parametrize("block_turns", [20, 150, 1_000_000])
def test_trie_over_blocks(spark, block_turns):
    """Long shared prefixes, copies, prefixes of one another, nulls and turnless conversations, in blocks of few turns and in one."""
    rnd, rows = random.Random(block_turns), []
    for c in range(260):
        for t in range(rnd.choice([0, 1, 2, 4, 9, 30])):
            odd = t > 12
            rows.append((c, t or None, rnd.choice(["u", None, ""]) if odd else "u", rnd.choice([None, "x", "y\tz "]) if odd else "a b " * rnd.choice([0, 1, 1, 1, 1])))
    rows += [(1000 + c, 0, "u", "same text") for c in range(200)] + [(2001, 5, None, None), (None, 1, "u", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit("x"), "depth": F.lit(7)})
    check_trie(tries.prefix_trie(df, block_turns=block_turns), rows)


def test_trie_of_long_and_of_no_conversations(spark):
    rows = [(c, t, "u", f"{t % 50}") for c in (4, 24, 44) for t in range(400 if c < 44 else 390)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check_trie(tries.prefix_trie(df, block_turns=300), rows)
    assert tries.prefix_trie(df.limit(0)).count() == 0


def test_nearest_smaller_entries():
    rnd = random.Random(3)
    for _ in range(200):
        l = [-1, *(rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))), -1]
        left, right, one = tries.nearest_smaller(np.array(l))
        for k in range(1, len(l) - 1):
            assert left[k] == max(j for j in range(k) if l[j] < l[k])
            assert right[k] == min(j for j in range(k + 1, len(l)) if l[j] < l[k])
            assert one[k] == min(j for j in range(left[k] + 1, right[k]) if l[j] == l[k])


def mined(rows: list[tuple]) -> list[tuple]:
    fine = [(i, n, [math.floor(float(x) * 256) for x in v]) for i, n, v in rows if None not in (i, n, v) and all(x is not None and math.isfinite(x) for x in v)]
    size = max(len(v) for *_, v in fine)
    m = np.array([v + [0] * (size - len(v)) for *_, v in fine], object)
    out = []
    for a, (i, label, _) in enumerate(fine):
        if i % 50:
            continue
        s = m @ m[a]
        order = sorted(range(len(fine)), key=lambda j: (-s[j], fine[j][0]))
        for p in [j for j in order if j != a and fine[j][1] == label][:5]:
            found = [j for j in order if fine[j][1] != label and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            out += [(i, fine[p][0], k + 1, fine[j][0], int(s[p]), int(s[j])) for k, j in enumerate(found)]
    return sorted(out)


def test_negatives_of_the_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    want = mined(rows)
    assert want and sorted(map(tuple, queries.op13_hard_negatives(spark, SF_DIR).collect())) == want


@pytest.mark.parametrize(("tree_rows", "stretch"), [(60, 1), (5000, 1), (200, 40_000.0)])
def test_negatives_of_odd_vectors(spark, tree_rows, stretch):
    """A common vector with many ties, unequal lengths, nulls, infinities, and components whose products pass 2**53."""
    rng, rows = np.random.default_rng(3), []
    for i in range(900):
        v = (rng.normal(size=6 if i % 11 else int(rng.integers(0, 6))).round(1) * stretch).tolist()
        v = {0: [0.5 * stretch] * 6, 3: [math.nan] * 6, 4: [None, *v[1:]], 6: [math.inf, *v[1:]]}.get(i % 5 if i > 10 else i, v)
        rows.append((i, None if i == 9 else int(rng.integers(0, 3)), None if i == 8 else v))
    rows += [(1000, 7, [1.0 * stretch]), (None, 1, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[20]]], "vec_id long, label int, embedding array<double>, block int")
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, tree_rows=tree_rows)
    want = mined(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_no_negatives(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (50, 1, [2.0]), (7, 1, [3.0])], "vec_id long, label int, embedding array<float>")
    anchor = F.col("vec_id") % 50 == 0
    assert negatives.hard_negatives(df, anchor).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 7"), anchor).count() == 0
    assert negatives.hard_negatives(df.limit(0), anchor).count() == 0


def test_pruning_leaves_nodes_out(monkeypatch):
    """Bounds must spare most leaves where rows lie in clusters."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 8)) * 400
    label = rng.integers(0, 20, 4000)
    vecs = np.floor(centers[label] + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    tree, seen = negatives.build(np.arange(4000), label, vecs), []
    real = np.sort
    monkeypatch.setattr(np, "sort", lambda x, **k: seen.append(x.size) or real(x, **k))
    q = np.arange(0, 4000, 50)
    full = np.full(len(q), (1 << 63) - 1)
    which, row, score = negatives.search(tree, q, label[q], vecs[q], -full, full, 5, False)
    s = vecs[q] @ vecs.T
    s[label[q][:, None] == label[None, :]] = -(1 << 60)
    want = {(a, b) for a in range(len(q)) for b in sorted(range(4000), key=lambda j: (-s[a, j], j))[:5]}
    assert {(int(a), int(tree.ids[b])) for a, b in zip(which, row, strict=True)} == want
    assert sum(seen) < 0.2 * len(q) * 4000


def test_long_texts_of_common_words_are_told_apart(spark):
    rng = np.random.default_rng(4)
    words = rng.zipf(1.35, 4000) % 3000
    texts = [words[:800], words[800:1600], np.where(np.arange(800) % 11 == 0, 5, words[:800]), words[1600:1860], words[1600:1850]]
    bits, sizes = near.all_bits(mix64(np.concatenate(texts).astype(np.uint64)), np.cumsum([0, *map(len, texts)]))
    ends = np.cumsum(sizes)
    rows = spark.createDataFrame([(k, len(t), bits[e - n : e].tolist()) for k, (t, e, n) in enumerate(zip(texts, ends, sizes, strict=True))], "k int, size long, bits array<long>")
    x, y = (lambda name, of=of: F.col(f"{of}.{name}") for of in "xy")
    met = rows.alias("x").join(rows.alias("y"), (x("k") < y("k")) & near.plausible(x, y, 0.8)).select(x("k"), y("k"))
    assert sorted(tuple(r) for r in met.collect()) == [(0, 2), (3, 4)]

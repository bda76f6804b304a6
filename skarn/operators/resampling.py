"""Block bootstraps whose draws a hash gives, so that SQL can repeat them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.ranking import hash_rank

#: Blocks (a few numbers each) up to which their sums are broadcast; more are joined by shuffling.
BROADCAST_BLOCKS = 200_000
#: Different sums of blocks (kinds) up to which draws count kinds, and blocks whose kinds (two bytes each) are broadcast for it.
KINDS, KIND_BLOCKS = 1 << 15, 1 << 24
#: MD5s that numpy takes at once, places that one task draws, about.
AT_ONCE, TASK_PLACES = 1 << 15, 1 << 24
DRAWS = 10_000

_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(texts: np.ndarray) -> np.ndarray:
    """The MD5s of texts of one length of 55 bytes at most (bytes, a row each) as four big-endian 32-bit numbers a row."""
    n, size = texts.shape
    padded = np.zeros((n, 4 * (size // 4 + 1)), np.uint8)
    padded[:, :size], padded[:, size] = texts, 0x80
    said = [np.ascontiguousarray(w) for w in padded.view("<u4").T]
    start = [np.uint32(x) for x in _START]
    a, b, c, d = (np.full(n, x) for x in start)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        a += np.uint32((_SINES[i] + (8 * size if word == 14 else 0)) & 0xFFFFFFFF)
        if word < len(said):
            a += said[word]
        a += f
        turn = _TURNS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=high)
        a >>= np.uint32(32 - turn)
        a |= high
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1).byteswap()


def _decimals(first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first number, digits as bytes) of runs of the numbers from first to end that have equally many digits."""
    while first < end:
        last = min(end, 10 ** len(str(first)))
        yield first, np.array([str(i).encode() for i in range(first, last)]).view(np.uint8).reshape(last - first, -1)
        first = last


def _places(seed: int, draws: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """A row of places for each draw: those of the MD5s of "seed:draw:word" for each word (digits as bytes, a row each)."""
    rows, many, head = len(draws), len(words), np.frombuffer(f"{seed}:".encode(), np.uint8)
    text = np.empty((rows, many, len(head) + draws.shape[1] + 1 + words.shape[1]), np.uint8)
    at = len(head) + draws.shape[1]
    text[:, :, : len(head)], text[:, :, len(head) : at], text[:, :, at], text[:, :, at + 1 :] = head, draws[:, None], ord(":"), words[None]
    bits = md5_words(text.reshape(rows * many, -1))
    return np.floor(bits.astype(np.float64) * n / 4294967296.0).astype(np.int64).reshape(rows, 4 * many)


def _counted(blocks: DataFrame, numbered: DataFrame, sums: list[str], n: int, draws: int, seed: int) -> DataFrame | None:
    """drawn_sums of few kinds of blocks, or None: each draw counts its blocks of each kind, in one task, and no row is shuffled."""
    types = {"bigint": "long", "int": "long", "double": "double"}
    kept = [(c, types.get(t)) for c, t in blocks.select(*sums).dtypes]
    if not 0 < n <= KIND_BLOCKS or any(t is None for _, t in kept):
        return None
    spark = blocks.sparkSession
    found = blocks.select(*sums).distinct().limit(KINDS + 1).collect()
    if len(found) > KINDS or any(x is None or not math.isfinite(x) for row in found for x in row):
        return None
    known = spark.createDataFrame([(*row, i) for i, row in enumerate(found)], ", ".join(f"`{c}` {t}" for c, t in kept) + ", _kind int")
    parts = numbered.join(F.broadcast(known), sums).groupBy(F.floor(F.col("_at") / 8192).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_at", "_kind"))).alias("of"))
    table = parts.select("part", F.transform("of", lambda x: x["_kind"].cast("short")).alias("of")).toArrow().sort_by("part")
    kinds = np.concatenate([c.flatten().to_numpy() for c in table.column("of").chunks])
    shared = spark.sparkContext.broadcast((kinds, [np.array(v, np.float64 if t == "double" else np.int64) for v, (_, t) in zip(zip(*found, strict=True), kept, strict=True)]))
    words = -(-n // 4)
    step = min(words, AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, values = shared.value
        size = len(values[0])
        spelled = [x for first in range(0, words, step) for x in _decimals(first, min(first + step, words))]
        for batch in batches:
            ids = batch.column(0)
            begin, end = ids[0].as_py(), ids[-1].as_py() + 1  # a batch's numbers are consecutive
            for lo in range(begin, end, AT_ONCE // step):
                for draw, digits in _decimals(lo, min(lo + AT_ONCE // step, end)):
                    rows = np.arange(len(digits))
                    counts = np.zeros(len(rows) * size, np.int64)
                    for j, word in spelled:
                        at = _places(seed, digits, word, n)[:, : n - 4 * j]
                        counts += np.bincount((kinds[at] + rows[:, None] * size).ravel(), minlength=len(counts))
                    of = counts.reshape(-1, size)
                    yield pa.RecordBatch.from_arrays([pa.array(draw + rows), *(pa.array(of @ v) for v in values)], ["draw", *sums])

    tasks = min(draws, max(spark.sparkContext.defaultParallelism, n * draws // TASK_PLACES))
    return spark.range(0, draws, 1, tasks).mapInArrow(run, ", ".join(["draw long", *(f"`{c}` {t}" for c, t in kept)]))


def drawn_sums(blocks: DataFrame, key: str, sums: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, sums): of each draw the sums over as many blocks, drawn with replacement, as there are.

    Blocks are numbered in the order of the MD5 of seed and key. Draw d's
    (4 j + k)-th block is that of the k-th 32 bits of the MD5 of "seed:d:j",
    scaled to their number. Blocks of few numbers of rows have few different
    sums: up to KINDS of them, a draw counts how many of its blocks have each
    (see _counted). With more, draws are generated where they are summed and
    each is partly summed there: no task holds blocks x draws, and only one
    row a draw and task is shuffled.
    """
    spark = blocks.sparkSession
    numbered = hash_rank(blocks, [], seed, key, "_at").select((F.col("_at") - 1).cast("long").alias("_at"), *sums)
    n = blocks.count()
    counted = _counted(blocks, numbered, sums, n, draws, seed)
    if counted is not None:
        return counted
    if n <= BROADCAST_BLOCKS:
        numbered = F.broadcast(numbered)
    words = -(-n // 4)
    rows = spark.range(draws * words).select(F.floor(F.col("id") / max(words, 1)).cast("long").alias("draw"), (F.col("id") % max(words, 1)).alias("j"))
    bits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string")))
    places = [F.floor(F.conv(F.substring(bits, 8 * k + 1, 8), 16, 10).cast("double") * n / 4294967296.0).cast("long") for k in range(4)]
    picked = rows.select("draw", "j", F.posexplode(F.array(*places)).alias("k", "_at")).where(F.col("j") * 4 + F.col("k") < n)
    return picked.join(numbered, "_at").groupBy("draw").agg(*(F.sum(c).alias(c) for c in sums))


def interval(drawn: DataFrame, total: DataFrame, statistic: Column, draws: int) -> DataFrame:
    """observed, low, high, p: the statistic of all blocks, its sorted draws at int(.025 n) and int(.975 n), and the share of draws up to 0."""
    values = drawn.select(F.round(statistic, 9).alias("d")).agg(F.array_sort(F.collect_list("d")).alias("d"))  # one number a draw
    at = lambda share: F.round(F.get("d", F.lit(int(share * draws))), 6)
    ends = values.select(at(0.025).alias("low"), at(0.975).alias("high"), F.round(F.size(F.filter("d", lambda x: x <= 0)) / draws, 6).alias("p"))
    return total.select("blocks", "n", F.round(statistic, 6).alias("observed")).join(F.broadcast(ends))


def _separation(prefix: str) -> Column:
    tp, fn, fp, tn = (F.col(f"{prefix}_{c}") for c in ("tp", "fn", "fp", "tn"))
    return tp / F.greatest(tp + fn, F.lit(1)) - fp / F.greatest(fp + tn, F.lit(1))


def bootstrap_separation(df: DataFrame, block: str, truth: Column, a: Column, b: Column, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Is a's separation (true positive rate less false positive rate) above b's on the same rows?

    Blocks (rows that are one observation, such as a change and its reverse)
    are drawn whole; each is eight counts. Rows without truth or an answer of
    both take no part.
    """
    rows = df.select(F.col(block).alias("_key"), truth.alias("t"), a.alias("a"), b.alias("b")).where("_key is not null and t is not null and a is not null and b is not null")
    cells = {f"{m}_{name}": (F.col(m) if said else ~F.col(m)) & (F.col("t") if true else ~F.col("t")) for m in "ab" for name, said, true in (("tp", True, True), ("fn", False, True), ("fp", True, False), ("tn", False, False))}
    return _bootstrap(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in cells.items())), list(cells), _separation("a") - _separation("b"), draws, seed)


def bootstrap_mean_difference(df: DataFrame, block: str, value: Column, other: Column, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Is the mean over blocks of the blocks' mean value above that of the other value? Rows without one of the two take no part."""
    rows = df.select(F.col(block).alias("_key"), value.cast("double").alias("x"), other.cast("double").alias("y")).where("_key is not null and x is not null and y is not null")
    blocks = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.lit(1).alias("one"))
    return _bootstrap(blocks, ["x", "y", "one"], F.col("x") / F.col("one") - F.col("y") / F.col("one"), draws, seed)


def _bootstrap(blocks: DataFrame, sums: list[str], statistic: Column, draws: int, seed: int) -> DataFrame:
    total = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    return interval(drawn_sums(blocks, "_key", sums, draws, seed), total, statistic, draws)


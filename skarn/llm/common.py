"""Shared helpers of the training-data operators.

Text helpers work on whole Arrow buffers: a slice of documents is one byte
array with document offsets, and words, word hashes and rolling k-gram hashes
are computed for all its documents at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_A, _B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable with the session's ``spark.checkpoint.dir``, which all executors must share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and go on from those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table there: smaller for rows of many columns."""
    shared_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x ^ (x >> U64(30))
    x *= _A
    x ^= x >> U64(27)
    x *= _B
    x ^= x >> U64(31)
    return x


#: A random-looking value for each byte; A-Z share theirs with a-z, bytes outside words have 0.
_BYTES = mix64((np.arange(256, dtype=U64) + U64(1)) * _MULT)
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_WORD_BYTES = np.where(IS_WORD, _BYTES[_LOWER], U64(0))

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    name = "inv" if inverse else "pow"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _BASE_INV if inverse else _BASE, U64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
        if size > 4 * SLICE_BYTES:  # very long texts don't pin their tables
            del _powers[name]
    return have[:n]


def text_slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a batch, of a string or binary column; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    wide = pa.large_binary() if binary else pa.large_string()
    if col.type != wide:
        col = col.cast(wide)
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    offs = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def sound(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes and offsets of a slice, in texts that are not UTF-8 what is broken as U+FFFD."""
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return b"".join(texts), np.cumsum([0, *map(len, texts)])
    return raw, offs


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a slice in order, and each document's bounds among them.

    A word is a run of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters, which in UTF-8 are the bytes from 0x80.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    inside = IS_WORD[data]
    fresh = np.ones(n, bool)
    fresh[1:] = ~inside[:-1]
    fresh[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:] | fresh[1:]
    ends = np.flatnonzero(inside & last) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(_WORD_BYTES[data] * powers(n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(n, True)[starts]
    return mix64(h + (ends - starts).astype(U64) * _MULT), np.searchsorted(starts, offs)


_STEP = [int(x) | 1 for x in mix64((np.arange(64, dtype=U64) + U64(1000)) * _MULT)]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from each word (documents are not told apart: see gram_ok)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, (k * int(_MULT)) & 0xFFFFFFFFFFFFFFFF, U64)
    for j in range(k):
        h += words[j : j + n] * U64(_STEP[j])
    return mix64(h)


def gram_ok(bounds: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of grams()' positions lie in one document."""
    ok = np.ones(max(n_words - k + 1, 0), bool)
    for j in range(1, k):
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large and small stars, in DataFrame operations only.

    links has long columns a and b. Returns (node, comp), comp the smallest
    node of the component, for every node with a link to another one. Each
    round is cut by checkpoint(); the number of rounds is logarithmic in the
    longest path, and none follows once every component is a star around its
    smallest node. No neighbour list is gathered: a star is a grouped minimum
    joined back, so a node with very many links is only a skewed join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(8, edges.count() // 50_000)
    edges = edges.coalesce(tasks)
    for _ in range(max_rounds):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("below")))
        # a node below another one has no other link
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n")).where("below > 0 and n > 1").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError("components() did not converge")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

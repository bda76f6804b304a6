"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import U64, cut, gram_ok, grams, text_slices, word_hashes

#: A shared span of WINDOW words has a shared fingerprint: the least K-gram hash among WINDOW - K + 1.
WINDOW, K = 10, 5
#: Benchmark words up to which the benchmark is broadcast (8 bytes each, plus its fingerprints); beyond, it is joined by shuffling.
BROADCAST_WORDS = 4_000_000


def winnow(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a slice: of each window's k-grams the least, the last one of equals."""
    g = grams(words, k)
    w = window - k + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        here = g[j : j + n]
        less = here <= best
        np.copyto(best, here, where=less)
        at[less] = j
    ok = gram_ok(bounds, len(words), window)
    chosen = np.unique((at + np.arange(n))[ok])
    return chosen, g[chosen]


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + count: which range, and which index, for each element."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Bench:
    """Words and fingerprints of benchmark items, in arrays sorted by fingerprint."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, k: int) -> None:
        items = [(i, w) for i, w in items if len(w)]
        self.window, self.k = window, k
        self.ids = [i for i, _ in items]
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, U64)
        self.bounds = np.cumsum([0, *(len(w) for _, w in items)])
        at, fp = winnow(self.words, self.bounds, window, k)
        self.owner = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        if len(at):  # places of an item with the same words as far as a window reaches find the same: one of them, so that runs of a word don't make all pairs
            near = at[:, None] + np.arange(k - window, window)
            own = self.owner[at]
            inside = (near >= self.bounds[own][:, None]) & (near < self.bounds[own + 1][:, None])
            around = np.where(inside, self.words[np.clip(near, 0, len(self.words) - 1)], U64(0))
            one = np.unique(np.column_stack([fp, own.astype(U64), around, inside.sum(axis=1).astype(U64)]), axis=0, return_index=True)[1]
            at, fp = at[one], fp[one]
        order = np.argsort(fp, kind="stable")
        self.fp, self.at = fp[order], at[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for _, w in items if len(w) < window}):
            own = [j for j, (_, w) in enumerate(items) if len(w) == n]
            h = np.array([grams(items[j][1], n)[0] for j in own], U64)
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], np.array(own)[order]

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, item) of spans that a slice shares with items."""
        found = [(np.zeros(0, np.int64),) * 3]
        if len(self.fp):
            pos, fp = winnow(words, bounds, self.window, self.k)
            lo, hi = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
            which, entry = _expand(lo, hi - lo)
            d, q = pos[which], self.at[entry]
            if len(d):
                doc = np.searchsorted(bounds, d, "right") - 1
                item = self.owner[q]
                d_lo, d_hi, q_lo, q_hi = bounds[doc], bounds[doc + 1], self.bounds[item], self.bounds[item + 1]
                same = np.ones(len(d), bool)
                for j in range(self.k):  # the k-gram itself, word by word
                    same &= words[d + j] == self.words[q + j]
                reach = self.window - self.k
                left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
                on = same.copy()
                for t in range(1, reach + 1):
                    on &= (d - t >= d_lo) & (q - t >= q_lo)
                    on &= words[np.maximum(d - t, 0)] == self.words[np.maximum(q - t, 0)]
                    left += on
                on = same.copy()
                for t in range(self.k, self.window):
                    on &= (d + t < d_hi) & (q + t < q_hi)
                    on &= words[np.minimum(d + t, len(words) - 1)] == self.words[np.minimum(q + t, len(self.words) - 1)]
                    right += on
                whole = same & (left + self.k + right >= self.window)
                found.append((d[whole] - left[whole], d[whole] + self.k + right[whole], item[whole]))
        for n, (h, own) in self.short.items():
            g = grams(words, n)
            ok = np.flatnonzero(gram_ok(bounds, len(words), n))
            lo, hi = np.searchsorted(h, g[ok], "left"), np.searchsorted(h, g[ok], "right")
            which, entry = _expand(lo, hi - lo)
            d, item = ok[which], own[entry]
            same = np.ones(len(d), bool)
            for j in range(n):
                same &= words[d + j] == self.words[self.bounds[item] + j]
            found.append((d[same], d[same] + n, item[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ids_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, broadcast_words: int = BROADCAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that lie in a passage shared with a benchmark item.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.
    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. Winnowing keeps the least k-gram hash
    of each window, so two texts that share a window share a fingerprint
    (short items are fingerprinted whole). Documents' fingerprints are joined
    with the benchmark's, each hit is extended to both sides word by word, and
    it counts if it reaches a whole window.

    The benchmark's size is counted first. Up to ``broadcast_words`` words its
    fingerprints are broadcast and each document is judged where it is read,
    without a shuffle. A larger one is joined by shuffled fingerprints, rows
    carrying the hashes of the windows around them (see _joined).

    One row per input row: id, n_words, n_hit, n_items, items_sha256 (of the
    hit items' distinct ids, sorted as strings, comma-joined), contaminated.
    Null texts have no words; empty tables give no rows, an empty benchmark no
    hits. Items that share an id count once. Columns named in keep come along,
    others are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    names = {"doc_id": id_col} | {f"keep_{c}": c for c in keep}
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    size = items.select(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    if size > 2 * broadcast_words:  # a word has a character and, but for the last, a gap
        return _joined(docs, items, window, k).withColumnsRenamed(names)
    rows = items.where("text is not null").collect()
    texts = [r["text"].encode() for r in rows]
    offs = np.cumsum([0, *map(len, texts)])
    words, bounds = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offs)
    bench = docs.sparkSession.sparkContext.broadcast(Bench([(str(r["item_id"]), words[bounds[j] : bounds[j + 1]]) for j, r in enumerate(rows)], window, k))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bench.value
        none = _ids_digest([])
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                words, bounds = word_hashes(data, offs)
                lo, hi, item = b.hits(words, bounds)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
                n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
                doc = np.searchsorted(bounds, lo, "right") - 1
                n_items, digest = np.zeros(end - first, np.int64), [none] * (end - first)
                pairs = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                for d in np.unique(pairs[0]):
                    own = {b.ids[j] for j in pairs[1][pairs[0] == d]}
                    n_items[d], digest[d] = len(own), _ids_digest(list(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(np.diff(bounds)), pa.array(n_hit), pa.array(n_items), pa.array(digest), pa.array(n_hit > 0), *(batch.column(2 + j)[first:end] for j in range(len(keep)))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(f"keep_{c}" for c in keep)],
                )

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", _OUT, *(f"`keep_{c}` {docs.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)])
    return docs.mapInArrow(judge, schema).withColumnsRenamed(names)


def _fingerprints(df: DataFrame, key: str, window: int, k: int, lengths: list[int], whole_short: bool) -> DataFrame:
    """Per row: its words' number and its fingerprints as (fp, start, len, windows), windows the hashes of the up to window - k + 1 windows around."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = window - k + 1
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                words, bounds = word_hashes(data, offs)
                pos, fp = winnow(words, bounds, window, k)
                full, ok = grams(words, window), gram_ok(bounds, len(words), window)
                at = pos[:, None] - np.arange(w)[None, :]
                fine = (at >= 0) & (at < len(full))
                at = np.where(fine, at, 0)
                if len(full):
                    fine &= ok[at]
                around = np.where(fine, full[at] if len(full) else U64(0), U64(0))
                out = [(np.searchsorted(bounds, pos, "right") - 1, fp, pos, np.full(len(pos), window), around)]
                for n in lengths:
                    at = np.flatnonzero(gram_ok(bounds, len(words), n))
                    if whole_short:
                        d = np.searchsorted(bounds, at, "right") - 1
                        at = at[np.diff(bounds)[d] == n]
                    h = grams(words, n)[at]
                    out.append((np.searchsorted(bounds, at, "right") - 1, h, at, np.full(len(at), n), np.zeros((len(at), w), U64)))
                doc, fp, pos, size, around = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.argsort(doc, kind="stable")
                doc, fp, pos, size, around = doc[order], fp[order], pos[order] - bounds[doc[order]], size[order], around[order]
                rows = pa.StructArray.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(pos), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * w), pa.array(around.ravel().view(np.int64)))],
                    ["fp", "pos", "len", "around"],
                )
                cuts = np.searchsorted(doc, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cuts), rows)], [key, "n_words", "fps"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text").mapInArrow(emit, f"{key} {kind}, n_words long, fps array<struct<fp:long,pos:long,len:long,around:array<long>>>")


def _joined(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """decontaminate() for a benchmark of any size: fingerprints meet in a shuffled join, skewed ones are split by Spark.

    A hit is extended by comparing, alignment by alignment, the hashes of the
    windows around the fingerprint that both rows carry.
    """
    items = cut(_fingerprints(items, "item_id", window, k, list(range(1, window)), True))
    lengths = [r[0] for r in items.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect()]
    docs = docs.withColumn("row_id", F.monotonically_increasing_id())
    ids = cut(docs.drop("text"))
    parts = cut(_fingerprints(docs.select("row_id", "text"), "row_id", window, k, lengths, False))
    a = parts.select("row_id", F.explode("fps").alias("f")).select("row_id", "f.*")
    b = items.select("item_id", F.explode("fps").alias("f")).select("item_id", F.col("f.fp").alias("fp"), F.col("f.len").alias("len"), F.col("f.around").alias("theirs")).distinct()
    starts = F.when(F.col("len") < window, F.array("pos")).otherwise(
        F.expr(f"transform(filter(sequence(0, {window - k}), j -> around[j] <> 0 and around[j] = theirs[j]), j -> pos - j)")
    )
    hits = a.join(b, ["fp", "len"]).select("row_id", "item_id", "len", F.explode(starts).alias("lo"))
    per_doc = hits.groupBy("row_id").agg(
        F.array_sort(F.collect_set(F.struct("lo", (F.col("lo") + F.col("len")).alias("hi")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("own")
    )
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0L), (s, x) -> named_struct('n', s.n + greatest(x.hi - greatest(x.lo, s.to), 0L), 'to', greatest(s.to, x.hi)), s -> s.n)")
    out = parts.select("row_id", "n_words").join(ids, "row_id").join(per_doc, "row_id", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("own"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("own", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(covered > 0, F.lit(False)).alias("contaminated"), *(c for c in docs.columns if c.startswith("keep_")),
    )

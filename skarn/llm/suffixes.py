"""Removal of repeated byte strings: Burrows-Wheeler interval expansion over candidate passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import _MULT, U64, cut, mix64, powers, text_slices

#: Bytes of a repeated string, and of an anchor. Every string of LENGTH bytes has an anchor: the least ANCHOR-gram in it.
LENGTH, ANCHOR = 400, 96
#: Distinct surroundings of one anchor up to which they meet in one transform; beyond, they are told apart by SPLIT longer anchors each.
GROUP, SPLIT = 250, 8
#: Bytes that one transform takes, about.
TRANSFORM_BYTES = 1 << 20

_VALUES = mix64((np.arange(256, dtype=U64) + U64(501)) * _MULT)
#: More than a text in an Arrow batch can have.
_POS_BITS = 31


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * powers(len(data) + 1)[: len(data)], out=total[1:])
    return total


def range_hash(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix64((total[hi] - total[lo]) * powers(len(total), True)[lo] + (hi - lo).astype(U64) * _MULT)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, prefix sums) of a slice's anchors: for each string of ``length`` bytes the ANCHOR-gram with the least hash, the last of equals."""
    total = prefix_sums(data)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), total
    size = len(data) - anchor + 1
    g = range_hash(total, np.arange(size), np.arange(size) + anchor)
    low = U64((1 << _POS_BITS) - 1)
    key = (g & ~low) | (low - np.arange(size, dtype=U64))
    width, span = length - anchor + 1, 1
    best = key
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    at = (low - (best[:n] & low)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    full = np.diff(offs) >= length
    np.add.at(inside, offs[:-1][full], 1)
    np.add.at(inside, offs[1:][full] - length + 1, -1)
    at = at[np.cumsum(inside)[:n] > 0]
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # windows go forward, so do their anchors
    return at, g[at], total


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of key (at least 0), and each place's rank, equal for equal keys."""
    n, bits = len(key), max(1, int(len(key) - 1).bit_length())
    if int(key.max()).bit_length() + bits < 64:  # sorting place and key in one number is several times faster
        both = np.sort((key << bits) | np.arange(n))
        sa, ordered = (both & ((1 << bits) - 1)).astype(np.int32), both >> bits
    else:
        sa = np.argsort(key).astype(np.int32)
        ordered = key[sa]
    rank = np.empty(n, np.int32)
    rank[sa] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.int32)
    return sa, rank


def repeats(texts: list[bytes], own: np.ndarray, start: np.ndarray, many: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(index, lo, hi): parts of texts covered by strings of ``length`` bytes that start at two places.

    own, start: whose the text is, and where in it; the same place can lie in
    two texts and counts once. many: texts that stand for several places.

    The texts are joined to one cyclic string, whose suffixes are sorted by
    their first bytes, at least ``length`` of them; from the transform,
    intervals of suffixes with a common prefix are extended to the left,
    breadth first. An interval of prefix length l that ends where no common
    prefix length is set yet sets it to l; others end there. After ``length`` rounds the
    neighbours without a value share at least ``length`` bytes.
    """
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(joined)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    # order by the first bytes, as many as fit beside a place in one number, then doubled
    present = np.zeros(256, bool)
    present[joined] = True
    code, bits = (np.cumsum(present) - 1)[joined], max(1, int(present.sum() - 1).bit_length())
    done = max(1, (63 - int(n - 1).bit_length()) // bits)
    key = np.zeros(n, np.int64)
    for j in range(done):
        key = (key << bits) | np.roll(code, -j)
    sa, rank = _ranked(key)
    while done < length and rank[sa[-1]] < n - 1:
        sa, rank = _ranked(rank.astype(np.int64) * n + np.roll(rank, -done))
        done *= 2
    bwt = joined[sa - 1]
    lf = np.empty(n, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)

    # most intervals hold one symbol; only the others are taken apart, by runs of the transform
    fresh = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    run = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    run_start = np.append(np.flatnonzero(fresh), n).astype(np.int32)
    run_end = run_start[run + 1]

    unset = np.ones(n + 1, bool)
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        one = run_end[lo] >= hi
        left = [lf[lo[one]]]
        right = [left[0] + (hi - lo)[one]]
        wide = ~one
        if wide.any():
            first, end = lo[wide], hi[wide]
            from_run = run[first]
            n_runs = run[end - 1] - from_run + 1
            which = np.repeat(np.arange(len(first), dtype=np.int32), n_runs)
            runs = np.arange(len(which), dtype=np.int32) + np.repeat((from_run - (np.cumsum(n_runs) - n_runs)).astype(np.int32), n_runs)
            begins = np.maximum(run_start[runs], first[which])
            held = np.minimum(run_start[runs + 1], end[which]) - begins
            symbol = which * 256 + bwt[begins]
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            left.append(lf[begins[order[head]]])
            right.append(left[1] + np.add.reduceat(held[order], head).astype(np.int32))
        lo, hi = np.concatenate(left), np.concatenate(right)
        new = unset[hi]
        lo, hi = lo[new], hi[new]
        unset[hi] = False
        if not len(lo):
            break
    group = np.cumsum(~unset[:n])  # neighbours that share the bytes get one number
    text = np.repeat(np.arange(len(sizes)), sizes + 1)[sa]
    offset = sa - begin[text]
    fits = offset + length <= sizes[text]
    group, text, offset = group[fits], text[fits], offset[fits]
    if not len(group):
        return []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(group)))
    place = mix64(mix64(own[text].astype(U64)) + (start[text] + offset).astype(U64) * _MULT)
    twice = (np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)) | np.logical_or.reduceat(many[text], first)
    hit = np.repeat(twice, count)
    text, offset = text[hit], offset[hit]
    order = np.lexsort((offset, text))
    text, offset = text[order], offset[order]
    if not len(text):
        return []
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (offset[1:] > offset[:-1] + length)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text)) - 1
    return list(zip(text[first].tolist(), offset[first].tolist(), (offset[last] + length).tolist(), strict=True))


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(d, pos, h, around): each document's anchors and a hash of all that the strings around one can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, offs in text_slices(batch, "text"):
                at, h, total = anchors(data, offs, length, anchor)
                doc = np.searchsorted(offs, at, "right") - 1
                lo, hi = np.maximum(at - (length - anchor), offs[doc]), np.minimum(at + length, offs[doc + 1])
                around = mix64(range_hash(total, lo, hi) + (at - lo).astype(U64))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + first)), pa.array(at - offs[doc]), pa.array(h.view(np.int64)), pa.array(around.view(np.int64))], ["d", "pos", "h", "around"])

    return docs.mapInArrow(run, "d long, pos long, h long, around long")


def _surroundings(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """rows: d, text, found (h, pos, n). The bytes around each place; skip: how many of the strings that could hold the anchor begin before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, _, data, offs in text_slices(batch, "text"):
                raw = data.tobytes()
                out = []
                for j in range(len(offs) - 1):
                    for f in found[first + j]:
                        at = offs[j] + f["pos"]
                        lo = max(at - (length - anchor), offs[j])
                        out.append((f["h"], ids[first + j], lo - offs[j], lo - (at - (length - anchor)), f["n"] > 1, raw[lo : min(at + length, offs[j + 1])]))
                cols = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.bool_(), pa.binary()), strict=True)], ["h", "d", "lo", "skip", "many", "bytes"])

    return rows.select("d", "text", "found").mapInArrow(run, "h long, d long, lo long, skip long, many boolean, bytes binary")


def _split(held: DataFrame, length: int, width: int, step: int) -> DataFrame:
    """(p, d, h, around, lo, hi, skip, many): surroundings of strings with ``width`` possible starts cut into those with ``step``.

    What all strings of a part have in common is its anchor, h, which is
    length - step + 1 bytes long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offs in text_slices(batch, "bytes"):
                p, d, h, lo, skip, many = (np.asarray(batch.column(c)[row:end]) for c in ("p", "d", "h", "lo", "skip", "many"))
                total, begin = prefix_sums(data), offs[:-1] - skip
                most = skip + np.diff(offs) - length
                for first in range(0, width, step):
                    last = min(first + step, width) - 1
                    left, right = np.maximum(first, skip), np.minimum(last, most)
                    ok = left <= right
                    at, left, right, left_out = begin[ok], left[ok], right[ok], (left - first)[ok]
                    middle = at + last + (first + length - last) // 2
                    common = range_hash(total, at + last, middle) + range_hash(total, middle, at + first + length) * _MULT
                    key = mix64(mix64(common) ^ (h[ok].view(U64) + U64(first)))
                    around = mix64(range_hash(total, at + left, at + right + length) + left_out.astype(U64))
                    cols = (p[ok], d[ok], key.view(np.int64), around.view(np.int64), lo[ok] + left - skip[ok], lo[ok] + right - skip[ok] + length, left_out, many[ok])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["p", "d", "h", "around", "lo", "hi", "skip", "many"])

    return held.select("p", "d", "h", "lo", "skip", "many", "bytes").mapInArrow(run, "p long, d long, h long, around long, lo long, hi long, skip long, many boolean")


def _meeting(kinds: DataFrame) -> DataFrame:
    """kinds (h, around, n), computed, of anchors with two places, and how many kinds the anchor has."""
    per_anchor = kinds.groupBy("h").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("kinds")).where("places > 1")
    return cut(kinds.join(per_anchor, "h").drop("places"))


def _transformed(around: DataFrame, length: int) -> DataFrame:
    """(d, lo, hi) of repeated parts of around, whose surroundings of an anchor meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            own, start, many, texts = (list(x) for x in zip(*held, strict=True))
            held.clear()
            spans = [s for s in repeats(texts, np.array(own), np.array(start), np.array(many), length) if not many[s[0]]]
            return pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i, _, _ in spans], pa.int64()), pa.array([start[i] + lo for i, lo, _ in spans], pa.int64()), pa.array([start[i] + hi for i, _, hi in spans], pa.int64())], ["d", "lo", "hi"]
            )

        for batch in batches:
            for h, d, lo, many, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TRANSFORM_BYTES and h != last:
                    yield flush()
                    size = 0
                held.append((d, lo, many, raw))
                size += len(raw)
                last = h
        if held:
            yield flush()

    # the bytes of a group are compressed to little, by which Spark would give a task too many
    tasks = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.select("h", "d", "lo", "many", "bytes").repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(run, "d long, lo long, hi long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """Texts without the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Two equal strings have an equal anchor at the same place, so only passages
    around anchors that occur twice can hold one. Each passage is as long as
    the strings that contain its anchor reach. Equal passages are one, with
    their number. An anchor with several different passages sends one of each
    into a Burrows-Wheeler transform with others of its partition (see
    repeats); passages that occur twice are repeated as a whole. An anchor
    with more than ``group`` different passages would make a large group: its
    strings are divided by where they begin into SPLIT parts, those of a part
    have a longer anchor in common, and parts go on in the same way, until an
    anchor is a whole string.

    One row per input row: id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (hex, of the remaining bytes), kept (those bytes, as
    binary: a cut can fall inside a character). Null texts are empty. Ids must
    be integers; rows with a null id are left whole and not compared, and rows
    that share an id are compared with each other and share their spans. An
    empty table gives no rows. Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    placed = cut(_anchored(docs.where(f"d is not null and length(text) * 4 >= {length}"), length, anchor))
    pos = F.col("pos")
    kinds = _meeting(placed.groupBy("h", "around").agg(F.count(F.lit(1)).alias("n"), F.first("d").alias("d"), F.first("pos").alias("pos")))
    spans = placed.join(kinds.where("n > 1").select("h", "around"), ["h", "around"]).select("d", F.greatest(pos - (length - anchor), F.lit(0)).alias("lo"), (pos + length).alias("hi"))

    def with_text(chosen: DataFrame) -> DataFrame:
        lists = chosen.groupBy("d").agg(F.collect_list(F.struct("h", "pos", "n")).alias("found"))
        return docs.join(lists, "d")

    around = _surroundings(with_text(kinds.where(f"kinds between 2 and {group}")), length, anchor)
    spans = spans.union(_transformed(around, length))
    hot, width = kinds.where(f"kinds > {group}"), length - anchor + 1
    held = None if hot.isEmpty() else cut(_surroundings(with_text(hot), length, anchor).withColumn("p", F.monotonically_increasing_id()))
    while held is not None and width > 1:
        step = -(-width // SPLIT)
        placed = cut(_split(held, length, width, step))
        one = F.min(F.struct("p", "d", "lo", "hi", "skip")).alias("one")
        kinds = _meeting(placed.groupBy("h", "around").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"), one))
        spans = spans.union(placed.where("not many").join(kinds.where("n > 1").select("h", "around"), ["h", "around"]).select("d", "lo", "hi"))
        parts = kinds.select("h", "kinds", (F.col("many") | (F.col("n") > 1)).alias("many"), "one.*").join(held.select("p", F.col("lo").alias("_lo"), F.col("bytes").alias("_bytes")), "p")
        parts = parts.withColumn("bytes", F.substring("_bytes", (F.col("lo") - F.col("_lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
        spans = spans.union(_transformed(parts.where(f"kinds between 2 and {group}"), length))
        hot, width = kinds.where(f"kinds > {group}"), step
        held = None if hot.isEmpty() else cut(parts.where(f"kinds > {group}").select("h", "d", "lo", "skip", "many", "bytes", F.monotonically_increasing_id().alias("p")))
    # touching spans of a document are merged where they are read
    per_doc = spans.groupBy("d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for first, end, data, offs in text_slices(batch, "text"):
                raw, out = data.tobytes(), []
                for j in range(end - first):
                    text = raw[offs[j] : offs[j + 1]]
                    kept, at, removed, n = [], 0, 0, 0
                    for s in sorted((s["lo"], s["hi"]) for s in found[first + j] or ()):
                        lo, hi = max(s[0], at), min(s[1], len(text))
                        if hi <= lo:
                            continue
                        if lo > at or not n:
                            n += 1
                        kept.append(text[at:lo])
                        removed += hi - lo
                        at = hi
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = docs.join(per_doc, "d", "left").select("d", "text", "spans").mapInArrow(remove, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("d", id_col)

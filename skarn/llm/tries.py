"""Prefix trie of conversations, as the Cartesian tree over their sorted order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import cut, stored

#: Turns of a block of the sorted conversations, about, and blocks at most (their boundaries, 12 bytes each, are broadcast).
BLOCK_TURNS, BLOCKS = 200_000, 200_000
#: Ids of a chunk, about, that is written as text before the chunks of a node meet.
CHUNK = 4096

EMPTY = hashlib.sha256(b"").hexdigest()


def nearest_smaller(l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry between the first and the last, which are less than all: the nearest smaller ones before and after it, and the first equal one between these."""
    n = len(l)
    left, right, one, last = [0] * n, [n - 1] * n, list(range(n)), list(range(n))
    values, stack = l.tolist(), [0]
    for k in range(1, n):
        v = values[k]
        while values[stack[-1]] > v:
            right[stack.pop()] = k
        if values[stack[-1]] == v:
            one[k] = stack[-1]
            last[stack[-1]] = k
        else:
            left[k] = last[stack[-1]]
            stack.append(k)
    of = np.array(one)
    return np.array(left)[of], np.array(right)[of], of


class _Least:
    """Least values of ranges."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, step = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.rows[k][start[on]], self.rows[k][end[on] - (1 << k)])
        return out


def block_nodes(lcp: np.ndarray, size: np.ndarray, n: np.ndarray, least: np.ndarray, words: np.ndarray, before: int, after: int) -> dict[str, np.ndarray]:
    """The trie's nodes in a block of sorted, different sequences, by first sequence and depth.

    lcp: turns that each sequence shares with the one before it; before and
    after: the same across the block's ends (-1: nothing there). size: turns of
    each sequence; n, least: number and least id of its conversations; words:
    those of all turns. A node that goes on before or behind the block is the
    part of it that lies in the block.

    The values between neighbours span the tree: an entry's interval goes from
    its nearest smaller entry on the left to that on the right, entries of
    equal value and interval are one node, and depths down to the larger of
    the two neighbours have no entry and share the interval. What is deeper
    than both neighbours of a sequence belongs to that sequence alone.
    """
    m = len(size)
    l = np.concatenate([[-1], lcp[1:], [-1]]).astype(np.int64)
    left, right, merged = nearest_smaller(l)
    inner = np.arange(1, m)
    one, equal = np.unique(merged[inner], return_counts=True)
    start = np.concatenate([left[one], np.arange(m)])
    end = np.concatenate([right[one], np.arange(1, m + 1)])
    deep = np.concatenate([l[one], size])
    high = np.maximum(l[start], l[end])  # depth of the node above
    branches = np.concatenate([equal, np.zeros(m, np.int64)])
    real = np.flatnonzero(deep > high)
    count = (deep - high)[real]
    at = np.repeat(real, count)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + high[at] + 1
    order = np.lexsort((depth, start[at]))
    at, depth = at[order], depth[order]
    start, end, branches, deepest = start[at], end[at], branches[at], depth == deep[at]
    base = np.searchsorted(start, np.arange(m + 1))  # of each sequence, the first node that starts there

    # the node above: of the same start one less deep, else the entry's own one
    parent = np.arange(len(at)) - 1
    heads = base[inner]  # every sequence but the first starts a node, as it differs from the one before
    parent[heads] = base[left[inner]] + l[inner] - l[left[inner]] - 1

    goes_left, goes_right = (start == 0) & (depth <= before), (end == m) & (depth <= after)
    follows = np.concatenate([lcp[1:], [after]])
    is_leaf = size > follows
    leaves, members = np.concatenate([[0], np.cumsum(is_leaf)]), np.concatenate([[0], np.cumsum(n)])
    children = np.where(deepest, branches, 0) + np.where(goes_left, depth == before, size[start] > depth)
    offset = np.cumsum(size) - size
    last = np.where(depth > 0, words[np.minimum(offset[start] + depth - 1, max(len(words) - 1, 0))] if len(words) else 0, 0)
    n_convs = members[end] - members[start]
    crossing = goes_left | goes_right
    value = np.where(crossing, 0, (n_convs - 1) * last)
    total = np.concatenate([[0], np.cumsum(value)])
    lowest = _Least(least).of(start, end)
    ends = np.where((depth == size[start]) & ~goes_left, start, -1)
    has = parent >= 0
    return {
        "depth": depth, "least": lowest, "n_convs": n_convs, "n_children": children, "n_leaves": leaves[end] - leaves[start], "saved": total[base[end]] - total[:-1], "words": last, "ends": ends,
        "goes_left": goes_left, "goes_right": goes_right, "crossing": crossing, "parent_least": np.where(has, lowest[parent], 0), "parent_crossing": has & crossing[parent], "parent_left": has & goes_left[parent], "root": ~has,
    }


_NODE = "block int, depth long, least long, n_convs long, n_children long, n_leaves long, saved long, words long, ends_sha256 string, goes_left boolean, goes_right boolean, crossing boolean, parent_least long, parent_crossing boolean, parent_left boolean"


def shared_turns(offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it, 0 for the first; offsets: bounds of the sequences in h1 and h2."""
    size = np.diff(offsets)
    common = np.concatenate([[0], np.minimum(size[1:], size[:-1])]) if len(size) else size
    pair = np.repeat(np.arange(len(size)), common)
    depth = np.arange(len(pair)) - np.repeat(np.cumsum(common) - common, common)
    x, y = offsets[pair] + depth, offsets[pair - 1] + depth
    out = common.astype(np.int64)
    unlike = (h1[x] != h1[y]) | (h2[x] != h2[y])
    np.minimum.at(out, pair[unlike], depth[unlike])
    return out


def _scan_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's rows, one block: (block, before, after, n, least, ends_sha256, seq), in order."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    col = lambda c: rows.column(c).combine_chunks()
    seq = col("seq")
    offsets, turns = seq.offsets.to_numpy() - seq.offsets[0].as_py(), seq.flatten()
    h1, h2, words = (turns.field(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "words"))
    size = np.diff(offsets)
    ints = lambda c: col(c).to_numpy(zero_copy_only=False)
    out = block_nodes(shared_turns(offsets, h1, h2), size, ints("n"), ints("least"), words, int(ints("before")[0]), int(ints("after")[0]))
    hashes = pa.concat_arrays([col("ends_sha256"), pa.array([EMPTY])])
    ends = hashes.take(pa.array(np.where(out["ends"] < 0, len(size), out["ends"])))
    number = len(out["depth"])
    nums = {c: pa.array(out[c]) for c in ("depth", "least", "n_convs", "n_children", "n_leaves", "saved", "words")}
    parent = pa.array(out["parent_least"], mask=out["root"] | out["parent_crossing"])
    arrays = [pa.array(np.full(number, ints("block")[0], np.int32)), *nums.values(), ends, *(pa.array(out[c]) for c in ("goes_left", "goes_right", "crossing")), parent, *(pa.array(out[c]) for c in ("parent_crossing", "parent_left"))]
    table = pa.Table.from_arrays(arrays, ["block", *nums, "ends_sha256", "goes_left", "goes_right", "crossing", "parent_least", "parent_crossing", "parent_left"])
    yield from table.to_batches(max_chunksize=50_000)


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("long")


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, family: int, most: int) -> DataFrame:
    """(conv_id, seq): each conversation as its turns' (h1, h2, words), h1 and h2 128 bits of role and text.

    The first h turns are those of conversation c - c % family, h = crc32(c) %
    most, the others the own ones behind the first h.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, F.lit(0), role).alias("h2"), words.alias("words")
    )
    head = F.col("conv_id") - F.col("conv_id") % family
    # one shuffle, by the conversation that heads are taken from
    own = turns.withColumn("head", head).repartition("head").groupBy("head", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h1", "h2", "words"))).alias("t"))
    own = cut(own.select("head", "conv_id", F.transform("t", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["words"].alias("words"))).alias("t")))
    donors = own.where("conv_id = head").select("head", F.slice("t", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    seq = F.concat(F.slice(F.coalesce("first", F.array().cast(own.schema["t"].dataType)), F.lit(1), h), F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0))))
    return own.join(donors, "head", "left").select("conv_id", seq.alias("seq"))


def _ends(convs: DataFrame) -> DataFrame:
    """(s1, s2, ends_sha256): SHA-256 of the ids, ascending and comma-joined, of all conversations of a sequence.

    Ids are sorted over all tasks and written as chunks of text; then the
    chunks of a sequence go through one running hash, which nothing but a
    single reader can compute, in constant memory.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b, ids = (t.column(c).to_numpy() for c in range(3))
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            text = t.column(2).cast(pa.string()).to_pylist()
            joined = [",".join(text[i:j]) for i, j in zip(at, [*at[1:], len(a)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]), pa.array(joined)], ["s1", "s2", "first", "ids"])

        for batch in batches:
            held.append(batch)
            number += len(batch)
            if number >= CHUNK:
                yield flush()
                held, number = [], 0
        if number:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            a, b, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("s1", "s2", "ids"))
            done: list[tuple] = []
            for *own, ids in zip(a, b, text, strict=True):
                if own == key:
                    running.update(b",")
                else:
                    if key is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = own, hashlib.sha256()
                running.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["s1", "s2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running.hexdigest())], ["s1", "s2", "ends_sha256"])

    rows = convs.select("s1", "s2", "conv_id")
    spread = rows.repartitionByRange("s1", "s2", "conv_id").sortWithinPartitions("s1", "s2", "conv_id").mapInArrow(chunks, "s1 long, s2 long, first long, ids string")
    return spread.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "first").mapInArrow(digests, "s1 long, s2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most: int = 4, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations' prefixes, one row each.

    Conversations are rebuilt (see rebuilt), equal ones become one sequence
    with its number, least id and hash of ids, and the sequences are sorted
    over all tasks, in blocks of about ``block_turns`` turns. Each block
    computes the turns that neighbours share, all nearest smaller values of
    these and with them the nodes of the Cartesian tree, equal values merged
    and missing depths expanded; sums, least ids and leaves come from sums and
    minima over a node's interval (see block_nodes). A node that reaches over
    an end of its block comes out in parts, at most one a depth and end: for a
    depth, the nearest smaller value behind lies in the next block whose least
    value is below it, so a node's parts are one starting part, those of
    blocks without a smaller value, and a closing one (see _crossing).

    Rows: conv_id (least member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Rows of a
    conversation that share a turn number are ordered by hash; null turns come
    first; null roles and texts are empty; rows without conv_id take no part;
    an empty table gives no rows; further columns are ignored. Turns are told
    apart by 128 bits of hash. A conversation's hashes (24 bytes a turn) are
    one row.
    """
    whole = rebuilt(conversations, conv_col, turn_col, role_col, text_col, family, most)
    convs = stored(whole.select("conv_id", "seq", F.xxhash64("seq").alias("s1"), F.xxhash64(F.lit("second"), F.size("seq"), "seq").alias("s2")))
    same = convs.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    leaves = stored(same.join(_ends(convs), ["s1", "s2"]).join(convs.select(F.col("conv_id").alias("least"), "seq"), "least").select("seq", "n", "least", "ends_sha256"))
    turns = leaves.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    blocks = int(min(BLOCKS, max(8, turns // block_turns)))
    by_seq = leaves.repartitionByRange(blocks, "seq").sortWithinPartitions("seq")
    ordered = cut(by_seq.withColumn("block", F.spark_partition_id()))

    ends = ordered.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    row = Window.orderBy("block")  # one row a block
    ends = ends.select("block", F.coalesce(_common(F.lag("last").over(row), F.col("first")), F.lit(-1).cast("long")).alias("before"))
    ends = F.broadcast(cut(ends.select("block", "before", F.coalesce(F.lead("before").over(row), F.lit(-1).cast("long")).alias("after"))))
    nodes = stored(ordered.join(ends, "block").select("block", "before", "after", "n", "least", "ends_sha256", "seq").mapInArrow(_scan_block, _NODE))

    crossing, parts = _crossing(nodes.where("crossing"))
    known = nodes.where("not crossing and not parent_crossing").select("least", "depth", "parent_least", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    under = nodes.where("not crossing and parent_crossing").drop("parent_least").join(parts, ["block", "depth", "parent_left"]).select(known.columns)
    out = known.union(under).union(crossing.select(known.columns))
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def _crossing(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that parts make up, and (block, depth, parent_left, parent_least) for what lies under them.

    A part that doesn't go left starts a node; the next ones of its depth in
    later blocks, all going left, are of the same node up to the one that
    doesn't go right. A node's savings are those of its parts, which have the
    nodes inside blocks, and those of the crossing nodes below it: of the
    block where it starts those at least as deep, and all that start in the
    blocks behind that but for its last.
    """
    order = Window.partitionBy("depth").orderBy("block", F.col("goes_left").desc())
    chained = cut(parts.withColumn("chain", F.sum((~F.col("goes_left")).cast("long")).over(order)))
    nodes = chained.groupBy("depth", "chain").agg(
        F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.max("words").alias("words"), F.min("block").alias("start"), F.max("block").alias("end"),
        F.max(F.when(~F.col("goes_left"), F.struct("ends_sha256", "parent_left"))).alias("top"),
    )
    nodes = cut(nodes.select("*", "top.*", ((F.col("n_convs") - 1) * F.col("words")).alias("own")).drop("top"))
    deeper = F.sum("own").over(Window.partitionBy("start").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    started = nodes.groupBy("start").agg(F.sum("own").alias("t"))
    blocks = chained.select(F.col("block").alias("start")).distinct().join(started, "start", "left")
    upto = cut(blocks.select("start", F.coalesce("t", F.lit(0)).alias("t"), F.sum(F.coalesce("t", F.lit(0))).over(Window.orderBy("start")).alias("upto")))  # one row a block
    summed = nodes.withColumn("deeper", deeper).join(upto.select("start", F.col("upto").alias("at_start")), "start").join(upto.select(F.col("start").alias("end"), (F.col("upto") - F.col("t")).alias("at_end")), "end")
    summed = summed.select("*", (F.col("saved") + F.col("deeper") + F.col("at_end") - F.col("at_start")).alias("all_saved"))
    lookup = chained.select("block", "depth", "chain", "goes_left").join(nodes.select("depth", "chain", F.col("least").alias("parent_least")), ["depth", "chain"])
    lookup = cut(lookup.select("block", (F.col("depth") + 1).alias("depth"), F.col("goes_left").alias("parent_left"), "parent_least"))
    out = summed.join(lookup.withColumnRenamed("block", "start"), ["start", "depth", "parent_left"], "left")
    return out.select("least", "depth", "parent_least", "n_convs", "n_children", "n_leaves", F.col("all_saved").alias("saved"), "ends_sha256"), lookup

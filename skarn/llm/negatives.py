"""Hard-negative mining with ball trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import stored

#: Rows of a tree, about, trees at least (so that a small table is dealt out, too), rows of a leaf at most, and anchors that search a tree at once.
TREE_ROWS, LEAST_TREES, LEAF, ANCHORS = 16_384, 24, 32, 512
POSITIVES, NEGATIVES = 5, 3
#: Scores below this are summed exactly by float64 products, and leave bits for a row's place below them.
EXACT = 1 << 45


@dataclass
class Tree:
    """Ball tree over the rows of a block. A level's nodes are ranges of rows, halved from level to level; balls hold center and radius."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    #: Of each level: first row and end, center, radius, least and greatest label.
    levels: list[tuple[np.ndarray, ...]]


def _spread(vecs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows along the line between two far apart ones."""
    x = vecs[rows]
    a = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    return np.argsort(x @ (b - a), kind="stable")


def build(ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, leaf: int = LEAF) -> Tree:
    """A node of several labels is halved by label, one of a single label across its widest direction, until it has ``leaf`` rows."""
    vecs = vecs.astype(np.float64)
    order = np.argsort(labels, kind="stable")
    bounds, levels = [(0, len(ids))], []
    while True:
        rows = np.array(bounds)
        center, radius = np.empty((len(rows), vecs.shape[1])), np.empty(len(rows))
        for j, (a, b) in enumerate(bounds):
            x = vecs[order[a:b]]
            center[j] = x.mean(axis=0)
            radius[j] = np.sqrt(((x - center[j]) ** 2).sum(axis=1).max())
        own = labels[order]
        low, high = np.minimum.reduceat(own, rows[:, 0]), np.maximum.reduceat(own, rows[:, 0])
        levels.append((rows[:, 0], rows[:, 1], center, radius, low, high))
        if all(b - a <= leaf for a, b in bounds):
            break
        finer = []
        for j, (a, b) in enumerate(bounds):
            if b - a <= 1:
                finer += [(a, b), None]
                continue
            half = (a + b) // 2
            if low[j] == high[j]:
                order[a:b] = order[a:b][_spread(vecs, order[a:b])]
            else:  # rows are sorted by label: the change of label nearest to the middle
                change = a + 1 + np.flatnonzero(own[a + 1 : b] != own[a : b - 1])
                half = int(change[np.argmin(np.abs(change - half))])
            finer += [(a, half), (half, b)]
        bounds = [x for x in finer if x]
    return Tree(ids[order], labels[order], vecs[order], levels)


def _parents(tree: Tree, k: int) -> np.ndarray:
    """Of each node of level k, its node of level k - 1."""
    return np.searchsorted(tree.levels[k - 1][0], tree.levels[k][0], "right") - 1


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k first rows of its own (same) or of other labels whose score is in low to high; first: by score, then by id.

    A ball bounds inner products both ways: q.c - |q|r and q.c + |q|r. Level
    by level, nodes whose bounds lie outside the window or strictly beneath
    the current kth score go, as do those without a row that may count; the
    lower bounds of nodes of one right label inside the window raise the kth
    score before any row is looked at. What is left of the leaves is computed,
    each query's most promising leaf first.
    """
    q = vecs.astype(np.float64)
    norm = np.sqrt((q**2).sum(axis=1))
    m, n = len(tree.ids), len(ids)
    wide = float(norm.max(initial=0)) * float(np.sqrt((tree.vecs**2).sum(axis=1).max(initial=0))) * 1.01 >= EXACT
    kth = np.full(n, -np.inf)
    floor, ceiling = low.astype(np.float64), high.astype(np.float64)
    alive = upper = None
    for level, (start, end, center, radius, least, most) in enumerate(tree.levels):
        dot, reach = q @ center.T, norm[:, None] * radius[None, :]
        error = 1e-9 * (norm[:, None] * (np.sqrt((center**2).sum(axis=1)) + radius)[None, :] + 1)
        upper, lower = dot + reach + error, dot - reach - error
        mine = (least[None, :] == labels[:, None]) & (most[None, :] == labels[:, None])
        may = (least[None, :] <= labels[:, None]) & (labels[:, None] <= most[None, :]) if same else ~mine
        now = may & (upper >= floor[:, None]) & (lower <= ceiling[:, None])
        if alive is not None:
            now &= alive[:, _parents(tree, level)]
        # nodes all of whose rows count and lie inside the window: the kth score is at least the lower bound that k rows reach
        sure = now & (mine if same else (labels[:, None] < least[None, :]) | (labels[:, None] > most[None, :])) & (lower >= floor[:, None]) & (upper <= ceiling[:, None])
        if same:
            sure &= (end - start)[None, :] > 1  # the query itself may be the only row
        if sure.any():
            count = np.where(sure, (end - start - same)[None, :], 0)
            order = np.argsort(np.where(sure, -lower, np.inf), axis=1)
            reached = np.cumsum(np.take_along_axis(count, order, 1), axis=1) >= k
            at = np.argmax(reached, axis=1)
            value = np.take_along_axis(lower, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
            kth = np.maximum(kth, np.where(reached.any(axis=1), value, -np.inf))
        alive = now & (upper >= kth[:, None])

    exact = (lambda a, b: a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T) if wide else (lambda a, b: (a @ b.T).astype(np.int64))
    place = np.empty(m, np.int64)  # the greater, the smaller the id
    place[np.argsort(tree.ids, kind="stable")[::-1]] = np.arange(m)
    shift = max(m, 1)
    none = -(1 << 200) if wide else np.iinfo(np.int64).min
    top = np.full((n, k), none, object if wide else np.int64)  # score * shift + place, ascending
    start, end = tree.levels[-1][:2]

    def visit(j: int, who: np.ndarray) -> None:
        a, b = start[j], end[j]
        score = exact(q[who], tree.vecs[a:b])
        fits = (labels[who][:, None] == tree.labels[None, a:b]) == same
        fits &= (score >= low[who][:, None]) & (score <= high[who][:, None])
        if same:
            fits &= ids[who][:, None] != tree.ids[None, a:b]
        some = fits.any(axis=1)
        who, score, fits = who[some], score[some], fits[some]
        if len(who):
            key = np.where(fits, score * shift + place[None, a:b], none)
            top[who] = np.sort(np.concatenate([top[who], key], axis=1), axis=1)[:, -k:]
            full = top[who, 0] != none
            kth[who[full]] = np.maximum(kth[who[full]], (top[who[full], 0] // shift).astype(np.float64))

    promising = np.argmax(np.where(alive, upper, -np.inf), axis=1)
    hopeful = alive.any(axis=1)
    for j in np.unique(promising[hopeful]):
        visit(j, np.flatnonzero(hopeful & (promising == j)))
    for j in np.argsort(-np.where(alive, upper, -np.inf).max(axis=0), kind="stable"):
        who = np.flatnonzero(alive[:, j] & (upper[:, j] >= kth) & (promising != j))
        if len(who):
            visit(j, who)
    query, at = np.nonzero(top != none)
    value = top[query, at]
    row = np.empty(m, np.int64)
    row[place] = np.arange(m)
    rest = (value % shift).astype(np.int64)
    score = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in value // shift], np.int64) if wide else value // shift
    return query, row[rest], score


def _matrix(col: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors of size components; shorter ones end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    have = np.diff(col.offsets.to_numpy())
    values = col.flatten().to_numpy(zero_copy_only=False)
    if not size:
        return np.zeros((len(have), 0), np.int64)
    if len(have) and (have == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(have), size), np.int64)
    out[np.repeat(np.arange(len(have)), have), np.arange(len(values)) - np.repeat(np.cumsum(have) - have, have)] = values
    return out


def _packed(rows: DataFrame, blocks: int, extra: str = "") -> DataFrame:
    """(block, rows): the rows of each of about equal blocks, by id, as one Arrow stream."""

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        block = t.column("block").slice(0, 1).combine_chunks()
        t = t.drop(["block"]).combine_chunks()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return pa.Table.from_arrays([block, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(pack, "block int, rows binary")


def _pairs(queries: DataFrame, trees: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, of, row_id, score): each tree's k first rows for each query, a row of queries (vec_id, label, vec, of, low, high)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size = None, 0
        for batch in batches:
            for is_query, rows in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = pa.ipc.open_stream(rows.as_buffer()).read_all()
                vec = t.column("vec").combine_chunks()
                most = int(np.diff(vec.offsets.to_numpy()).max())
                if not is_query:
                    tree, size = build(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(vec, most)), most
                elif tree is not None:
                    ids, labels, of, low, high = (t.column(c).to_numpy() for c in ("vec_id", "label", "of", "low", "high"))
                    vecs = _matrix(vec, max(size, most))[:, :size]  # what is beyond meets zeros only
                    which, row, score = search(tree, ids, labels, vecs, low, high, k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(of[which]), pa.array(tree.ids[row]), pa.array(score)], ["anchor_id", "of", "row_id", "score"])

    asked = _packed(queries, max(1, -(-queries.count() // ANCHORS))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "rows")
    # a tree comes before the queries that it is asked
    both = trees.select("block", F.lit(False).alias("is_query"), "rows").union(asked).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    return both.mapInArrow(look, "anchor_id long, of long, row_id long, score long")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rank and rows: each key's k first rows."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95), tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """For each anchor and each of its nearest rows of its label, the nearest rows of other labels that score lower by a margin.

    Components become floor(scale * x), as integers; a score is an inner
    product of these. Positives of an anchor are its ``n_positives`` first
    other rows of its label (by score, then by smaller id); a pair's negatives
    are the ``n_negatives`` first rows of other labels with window[0] *
    positive <= 100 * negative <= window[1] * positive.

    Rows are dealt by a hash of the id to blocks of about ``tree_rows``, each of
    which gets a ball tree in its task (see build); the anchors, a stated set,
    go in blocks to every tree, which answers with its k first rows (see
    search); a window over the answers of all trees keeps the k first. Twice:
    for positives, then for negatives with the windows that these give.

    Rows: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Rows with a null id or label, a null vector, or any null or
    non-finite component take no part. Of rows that share an id the one with
    the least label and vector counts. Vectors of unequal length are compared
    as if the shorter ones ended in zeros. Scaled components beyond 2**53 are
    cut down to it, scores to 64 bits. An empty table, one without anchors and
    one of a single label give no rows; further columns are ignored.
    """
    limit = 1 << 53
    x = F.transform(F.col(vec_col), lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale).cast("double"), F.lit(float(-limit))), F.lit(float(limit))).cast("long"))
    finite = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = whole.select(F.col(id_col).cast("long").alias("vec_id"), F.struct(F.col(label_col).cast("long").alias("label"), x.alias("vec")).alias("r"), is_anchor.alias("anchor"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("r").alias("r"), F.max("anchor").alias("anchor")).select("vec_id", "r.label", "r.vec", "anchor"))
    blocks = max(LEAST_TREES, -(-rows.count() // tree_rows))
    trees = stored(_packed(rows.select("vec_id", "label", "vec"), blocks))
    all_of = lambda sign: F.lit(sign * ((1 << 63) - 1))
    anchors = rows.where("anchor").select("vec_id", "label", "vec")
    asked = anchors.withColumns({"of": F.lit(0).cast("long"), "low": all_of(-1), "high": all_of(1)})
    positives = stored(_first(_pairs(asked, trees, blocks, n_positives, True), ["anchor_id"], n_positives).select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("of")))
    scores = positives.where("of >= 0").select(F.col("anchor_id").alias("vec_id"), "of").distinct()
    # in decimals, which don't overflow
    low, high = (F.col("of").cast("decimal(20,0)") * w / 100 for w in window)
    asked = anchors.join(scores, "vec_id").withColumns({"low": F.ceil(low).cast("long"), "high": F.floor(high).cast("long")})
    found = _first(_pairs(asked, trees, blocks, n_negatives, False), ["anchor_id", "of"], n_negatives)
    out = positives.join(found, ["anchor_id", "of"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))

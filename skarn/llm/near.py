"""Near-duplicate documents: Order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import _MULT, U64, cut, gram_ok, grams, mix64, powers, text_slices, word_hashes
from skarn.llm.linking import link_classes, shared_buckets, small

#: Words of a shingle, and the least and most words of texts that are sketched by it. An edit breaks as many shingles as a shingle has words, so
#: short ones find what differs in a fifth of its words. Texts that can align share a kind: lengths overlap by more than a fifth.
SHINGLES = ((1, 1, 25), (2, 20, 60), (3, 48, 1 << 40))
#: Sketches of a document by each kind of shingle, sketches of a bucket's key, least alignment similarity.
SKETCHES, ROWS, SIMILARITY = 32, 1, 0.8

#: Longs of the bits that tell of two texts whether they can be similar. Texts of LONG words and more have twice as many, as
#: their words would fill the former, so that unlike texts of common words would pass; the halves make up the bits of shorter ones.
BIT_LONGS, LONG = 16, 256

#: Words up to which the alignment's band is held as bits of integers.
BIT_WORDS = 1 << 15

_SEEDS = mix64((np.arange(256, dtype=U64) + U64(77)) * _MULT)
_MAX = U64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k words, how often they came before in the document), in text order, and bounds. A document of 1 to k - 1 words is one shingle."""
    g = grams(words, k)
    at = np.flatnonzero(gram_ok(bounds, len(words), k))
    g = g[at]
    for n in range(1, k):
        short = bounds[:-1][np.diff(bounds) == n]
        if len(short):
            g, at = np.concatenate([g, grams(words, n)[short]]), np.concatenate([at, short])
    order = np.argsort(at, kind="stable")
    g, at = g[order], at[order]
    cuts = np.searchsorted(at, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(cuts))
    order = np.lexsort((g, doc))  # stable: equal ones stay in text order
    same = np.zeros(len(g), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(g)))) if len(g) else np.zeros(0, np.int64)
    count = np.empty(len(g), U64)
    count[order] = (np.arange(len(g)) - first).astype(U64)
    return mix64(g + count * _MULT), cuts


def order_minhash(v: np.ndarray, cuts: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """For each document with a shingle and each sketch: a hash of its two least labelled shingles, in text order."""
    full = np.flatnonzero(np.diff(cuts) > 0)
    starts = cuts[:-1][full]
    size = np.diff(cuts)[full]
    out = np.empty((len(full), sketches), U64)
    for s in range(sketches):
        h = mix64(v ^ _SEEDS[s])
        at = []
        for _ in range(2):
            least = np.minimum.reduceat(h, starts)
            p = np.flatnonzero(h == np.repeat(least, size))
            if len(p) != len(full):  # equal hashes in a document: the first one
                p = p[np.unique(np.searchsorted(starts, p, "right"), return_index=True)[1]]
            at.append(p)
            h[p] = _MAX
        one, two = np.minimum(*at), np.maximum(*at)
        single = size == 1
        out[:, s] = mix64(v[one] * U64(3) + mix64(np.where(single, U64(s + 1), v[two]) + U64(s)))
    return out


def all_sketches(words: np.ndarray, bounds: np.ndarray, shingles: tuple[tuple[int, int, int], ...] = SHINGLES, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sketches by all kinds of shingles for its length, one document after the other, and the number of kinds of each."""
    n = np.diff(bounds)
    docs, found = [], []
    for k, least, most in shingles:
        mine = (n >= least) & (n <= most)
        own = np.concatenate([[0], np.cumsum(n[mine])])
        docs.append(np.flatnonzero(mine))
        found.append(order_minhash(*labelled_shingles(words[np.repeat(mine, n)], own, k), sketches))
    docs = np.concatenate(docs)
    return np.concatenate(found)[np.argsort(docs, kind="stable")], np.bincount(docs, minlength=len(n))


def word_bits(words: np.ndarray, bounds: np.ndarray, longs: int = BIT_LONGS) -> np.ndarray:
    """``longs`` longs of bits for each document. Each (word, how often it came before) turns one bit, so as many bits as differ between two documents, their words differ in at least."""
    v, cuts = labelled_shingles(words, bounds, 1)
    size, n = 64 * longs, len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(cuts)) * size + (v % U64(size)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def all_bits(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all documents, one document after the other, and the number of longs of each."""
    n = np.diff(bounds)
    sizes = np.where(n >= LONG, 2 * BIT_LONGS, BIT_LONGS)
    out, begin = np.empty(sizes.sum(), np.int64), np.cumsum(sizes) - sizes
    for longs in (BIT_LONGS, 2 * BIT_LONGS):
        mine = sizes == longs
        own = word_bits(words[np.repeat(mine, n)], np.concatenate([[0], np.cumsum(n[mine])]), longs)
        out[begin[mine, None] + np.arange(longs)] = own.reshape(-1, longs)
    return out, sizes


def plausible(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether the lengths and bits of two texts allow an alignment; an edit changes the bag of words by two at most, by one where it changes the length."""
    limit = F.floor((1 - similarity) * F.greatest(x("size"), y("size")) + 1e-9)
    longer = F.abs(x("size") - y("size"))
    at = lambda of, j: F.coalesce(F.get(of("bits"), F.lit(j)), F.lit(0).cast("long"))
    halves = [tuple(at(x, j + k).bitwiseXOR(at(y, j + k)) for k in (0, BIT_LONGS)) for j in range(BIT_LONGS)]
    both = (F.size(x("bits")) > BIT_LONGS) & (F.size(y("bits")) > BIT_LONGS)
    differ = lambda parts: sum(map(F.bit_count, parts), F.lit(0))
    apart = F.when(both, differ(p for pair in halves for p in pair)).otherwise(differ(a.bitwiseXOR(b) for a, b in halves))
    return (longer <= limit) & (apart <= 2 * limit - longer)


def sequence_digest(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's word sequence."""
    out = []
    n = np.diff(bounds).astype(U64)
    for salt in (U64(1), _SEEDS[200]):
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(mix64(words ^ salt) * powers(max(1, len(words)))[: len(words)], out=total[1:])
        out.append(mix64((total[bounds[1:]] - total[bounds[:-1]]) * powers(len(words) + 1, True)[bounds[:-1]] + n))
    return out[0], out[1]


def _banded_bits(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance by bit vectors over the band (Hyyrö 2003); a is not the shorter one, limit at most its length.

    Bit p of a vector stands for row j - limit + p at column j; a column's
    vertical differences are +1 (up) or -1 (down).
    """
    n, m = len(a), len(b)
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows: dict[int, int] = {}
    for i, c in enumerate(codes[:n].tolist(), 1 + limit):
        rows[c] = rows.get(c, 0) | 1 << i
    mask = (1 << (2 * limit + 1)) - 1
    up, down, score = mask >> limit << limit, 0, limit
    for j, c in enumerate(codes[n:].tolist(), 1):
        match = rows.get(c, 0) >> j & mask
        diagonal = (((match & up) + up) ^ up) & mask | match | down
        right_up, right_down = down | mask ^ (diagonal | up), diagonal & up
        if j <= n - limit:  # along the band's lowest diagonal, then along the last row
            score += 1 - (diagonal >> 2 * limit)
            if score > limit + m - n + limit:
                return None
        else:
            at = n - j + limit
            score += (right_up >> at & 1) - (right_down >> at & 1)
        next_diagonal = diagonal >> 1
        up, down = right_down | mask ^ (next_diagonal | right_up), next_diagonal & right_up
    return score if score <= limit else None


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Insertions, deletions and substitutions from a to b, or None beyond limit.

    Only the diagonals up to ``limit`` off the main one are looked at: as bits
    of an integer up to BIT_WORDS words; in longer texts the furthest place on
    each diagonal is kept for each number of edits.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    size = min(n, m)
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - size :][::-1] != b[len(b) - size :][::-1])
    tail = int(differ[0]) if len(differ) else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= limit else None
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if max(n, m) - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:  # words without a partner
        return None
    if max(n, m) <= BIT_WORDS:
        return _banded_bits(*((a, b) if n >= m else (b, a)), min(limit, max(n, m)))
    step = 8
    pa_, pb = np.concatenate([a, np.zeros(step, a.dtype)]), np.concatenate([b, np.ones(step, b.dtype)])
    ends = np.arange(step)

    def slide(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((i < n) & (i + k < m) & (i >= 0) & (i + k >= 0))
        while len(live):
            x, y = i[live], i[live] + k[live]
            equal = pa_[x[:, None] + ends] == pb[y[:, None] + ends]
            equal &= (x[:, None] + ends < n) & (y[:, None] + ends < m)
            run = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
            i[live] += run
            live = live[run == step]
            live = live[(i[live] < n) & (i[live] + k[live] < m)]
        return i

    far = np.full(2 * limit + 3, -(10**9), np.int64)
    mid = limit + 1
    far[mid] = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for edits in range(limit + 1):
        if edits:
            lo, hi = max(1, mid - edits), min(2 * limit + 2, mid + edits + 1)
            k = np.arange(lo, hi) - mid
            i = np.maximum(np.maximum(far[lo:hi] + 1, far[lo - 1 : hi - 1]), far[lo + 1 : hi + 1] + 1)
            i = np.minimum(np.minimum(i, n), m - k)
            i[(i < 0) | (i + k < 0)] = -(10**9)
            far[lo:hi] = slide(i, k)
        if abs(m - n) <= limit and far[mid + m - n] >= n:
            return edits
    return None


def _signed(docs: DataFrame, shingles: tuple[tuple[int, int, int], ...], sketches: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                words, bounds = word_hashes(data, offs)
                sketch, kinds = all_sketches(words, bounds, shingles, sketches)
                lists = pa.ListArray.from_arrays(pa.array((np.concatenate([[0], np.cumsum(kinds)]) * sketches).astype(np.int32)), pa.array(sketch.ravel().view(np.int64)))
                flags, longs = all_bits(words, bounds)
                bits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(longs)]).astype(np.int32)), pa.array(flags))
                d1, d2 = sequence_digest(words, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.diff(bounds)), lists, bits], ["d", "d1", "d2", "n_words", "sketch", "bits"])

    return docs.mapInArrow(run, "d long, d1 long, d2 long, n_words long, sketch array<long>, bits array<long>")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs, with texts ta and tb as the last columns, those that align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [words[bounds[j] : bounds[j + 1]] for _, _, data, offs in text_slices(batch, "ta") for words, bounds in [word_hashes(data, offs)] for j in range(len(bounds) - 1)]
            right = [words[bounds[j] : bounds[j + 1]] for _, _, data, offs in text_slices(batch, "tb") for words, bounds in [word_hashes(data, offs)] for j in range(len(bounds) - 1)]
            good = pa.array([edit_distance(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) is not None for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:-2]], batch.schema.names[:-2])

    keys = [c for c in pairs.columns if c not in ("ta", "tb")]
    return pairs.select(*keys, "ta", "tb").mapInArrow(run, ", ".join(f"{c} long" for c in keys))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingles: tuple[tuple[int, int, int], ...] = SHINGLES, sketches: int = SKETCHES, rows: int = ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents, one row per input row.

    Each sketch takes the two least hashes among a document's shingles (of one
    to three words by its length, see SHINGLES), labelled by their occurrence,
    and keeps their text order (Order MinHash).
    Equal word sequences are one text from then on. Texts that share ``rows``
    consecutive sketches are candidates; link_classes compares all of them that
    no chain of links joins already, by length and bag of words first (which
    only leaves out what cannot align).
    Candidates are linked if a banded alignment of their words needs at most
    (1 - similarity) x the longer one's words of edits. Components of links
    are the classes.

    Returns id, class_id (least id of the class), kept (the row with that id),
    n_words. Ids must be integers. Words are runs of digits, a-z (A-Z
    lower-cased) and non-ASCII characters. Texts without words (null, empty)
    are one class. Rows that share an id are one document. Rows with a
    null id are kept, class_id null. An empty table gives no rows. Further
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    signed = cut(_signed(docs, shingles, sketches))
    firsts = cut(signed.where("d is not null").groupBy("d1", "d2").agg(F.min(F.struct("d", "sketch", "n_words", "bits")).alias("m")))
    texts = firsts.where("size(m.sketch) > 0").select(F.col("m.d").alias("node"), F.col("m").alias("m"))
    # rows that share an id are one document, which may have several texts: the one that is compared is the least, whatever the order of rows
    texts = cut(texts.groupBy("node").agg(F.min("m").alias("m")).select("node", "m.sketch", "m.n_words", "m.bits"))
    bands = sketches // rows
    keys = F.expr(f"transform(sequence(0, size(sketch) div {rows} - 1), j -> xxhash64(j % {bands}, slice(sketch, j * {rows} + 1, {rows})))")
    members = shared_buckets(texts.select("node", F.explode(keys).alias("key")))

    traits = texts.select("node", F.col("n_words").alias("size"), "bits")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = cut(pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct())
        used = docs.join(small(wanted), "d", "left_semi")
        both = pairs.join(used.select(F.col("d").alias("b"), F.col("text").alias("tb")), "b").join(used.select(F.col("d").alias("a"), F.col("text").alias("ta")), "a")
        return cut(_verified(both, similarity).distinct())

    classes = cut(link_classes(members, traits, lambda x, y: plausible(x, y, similarity), verify, similarity).withColumnRenamed("node", "text_id"))
    reps = firsts.select("d1", "d2", F.col("m.d").alias("text_id")).join(classes, "text_id", "left").select("d1", "d2", F.coalesce("comp", "text_id").alias("class_id"))
    out = signed.select("d", "d1", "d2", "n_words").join(reps, ["d1", "d2"], "left")
    return out.select(
        F.col("d").alias(id_col), F.when(F.col("d").isNotNull(), F.col("class_id")).alias("class_id"), (F.col("d").isNull() | (F.col("d") == F.col("class_id"))).alias("kept"), "n_words",
    )

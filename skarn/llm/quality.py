"""Document quality from preference pairs (Bradley-Terry)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import cut, text_slices, word_hashes
from skarn.llm.linking import likely_in
from skarn.operators.ranking import running_by_value

#: Preferred documents that each other one is paired with, about.
PAIRS_EACH = 4
#: Where predicted turns to 1.
THRESHOLD = 0.3
FEATURES = ["upper", "symbol", "digit", "space", "newline", "high", "pipe", "punct_run", "word_len", "distinct", "repeat", "top", "log_words", "log_bytes", "entropy"]

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0xC3:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+<=>@[\\]^_`{|}~/"]] = True
_PUNCT = _SYMBOL.copy()
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a slice; zeros for an empty one."""
    n_docs, size = len(offs) - 1, np.diff(offs)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(of, 1)

    letters = share(_LETTER[data], np.ones(n_docs))
    runs = _PUNCT[data]
    runs[1:] &= runs[:-1].copy()
    words, bounds = word_hashes(data, offs)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), n_words)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words, doc))
    d, w = doc[order], words[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(w)))
    top = np.zeros(n_docs)
    np.maximum.at(top, d[first], count)
    byte = np.zeros((n_docs, 32))  # a coarse histogram is enough for the entropy
    np.add.at(byte, (np.repeat(np.arange(n_docs), size), data & 31), 1)
    p = byte / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    n = np.maximum(n_words, 1)
    return np.stack(
        [
            np.sqrt(share(_UPPER[data], letters)), np.sqrt(share(_SYMBOL[data], size)), np.sqrt(share(_DIGIT[data], size)), share(data == 32, size), np.sqrt(share(data == 10, size)), share(data >= 0x80, size),
            np.sqrt(share(data == ord("|"), size)), np.sqrt(share(runs, size)), letters / n, np.bincount(d[first], minlength=n_docs) / n, np.sqrt(np.bincount(doc, again, minlength=n_docs) / n), np.sqrt(top / n),
            np.log1p(n_words), np.log1p(size), entropy,
        ],
        axis=1,
    )


class Ranking:
    """A linear score of scaled features and the cut that its quantile gives."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut_at: float, width: float, threshold: float) -> None:
        self.mean, self.scale, self.weights, self.cut_at, self.width, self.threshold = mean, scale, weights, cut_at, width, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, threshold exactly at the cut."""
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(4 * (self.raw(x) - self.cut_at) / self.width + at, -50, 50)))


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                x = features(data, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(j)[first:end] for j in range(len(keep))), lists], [*keep, "x"])

    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> Ranking | None:
    """Bradley-Terry weights from pairs of a preferred (label 1) and another document (label 0).

    All labelled rows are learned from; rows without a label or text play no
    part. Pairs meet by a hash bucket. The logistic loss on feature
    differences has no intercept. The cut is the quantile of the scores at the
    share of label 0 among all labelled rows; scales, scores and the cut are
    aggregates, the driver gets a few numbers. None if a label is missing.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    # texts without a label are left out before they are looked at, and only their features are joined
    texts = likely_in(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null"), "doc_id", known.select("doc_id"))
    learnt = cut(_featured(texts, ["doc_id"]).join(known, "doc_id"))
    each = range(len(FEATURES))
    counted = [F.count_if(F.col("label") == label).alias(f"n{label}") for label in (0, 1)]
    told = learnt.agg(*counted, *(F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in each), *(F.stddev_pop(F.get("x", F.lit(k))).alias(f"s{k}") for k in each)).first()
    if not told["n0"] or not told["n1"]:
        return None
    mean, scale = np.array([told[f"m{k}"] for k in each]), np.array([told[f"s{k}"] for k in each]) + 1e-6
    scaled = F.transform(F.arrays_zip("x", F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, scale.tolist())).alias("s")), lambda v: F.least(F.greatest((v["x"] - v["m"]) / v["s"], F.lit(-8.0)), F.lit(8.0)))
    buckets = max(1, told["n1"] // PAIRS_EACH)
    rows = learnt.select("label", scaled.alias("z"), F.pmod(F.xxhash64(F.lit("pair"), "doc_id"), F.lit(buckets)).alias("bucket"))
    good = rows.where("label = 1").select("bucket", F.col("z").alias("g"))
    pairs = good.join(rows.where("label = 0").select("bucket", F.col("z").alias("b")), "bucket")
    both = pairs.select(F.zip_with("g", "b", lambda g, b: g - b).alias("d"), F.lit(1.0).alias("label")).union(pairs.select(F.zip_with("g", "b", lambda g, b: b - g).alias("d"), F.lit(0.0).alias("label")))
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60, standardization=False).fit(both.select(array_to_vector("d").alias("features"), "label"))
    ranking = Ranking(mean, scale, fitted.coefficients.toArray(), 0.0, 1.0, threshold)
    terms = F.zip_with("z", F.array(*map(F.lit, ranking.weights.tolist())), lambda z, w: z * w)
    raw = cut(rows.select("label", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v).alias("raw")))
    weight = F.when(F.col("label") == 1, n[1] / told["n1"]).otherwise(n[0] / told["n0"])
    values = running_by_value(raw, "raw", {"w": F.sum(weight)})
    place = float(n[0])  # of n[0] + n[1], the weight of all
    above = values.where(F.col("w_below") + F.col("w") >= place * (1 - 1e-12)).agg(F.min(F.struct("raw", "w_below", "w")).alias("v")).first()["v"]
    below = values.where(F.col("raw") < above["raw"]).agg(F.max("raw").alias("raw")).first()["raw"]
    ranking.cut_at = above["raw"] if below is None else below + (above["raw"] - below) * min(1.0, max(0.0, (place - above["w_below"]) / above["w"]))
    ranking.width = raw.agg(F.stddev_pop("raw").alias("sd")).first()["sd"] + 1e-9
    return ranking


def score_quality(docs: DataFrame, ranking: Ranking | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of keep, id, score (0 to 1; higher: label 1 likelier), predicted (1 from the threshold on).

    Every row is scored from its whole text alone. Null and empty texts are
    scored like any other, by features of zero. Without a ranking all score
    0.5. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    n_keep = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                score = np.full(end - first, 0.5) if r is None else r.score(features(data, offs))
                predicted = (score >= (THRESHOLD if r is None else r.threshold)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(j)[first:end] for j in range(n_keep)), pa.array(score), pa.array(predicted)], [*batch.schema.names[:n_keep], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_keep])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int").withColumnRenamed("doc_id", id_col)

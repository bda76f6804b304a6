"""Language identification: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import _MULT, U64, cut, mix64, powers, sound, text_slices

#: Documents of each language that the model learns from at most; words and n-grams that it keeps; n-gram orders, longest first.
TRAIN_DOCS, VOCABULARY, GRAMS, ORDERS = 1500, 50_000, 60_000, (4, 3, 2, 1)
MAX_LANGS = 256
#: Words after which more of them no longer raise the certainty.
SURE_WORDS = 30

_TABLE = 0x20000
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of the first code points: which are letters; their lower case. Made once in each worker."""
    if not _tables:
        chars = [chr(c) for c in range(_TABLE)]
        _tables["alpha"] = np.array([c.isalpha() for c in chars])
        _tables["lower"] = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return _tables["alpha"], _tables["lower"]


def _value(code: np.ndarray) -> np.ndarray:
    return mix64((code.astype(U64) + U64(1)) * _MULT)


def hash_strings(strings: list[str]) -> np.ndarray:
    """The hash that runs of code points get below, for words or n-grams; ``^`` and ``$`` stand for a word's ends."""
    return np.array([_hash_codes(np.array([ord(c) for c in s], np.uint32)) for s in strings], U64)


def _hash_codes(code: np.ndarray) -> np.uint64:
    n = len(code)
    return mix64(np.array([(_value(code) * powers(n)).sum(dtype=U64) + U64(n)]))[0]


def _runs(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(code) + 1, U64)
    np.cumsum(_value(code) * powers(len(code)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(len(code) + 1, True)[starts] + (ends - starts).astype(U64))


class Model:
    """Scores (rows) by language (columns) for sorted hashes of words and of n-grams of each order."""

    def __init__(self, langs: list[str], words: tuple, grams: dict[int, tuple]) -> None:
        self.langs, self.words, self.grams = langs, words, grams

    @staticmethod
    def table(strings: list[str], counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hash_strings(strings)
        logs = np.log((counts + 0.5) / (totals + 0.5 * max(1, len(strings)))) if len(strings) else np.zeros((0, len(totals)))
        logs -= logs.mean(axis=1, keepdims=True) if len(strings) else 0  # what a word says of a language against the others
        order = np.argsort(h)
        return h[order], logs[order].astype(np.float32)

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
        return at, (table[at] == h if len(table) else np.zeros(len(h), bool))

    def score(self, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of word scores by document and language, and words of each document."""
        alpha, lower = _letters()
        small = code < _TABLE
        letter = alpha[np.where(small, code, 0)]
        if not small.all():
            rare, which = np.unique(code[~small], return_inverse=True)
            letter[~small] = np.array([chr(c).isalpha() for c in rare])[which]
        code = np.where(small, lower[np.where(small, code, 0)], code)
        n = len(code)
        fresh = np.ones(n, bool)
        fresh[1:] = ~letter[:-1]
        fresh[bounds[:-1][bounds[:-1] < n]] = True
        starts = np.flatnonzero(letter & fresh)
        last = np.ones(n, bool)
        last[:-1] = ~letter[1:] | fresh[1:]
        ends = np.flatnonzero(letter & last) + 1
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        if len(starts):
            h = _runs(code, starts, ends)
            at, known = self._find(self.words[0], h)
            out[known] = self.words[1][at[known]]
            new = np.flatnonzero(~known)
            if len(new):
                _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                out[new] = self._backoff(code, starts[new][first], ends[new][first])[back]
        cuts = np.searchsorted(starts, bounds)
        total = np.zeros((len(starts) + 1, len(self.langs)))
        np.cumsum(out, axis=0, out=total[1:])
        return total[cuts[1:]] - total[cuts[:-1]], np.diff(cuts)

    def _backoff(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean score of a word's known n-grams of the longest order of which any is known."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        todo = np.arange(len(starts))
        for n in self.grams:
            if not len(todo):
                break
            size = ends[todo] - starts[todo] + 2
            begin = np.cumsum(size) - size
            own = np.repeat(np.arange(len(todo)), size)
            inner = np.arange(len(own)) - begin[own] - 1
            text = code[np.clip(starts[todo][own] + inner, 0, len(code) - 1)].copy()
            text[begin], text[begin + size - 1] = ord("^"), ord("$")
            at = np.flatnonzero(inner + 1 + n <= size[own])
            place, known = self._find(self.grams[n][0], _runs(text, at, at + n))
            rows, words = self.grams[n][1][place[known]], own[at[known]]
            count = np.bincount(words, minlength=len(todo))
            sums = np.stack([np.bincount(words, rows[:, j], minlength=len(todo)) for j in range(len(self.langs))], axis=1)
            done = count > 0
            out[todo[done]] = sums[done] / count[done, None]
            todo = todo[~done]
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from rows with text and language; a sample of at most about train_docs of each language, by a hash of the id.

    The model is bounded: the MAX_LANGS languages with the most rows, the
    VOCABULARY commonest words and GRAMS commonest n-grams of each order of the
    sample. Words that it leaves out are scored by n-grams.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id")).where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], Model.table([], np.zeros((0, 0)), np.zeros(0)), {})
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == lang) & (share < train_docs / n[lang]))
    counts = [F.sum((F.col("lang") == x).cast("long")).alias(f"c{j}") for j, x in enumerate(langs)]
    words = cut(rows.where(keep).select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)")).alias("word")).groupBy("word").agg(*counts))
    names = [f"c{j}" for j in range(len(langs))]
    every = sum(F.col(c) for c in names)
    totals = np.array([x or 0 for x in words.agg(*(F.sum(c) for c in names)).first()], float)

    def top(df: DataFrame, key: str, limit: int) -> tuple[list[str], np.ndarray]:
        got = df.orderBy(F.desc(every), key).limit(limit).select(key, *names).collect()
        return [r[0] for r in got], np.array([r[1:] for r in got], float).reshape(len(got), len(langs))

    vocabulary = Model.table(*top(words.where(every >= 2), "word", VOCABULARY), totals)
    grams = {}
    for order in ORDERS:
        pieces = words.select(F.expr(f"explode(transform(sequence(1, length(word) + 3 - {order}), i -> substring(concat('^', word, '$'), i, {order})))").alias("gram"), *names)
        pieces = pieces.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names))
        strings, got = top(pieces, "gram", GRAMS)
        grams[order] = Model.table(strings, got, got.sum(axis=0))
    return Model(langs, vocabulary, grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """Language and certainty of every document.

    A known word scores by its log frequency in each language; an unseen one by
    its character n-grams (word ends are marked), of 4 characters if any is
    known, else of 3, 2, 1. The language with the greatest sum is predicted;
    score is its share by softmax of the sums, held to SURE_WORDS words.

    One row per input row: the columns of keep, id, lang_pred, score. Null
    texts and those without a letter are ``und`` with score 0, as is everything
    if nothing was learned. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    n_keep = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                raw, offs = sound(data, offs)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[offs]
                code = np.frombuffer(raw.decode(errors="replace").encode("utf-32-le"), np.uint32)
                if m.langs:
                    sums, n = m.score(code, chars)
                    sums *= (np.minimum(n, SURE_WORDS) / np.maximum(n, 1))[:, None]
                    best = np.where(n > 0, sums.argmax(axis=1), len(m.langs))
                    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    share = np.where(n > 0, share, 0.0)
                else:
                    best, share = np.zeros(end - first, int), np.zeros(end - first)
                yield pa.RecordBatch.from_arrays([*(batch.column(j)[first:end] for j in range(n_keep)), pa.array(names[best], pa.string()), pa.array(share, pa.float64())], [*batch.schema.names[:n_keep], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_keep])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)

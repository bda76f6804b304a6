"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import U64, cut, gram_ok, grams, text_slices, word_hashes

#: Phrases whose every place counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the method looks for, with the labels it adds.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
}
#: k of short texts (and phrases) and of longer ones; diagonals that far apart merge; share of a template's k-grams that must be found.
K_SHORT, K_LONG, LONG_FROM, GAP, COVER = 2, 3, 6, 2, 0.6


def longest_in_order(hits: list[tuple[int, int]], size: int) -> int:
    """Of a span's hits (place in the text, template position), sorted: the most distinct template positions that stand in order within a stretch of about ``size`` places."""
    reach, most = size + max(GAP, size // 4), 0
    for j, (first, _) in enumerate(hits):
        ends: list[int] = []  # the least position that ends a chain of each length
        i = j
        while i < len(hits) and hits[i][0] < first + reach:
            end = i
            while end < len(hits) and hits[end][0] == hits[i][0]:
                end += 1
            for _, at in reversed(hits[i:end]):  # of one place, only one position counts
                k = bisect_left(ends, at)
                ends[k : k + 1] = [at]
            i = end
        most = max(most, len(ends))
        if most == size:
            break
    return most


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, label, size, start, hits = (batch.column(j) for j in range(5))
        share = [longest_in_order([(h["pos"], h["tpos"]) for h in own], n) / n for own, n in zip(hits.to_pylist(), size.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([row, label, start, pa.array(share, pa.float64())], ["row_id", "label", "start", "share"])


def template_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def _positions(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(hash, template, template position) of all templates' k-grams: a few hundred constants."""
    rows = []
    for j, text in enumerate([*phrases, *templates]):
        words = template_words(text)
        k = K_LONG if j >= len(phrases) and len(words) >= LONG_FROM else K_SHORT
        rows += [(int(h), j, at) for at, h in enumerate(grams(words, k).view(np.int64))]
    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """License phrases and notices of each document.

    All rolling word 2-gram and 3-gram hashes of a document are matched with
    the templates' positions. The templates are constants of a few hundred
    positions, so their hashes filter the grams while a text is read; the
    grams left are joined with the positions in Spark, votes are summed by
    (document, template, offset diagonal), diagonals at most ``GAP`` apart
    are merged, and a merged span with enough votes is verified: it counts if
    ``cover`` of its template's k-grams, each once and in order, stand within
    a stretch of about the template's length (a quarter more, GAP at least). Phrases must stand whole: all their k-grams
    on one diagonal, which makes their words consecutive.

    One row per input row: id, n_words, n_base (places of phrases), first_word
    and last_word (least and greatest start of those, words from 0, or null),
    base_labels, labels (base ones and those of notices; both distinct,
    sorted, comma-joined), score (1 for a whole phrase or notice, else the
    best verified share; 0 without any). Words are runs of digits, a-z (A-Z
    lower-cased) and non-ASCII characters. Null texts are empty. A document
    with very many notices is only more rows of a grouped sum; a span's hits are gathered, which its document's length bounds. Rows with equal
    ids are scanned apart. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = _positions(phrases, templates)
    wanted = np.unique(np.array([r[0] for r in rows], np.int64)).view(U64)
    wanted.sort()
    sizes = {j: sum(r[1] == j for r in rows) for j in range(len(phrases) + len(templates))}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in text_slices(batch, "text"):
                words, bounds = word_hashes(data, offs)
                at, hit = [], []
                for k in (K_SHORT, K_LONG):
                    g = grams(words, k)
                    near = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                    p = np.flatnonzero((wanted[near] == g) & gram_ok(bounds, len(words), k))
                    at.append(p)
                    hit.append(g[p])
                at, hit = np.concatenate(at), np.concatenate(hit)
                order = np.argsort(at, kind="stable")
                at, hit = at[order], hit[order]
                cuts = np.searchsorted(at, bounds).astype(np.int32)
                doc = np.searchsorted(bounds, at, "right") - 1
                found = pa.StructArray.from_arrays([pa.array(hit.view(np.int64)), pa.array(at - bounds[doc])], ["hash", "pos"])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cuts), found)], ["doc_id", "n_words", "found"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.mapInArrow(emit, f"doc_id {kind}, n_words long, found array<struct<hash:long,pos:long>>")
    scanned = cut(scanned.withColumn("row_id", F.monotonically_increasing_id()))

    positions = spark.createDataFrame(rows, "hash long, tid int, tpos int")
    names = [*phrases.values(), *templates.values()]
    meta = spark.createDataFrame([(j, names[j], j < len(phrases), sizes[j]) for j in sizes], "tid int, label string, base boolean, size int")
    grams_found = scanned.where(F.size("found") > 0).select("row_id", F.explode("found").alias("f")).select("row_id", "f.hash", "f.pos")
    votes = grams_found.join(F.broadcast(positions), "hash").groupBy("row_id", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.collect_list(F.struct("pos", "tpos")).alias("hits"))
    votes = votes.join(F.broadcast(meta), "tid")
    phrase = votes.where("base and votes = size").select("row_id", "label", F.lit(True).alias("base"), F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    line = Window.partitionBy("row_id", "tid").orderBy("diagonal")
    spans = (
        votes.where("not base")
        .withColumn("fresh", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(line), F.lit(-(10**9))) > GAP).cast("int"))
        .withColumn("span", F.sum("fresh").over(line))
        .groupBy("row_id", "tid", "label", "size", "span")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("start"), F.flatten(F.collect_list("hits")).alias("hits"))
        .where(F.col("votes") / F.col("size") >= cover)
        .select("row_id", "label", "size", "start", F.array_sort("hits").alias("hits"))
        .mapInArrow(_verified, "row_id long, label string, start long, share double")
        .where(F.col("share") >= cover)
        .select("row_id", "label", F.lit(False).alias("base"), "start", "share")
    )
    found = (
        phrase.union(spans)
        .groupBy("row_id")
        .agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
    )
    return scanned.select("row_id", "doc_id", "n_words").join(found, "row_id", "left").select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

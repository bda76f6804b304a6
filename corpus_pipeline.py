"""The training-corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
works on all that the stage before it kept. Between stages the documents are
written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import contamination, language, lines, near, packing
from skarn.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain go.
LEAST_CERTAINTY = 0.4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; und and uncertain ones go."""
    model = language.learn(docs)
    judged = language.identify(docs, model, keep=("lang", "source", "n_chars", F.col("text").alias("whole")))
    return judged.where(f"lang_pred <> 'und' and score >= {LEAST_CERTAINTY}").withColumnRenamed("whole", "text").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all its lines goes, n_chars is counted anew."""
    out = lines.dedup_lines(docs)
    return out.where("n_removed = 0 or trim(text) <> ''").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    kept = near.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    judged = contamination.decontaminate(docs, _read(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return judged.where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages applied to ``documents``."""
    shared_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned language model nor the near-duplicate stages.
ORACLE_SQL = None

"""Joins of records with their metrics, and of results with each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(records: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Records with their metrics, 0 where there are none, and whether there were any."""
    names = [c for c in metrics.columns if c != key]
    joined = records.join(metrics.withColumn("matched", F.lit(True)), key, "left")
    return joined.select(*records.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in names), F.coalesce("matched", F.lit(False)).alias("matched"))


def matched_only(records: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Records that have metrics, with them."""
    return records.join(metrics, key)


def paired(a: DataFrame, b: DataFrame, key: str, error: str, columns: list[str]) -> DataFrame:
    """Rows of both results by key without rows that hold an error; columns of b end in _b."""
    right = b.where(F.col(error).isNull()).select(key, *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.where(F.col(error).isNull()).select(key, *columns).join(right, key)


def paired_means(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The means of value by key in both, for keys of both."""
    mean = lambda df, name: df.groupBy(key).agg(F.avg(value).alias(name))
    return mean(a, "mean_a").join(mean(b, "mean_b"), key)


def ids_of_all(arms: DataFrame, key: str, arm: str) -> DataFrame:
    """Ids that every arm has."""
    n = arms.select(arm).distinct().count()
    return arms.groupBy(key).agg(F.count_distinct(arm).alias("n")).where(F.col("n") == n).select(key)


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of parts, columns that a part lacks null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def flips(rows: DataFrame, key: str, rendering: str, base: str, verdict: Column) -> DataFrame:
    """By rendering but the base: rows with a base, agreeing ones, and changes of verdict up and down."""
    v = rows.select(key, F.col(rendering).alias("r"), verdict.alias("v"))
    both = v.where(F.col("r") != base).join(v.where(F.col("r") == base).select(key, F.col("v").alias("w")), key)
    return both.groupBy(F.col("r").alias(rendering)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("v = w")).alias("agree"), F.count_if(F.expr("v and not w")).alias("raised"), F.count_if(F.expr("w and not v")).alias("dropped"),
    )

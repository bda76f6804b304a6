"""Corpus audits: repeated targets and phrases, frames, label purity, verbatim copying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import frame, words
from skarn.operators.grams import commonest, word_grams


def distinct_targets(df: DataFrame, text: str) -> DataFrame:
    """Rows, distinct texts, and how often the commonest one stands."""
    return df.groupBy(text).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most_repeated"))


def repeated_parts(df: DataFrame, parts: Column, least_words: int, top: int) -> DataFrame:
    """The commonest parts (sentences, lines) of at least so many words: a top-k report."""
    rows = df.select(F.explode(parts).alias("part")).where(F.size(F.split(F.trim("part"), r"\s+")) >= least_words)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "part").limit(top)


def frame_ratio(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Distinct frames for each text."""
    out = df.select(*by, frame(F.col(text)).alias("f")).groupBy(*by).agg(F.count_distinct("f").alias("n_frames"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("ratio", F.round(F.col("n_frames") / F.col("n_rows"), 6))


def single_label_families(df: DataFrame, family: str, label: str) -> DataFrame:
    """Families and whether their rows have one label only."""
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_labels"), F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_share")).withColumn("single", F.col("n_labels") == 1)


def top_phrase(df: DataFrame, text: str, n: int, top: int) -> DataFrame:
    """The phrases of n words that most texts have: a top-k report."""
    found = commonest(df, words(F.coalesce(F.col(text), F.lit(""))), text, (n,), "df", top)
    return found.orderBy(F.desc("df"), "run").select(F.col("run").alias("phrase"), F.col("df").alias("n_texts"))


def cross_group_reuse(df: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """Of each group's distinct n-grams, how many another group has, too. Hashed where they are read and shuffled once, no self-join."""
    each = word_grams(df.select(F.xxhash64(group).alias("g"), text), ["g"], text, n, places=False).repartition("h").distinct()
    groups = F.count(F.lit(1)).over(Window.partitionBy("h"))  # rows of an n-gram: one for each group that has it
    found = each.select("g", (groups > 1).alias("shared")).groupBy("g").agg(F.count(F.lit(1)).alias("n_grams"), F.count_if("shared").alias("n_shared"))
    names = df.select(group).distinct().withColumn("g", F.xxhash64(group))
    return names.join(found, "g").select(group, "n_grams", "n_shared")


#: Fixed value: explanations that tell of a missing guard.
GUARD = (
    r"(?i)guard|missing check|missing.{0,12}(check|validation)|nil check|null check|unchecked|without check|no check|validat|sanitiz|bounds|out of range|"
    r"divide by zero|division by zero|zero.{0,10}(check|divisor)|empty (check|string|slice|list)|(nil|null)[ -]?(pointer|deref)"
)


def guard_share(findings: DataFrame, category: str, explanation: str, by: list[str]) -> DataFrame:
    """Findings of each group and category, and those whose category or explanation tells of a missing guard."""
    text = F.concat_ws(" ", F.coalesce(F.col(category), F.lit("")), F.coalesce(F.col(explanation), F.lit("")))
    hit = text.rlike(GUARD)
    return findings.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("guards"), F.round(F.avg(hit.cast("double")), 6).alias("share"))

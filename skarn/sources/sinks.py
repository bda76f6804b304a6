"""Writers that look at what they have staged before it is published."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.verify import prose_sentences

#: Share of all rows from which one target, or one sentence, is too much of a corpus, and words that a sentence has at least.
LEAST_SHARE, SENTENCE_WORDS = 0.10, 8
#: Fixed value: names of source files in a target.
SOURCE_FILE = r"\b[\w./-]+\.(?:c|go|java|js|ts|py|rb|rs|php|json|txt)\b"

Gate = Callable[[DataFrame], str | None]


class Refused(ValueError):
    """What was staged has not passed; nothing has been published. reasons: one for each gate that failed."""

    def __init__(self, reasons: list[str]) -> None:
        super().__init__("; ".join(reasons))
        self.reasons = reasons


def _share(part: int, of: int) -> str | None:
    return f"{100 * part / of:.0f}%" if of and part >= LEAST_SHARE * of else None


def no_repeated_target(target: str) -> Gate:
    """K1: no target makes up a tenth of the rows."""

    def gate(df: DataFrame) -> str | None:
        most = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
        share = _share(most.most or 0, most.rows or 0)
        return share and f"{share} of targets are one string"

    return gate


def no_repeated_sentence(target: str) -> Gate:
    """K1: no sentence of eight words or more stands as often as a tenth of the rows."""

    def gate(df: DataFrame) -> str | None:
        parts = df.select(F.explode(prose_sentences(F.col(target))).alias("s")).where(F.size(F.split("s", r"\s+")) >= SENTENCE_WORDS)
        most = parts.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        share = _share(most or 0, df.count())
        return share and f"one sentence stands in {share} of rows"

    return gate


def no_unseen_file(prompt: str, target: str) -> Gate:
    """K1: no target names a source file that its prompt doesn't."""

    def gate(df: DataFrame) -> str | None:
        names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(target), F.lit("")), F.lit(SOURCE_FILE), F.lit(0)))
        n = df.where(F.exists(names, lambda x: ~F.contains(F.coalesce(F.col(prompt), F.lit("")), x))).count()
        return f"{n} targets name a file that their prompt lacks" if n else None

    return gate


def whole_splits(split: str, label: str, expected: tuple[str, ...]) -> Gate:
    """K5: each expected split has rows, and rows of more than one label."""

    def gate(df: DataFrame) -> str | None:
        found = {r[0]: r for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")).where(F.col(split).isin(*expected)).collect()}  # a row a split
        empty, single = [s for s in expected if s not in found], [s for s in expected if s in found and found[s].labels < 2]
        said = [f"{what}: {', '.join(which)}" for what, which in (("empty", empty), ("of a single label", single)) if which]
        return f"splits {' and '.join(said)}" if said else None

    return gate


def publish(df: DataFrame, path: str, gates: list[Gate], by: tuple[str, ...] = (), refuse: bool = True) -> list[str]:
    """Write df as null-free JSON lines, look at what is written, then make it visible by one rename.

    Gates read the staged files, so what they have judged is what is published, and df is computed once. If one
    fails, the staged files go and Refused is raised; with refuse false they are published all the same and
    the reasons returned. A path that exists is never overwritten. by: columns that become folders.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        df.write.partitionBy(*by).option("ignoreNullFields", "true").json(staged.toString())
        read = spark.read.schema(df.schema).json(staged.toString())
        reasons = [r for r in (gate(read) for gate in gates) if r]
        if reasons and refuse:
            raise Refused(reasons)
        if not fs.rename(staged, target):
            raise OSError(f"{staged} could not be renamed to {path}")
        return reasons
    finally:
        fs.delete(staged, True)

"""Record sources and sinks: typed JSON lines, CSV and bench cases; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "struct<category: string, explanation: string, file: string>"
EFFECT = "struct<trigger: string, before: string, after: string, check: string, direction: string, confidence: string>"
ANALYSIS = f"struct<effect: {EFFECT}, summary: string, findings: array<{FINDING}>, confidence: string, affected_identifiers: array<string>, repair_direction: string>"
COMMIT = "commit_id string, project string, language string, buggy boolean, label string, subject string, files array<string>, diff string"
LABELLED = f"{COMMIT}, analysis {ANALYSIS}, teacher string, hinted boolean"
CHAT = "messages array<struct<role: string, content: string>>, label string, project string, rev string"
BENCH_CASE = "id string, language string, ext string, category string, buggy boolean, label string, parent string, renamed array<string>, note string"


def read_json_lines(spark: SparkSession, path: str, schema: str, need: str | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank lines and, if need is named, rows without that text are skipped. Lines that don't parse keep nulls and their text in _corrupt."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where(F.length(F.trim(need)) > 0) if need else df


def read_commits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a CSV with a header; a diff column is required, blank diffs are skipped, files and context are optional."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "diff" not in df.columns:
        raise ValueError("the file has no column named diff")
    for name in ("files", "context", "file_context"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.where(F.length(F.trim("diff")) > 0)


def read_bench_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of <path>/*/meta.json; label is coalesced from label and buggy."""
    df = spark.read.schema(BENCH_CASE).option("multiLine", True).json(f"{path}/*/meta.json")
    return df.withColumn("label", F.coalesce("label", F.when(F.col("buggy"), "buggy").otherwise("clean")))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Null-free JSON lines with the fields in column order."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of df whose key is not yet in the Parquet table at path; written there, too. For resumable ingest."""
    spark = df.sparkSession
    try:
        seen = spark.read.parquet(path).select(key)
    except Exception as e:  # the table may not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = None
    new = df.dropDuplicates([key]) if seen is None else df.dropDuplicates([key]).join(seen, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new

"""Incremental ingest and event windows as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """A stream of a folder's Parquet files that match glob, with their declared schema."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def dedup_stream(events: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed it."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    """Counts and sums by fixed windows; works on streams (give lateness) and tables alike."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, lateness: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap; works on streams and tables alike."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a bounded stream to its end into an in-memory table, for reports and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def capped_sink(stream: DataFrame, path: str, key: str, cap: int, id_col: str, order: Column, checkpoint: str) -> StreamingQuery:
    """Append at most cap rows of each key to path/rows, over all batches and restarts; an id that has come before is skipped.

    What each key has been given is a small table of its own, path/taken, a
    folder for each batch: a batch reads the folder before its own and never
    the rows written. Both folders of a batch are written over when it is run
    again, so a batch that was broken off leaves nothing twice. Ids seen are
    Spark's own keyed state, which restarts keep. Within a batch the first
    rows by ``order`` are taken; Spark cuts each task's rows to cap a key
    before it shuffles them. null is a key of its own.
    """
    top = Window.partitionBy(key).orderBy(order, id_col)

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        schema = rows.select(key).schema.add("taken", "long")
        had = spark.read.schema(schema).parquet(f"{path}/taken/batch={n - 1}") if n else spark.createDataFrame([], schema)
        had = had.select(F.col(key).alias("_key"), "taken")
        ranked = rows.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= cap)
        given = ranked.join(had, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_r") + F.coalesce("taken", F.lit(0)) <= cap)
        given.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        new = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={n}").groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("taken"))
        after = had.unionByName(new).groupBy(F.col("_key").alias(key)).agg(F.sum("taken").alias("taken"))
        after.write.mode("overwrite").parquet(f"{path}/taken/batch={n}")

    unseen = stream.dropDuplicates([id_col])
    return unseen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unsettled(tasks: DataFrame, attempts: DataFrame, id_col: str, status: str, settled: list[str] | None) -> DataFrame:
    """Tasks still to be tried: those without an attempt of a settled status (null: any attempt settles)."""
    done = attempts if settled is None else attempts.where(F.col(status).isin(settled))
    return tasks.join(done.select(id_col).where(F.col(id_col).isNotNull()), id_col, "left_anti")

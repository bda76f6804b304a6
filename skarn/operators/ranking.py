"""Ranks, running sums and samples that need no task to hold a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "rank") -> DataFrame:
    """Exact position (from 1) of each row within its keys, ordered by (bucket, *order).

    Rows are ranked within (keys, bucket), so a key with very many rows is
    spread over its buckets; what lower buckets hold is added from a table
    of their counts. bucket must not contradict the order.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = df.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    return inner.join(before, [*keys, bucket]).withColumn(name, F.col("_inner") + F.col("_off")).drop("_inner", "_off")


def hash_key(seed: int, id_col: str) -> Column:
    """A reproducible random order: MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_rank(df: DataFrame, keys: list[str], seed: int, id_col: str, name: str = "rank") -> DataFrame:
    """Position within keys in the reproducible random order; 256 buckets a key."""
    rows = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_b", F.substring("_h", 1, 2))
    return bucketed_rank(rows, keys, "_b", ["_h", id_col], name).drop("_h", "_b")


def running_by_value(df: DataFrame, value: str, sums: dict[str, Column], buckets: int = 64) -> DataFrame:
    """For each distinct value: sums over its rows and, as <name>_below, over rows with lower values.

    Rows are summed by value first. The values are dealt into ranges at
    approximate quantiles; running sums are taken within a range and added to
    the totals of lower ranges, of which there are at most ``buckets``.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(*(c.alias(n) for n, c in sums.items()))
    edges = by_value.agg(F.percentile_approx(value, [j / buckets for j in range(1, buckets)], 1000)).first()[0] or []
    rank = F.lit(0)
    for e in sorted(set(edges)):
        rank = rank + F.when(F.col(value) > e, 1).otherwise(0)
    rows = by_value.withColumn("_b", rank)
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_b").agg(*(F.sum(n).alias(f"_t_{n}") for n in sums))
    lower = totals.select("_b", *(F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_l_{n}") for n in sums))
    inner = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(lower), "_b")
    return rows.select(value, *sums, *((F.coalesce(F.sum(n).over(inner), F.lit(0)) + F.col(f"_l_{n}")).alias(f"{n}_below") for n in sums))


def cap_per_key(df: DataFrame, key: str, cap: int, seed: int, id_col: str) -> DataFrame:
    """At most cap rows of each key. The constant bound lets Spark cut groups before it deals them out."""
    w = Window.partitionBy(key).orderBy("_h", id_col)
    return df.withColumn("_h", hash_key(seed, id_col)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_h", "_r")


def cap_with_carry_in(df: DataFrame, done: DataFrame, key: str, cap: int, seed: int, id_col: str) -> DataFrame:
    """As cap_per_key, with the rows of done counted first and not given again."""
    had = df.join(done.select(id_col).distinct(), id_col, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_had"))
    rest = cap_per_key(df.join(done.select(id_col).distinct(), id_col, "left_anti"), key, cap, seed, id_col)
    ranked = rest.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(hash_key(seed, id_col), id_col)))
    return ranked.join(F.broadcast(had), key, "left").where(F.col("_r") + F.coalesce("_had", F.lit(0)) <= cap).drop("_r", "_had")


def balanced_sample(df: DataFrame, positive: Column, limit: int, seed: int, id_col: str) -> DataFrame:
    """L1: half positive rows as far as there are any, the rest negative ones."""
    rows = df.withColumn("_p", positive.cast("int")).withColumn("_h", hash_key(seed, id_col))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", id_col))).where(F.col("_r") <= limit)
    n_pos = F.broadcast(rows.agg(F.least(F.lit(limit // 2), F.coalesce(F.sum("_p"), F.lit(0))).alias("_n")))
    return rows.join(n_pos).where(F.col("_r") <= F.when(F.col("_p") == 1, F.col("_n")).otherwise(limit - F.col("_n"))).drop("_p", "_h", "_r", "_n")


def round_robin(df: DataFrame, bin_col: str, limit: int, seed: int, id_col: str) -> DataFrame:
    """The first of every bin, then the second of every bin, up to limit rows; slot is the place."""
    w = Window.partitionBy(bin_col).orderBy(hash_key(seed, id_col), id_col)
    first = df.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= limit)
    return first.orderBy("slot", bin_col).limit(limit)


def stratified_holdout(df: DataFrame, label: str, share: float, seed: int, id_col: str) -> DataFrame:
    """held_out for round(n * share) rows of each label (half to even)."""
    size = df.groupBy(label).agg(F.bround(F.count(F.lit(1)) * share).alias("_k"))
    return hash_rank(df, [label], seed, id_col, "_r").join(F.broadcast(size), label).withColumn("held_out", F.col("_r") <= F.col("_k")).drop("_r", "_k")


def group_holdout(df: DataFrame, group: str, n_groups: int, seed: int) -> DataFrame:
    """held_out for all rows of the first n_groups groups in the reproducible random order."""
    chosen = df.select(group).distinct().orderBy(hash_key(seed, group), group).limit(n_groups).withColumn("held_out", F.lit(True))
    return df.join(F.broadcast(chosen), group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def chronological_split(df: DataFrame, ts: str, id_col: str, share: float) -> DataFrame:
    """Train for the first int(n * share) rows by (ts, id); ranked day by day."""
    n = df.agg(F.floor(F.count(F.lit(1)) * share).alias("_k"))
    ranked = bucketed_rank(df.withColumn("_all", F.lit(0)).withColumn("_day", F.to_date(ts)), ["_all"], "_day", [ts, id_col], "_r")
    return ranked.join(F.broadcast(n)).withColumn("train", F.col("_r") <= F.col("_k")).drop("_all", "_day", "_r", "_k")


def quota_mix(df: DataFrame, key: str, quotas: dict[str, int], seed: int, id_col: str) -> DataFrame:
    """As many rows of each key as its quota says, others none."""
    w = Window.partitionBy(key).orderBy("_h", id_col)
    rows = df.where(F.col(key).isin(list(quotas))).withColumn("_h", hash_key(seed, id_col)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quotas.values()))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    return rows.where(F.col("_r") <= quota[F.col(key)]).drop("_h", "_r")


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys two tables share, and whether none."""
    shared = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    return shared.agg(F.count(F.lit(1)).alias("n_shared")).withColumn("disjoint", F.col("n_shared") == 0)

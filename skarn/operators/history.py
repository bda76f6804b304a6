"""Process-history features over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.ranking import bucketed_rank


def prior_count(df: DataFrame, keys: list[str], ts: str, id_col: str, name: str) -> DataFrame:
    """M1: events of the same keys before this one (by time, then id). Ranked day by day, so no key is held whole."""
    ranked = bucketed_rank(df.withColumn("_day", F.to_date(ts)), keys, "_day", [ts, id_col], name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_day")


def days_since_last(df: DataFrame, keys: list[str], ts: str, id_col: str, name: str) -> DataFrame:
    """M1: days since the keys' last event, null at the first."""
    w = Window.partitionBy(*keys).orderBy(ts, id_col)
    seconds = lambda c: c.cast("timestamp").cast("double")
    return df.withColumn(name, F.round((seconds(F.col(ts)) - seconds(F.lag(ts).over(w))) / 86400, 6))


def recent_experience(df: DataFrame, key: str, ts: str, id_col: str, name: str) -> DataFrame:
    """M1: sum of 1 / (years + 1) over the key's earlier days, an event counting by its day's age in days / 365.25.

    History is summed by day first; a day meets the key's earlier days, not its events.
    """
    days = df.select(F.col(key).alias("k"), F.to_date(ts).alias("day")).groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"))
    later = days.select("k", F.col("day").alias("now"))
    pairs = later.join(days, "k").where("day < now")
    score = pairs.groupBy("k", "now").agg(F.sum(F.col("n") / (F.datediff("now", "day") / 365.25 + 1)).alias(name))
    rows = df.withColumn("_day", F.to_date(ts)).join(score, (F.col(key) == F.col("k")) & (F.col("_day") == F.col("now")), "left")
    return rows.withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 6)).drop("k", "now", "_day")


def apart(df: DataFrame) -> DataFrame:
    """df, to be joined where both sides are dealt to: a history grows with its table, and what is broadcast is held by the driver first."""
    return df.hint("merge")


def first_touches_before(df: DataFrame, place: str, who: str, ts: str, id_col: str, name: str) -> DataFrame:
    """M1: distinct others and selves seen at a place before each event."""
    first = df.groupBy(place, who).agg(F.min(F.struct(ts, id_col)).alias("f")).select(place, F.col(f"f.{ts}").alias(ts), F.col(f"f.{id_col}").alias(id_col), F.lit(1).alias("_new"))
    rows = df.join(apart(first), [place, ts, id_col], "left").withColumn("_new", F.coalesce("_new", F.lit(0))).withColumn("_day", F.to_date(ts))
    per_day = rows.groupBy(place, "_day").agg(F.sum("_new").alias("_n"))
    before = per_day.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(place).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = Window.partitionBy(place, "_day").orderBy(ts, id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_new").over(inner), F.lit(0))).join(apart(before), [place, "_day"])
    return rows.withColumn(name, F.col("_in") + F.col("_off")).drop("_new", "_day", "_in", "_off")


def entropy(df: DataFrame, keys: list[str], part: str, weight: str) -> DataFrame:
    """Shannon entropy of a weight (not negative) over all parts, those without weight counted, by its maximum; 0 for a total of 0 or fewer than two parts."""
    parts = df.groupBy(*keys, part).agg(F.sum(weight).alias("w"))
    bits = F.when(F.col("w") > 0, F.col("w") * F.log2("w")).otherwise(0.0)
    total = parts.groupBy(*keys).agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(bits).alias("wl"))
    h = (F.log2("t") - F.col("wl") / F.col("t")) / F.log2(F.col("n").cast("double"))
    return total.select(*keys, F.round(F.when((F.col("n") < 2) | (F.col("t") == 0), 0.0).otherwise(h), 6).alias("entropy"))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order, in one grouped aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")

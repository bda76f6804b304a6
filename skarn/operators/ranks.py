"""Rank statistics with tied ranks averaged, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import let
from skarn.operators.ranking import running_by_value

#: Pairs up to which the signed-rank test counts all signs; beyond, and with ties, it takes the normal distribution.
EXACT_PAIRS = 50


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank, ties): the mean of the ranks that a value's rows have, and their number."""
    below = running_by_value(df, value, {"ties": F.count(F.lit(1))})
    return below.select(value, (F.col("ties_below") + (F.col("ties") + 1) / 2).alias("rank"), "ties")


def spearman(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """N and rho, the correlation of average ranks. Rows without one of the values take no part; rho is null if a side has a single value."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))  # ranks go by value, so equal pairs count once
    ranked = pairs.join(average_ranks(rows, "x").select("x", F.col("rank").alias("rx")), "x").join(average_ranks(rows, "y").select("y", F.col("rank").alias("ry")), "y")
    n, sums = F.sum("n"), {"sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") * F.col("rx"), "syy": F.col("ry") * F.col("ry"), "sxy": F.col("rx") * F.col("ry")}
    total = ranked.agg(n.alias("n"), *(F.sum(F.col("n") * c).alias(name) for name, c in sums.items()))
    spread = lambda a: F.col("n") * F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}")
    rho = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("x") * spread("y")))
    return total.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(rho, 6).alias("rho"))


def _share_up_to(n: Column, w: Column) -> Column:
    """Share of all signings of the ranks 1 to n whose positive ranks sum to at most w: the counts of each sum, folded in rank by rank."""

    def with_rank(counts: Column, k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(counts) + k - 1), lambda s: (F.coalesce(F.get(counts, s), F.lit(0.0)) + F.when(s >= k, F.coalesce(F.get(counts, s - k), F.lit(0.0))).otherwise(0.0)) / 2)

    return let(F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), with_rank), lambda c: F.aggregate(F.slice(c, 1, w + 1), F.lit(0.0), lambda a, x: a + x))


def signed_rank(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """The two-sided signed-rank test of x against y: n (pairs that differ), w_plus, w_minus, p.

    Ranks are those of the absolute differences, averaged over ties; equal pairs
    take no part. p counts all signings of up to EXACT_PAIRS pairs without ties;
    otherwise it is that of the normal distribution with its variance
    corrected for ties (null without pairs).
    """
    d = (x.cast("double") - y.cast("double")).alias("d")
    rows = df.select(d).where("d is not null and not isnan(d) and d <> 0").withColumn("size", F.abs("d"))
    sides = rows.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"))
    t = sides.join(average_ranks(rows, "size"), "size").agg(
        F.coalesce(F.sum("ties"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("plus") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("minus") * F.col("rank")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.max("ties"), F.lit(0)).alias("most"), F.coalesce(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")), F.lit(0.0)).alias("tied"),
    )
    w = F.least("w_plus", "w_minus")
    exact = F.least(2 * _share_up_to(F.when((F.col("n") <= EXACT_PAIRS) & (F.col("n") > 0), F.col("n").cast("int")).otherwise(F.lit(1)), w.cast("int")), F.lit(1.0))
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("tied") / 48)
    normal = _two_sided(F.try_divide(F.col("n") * (F.col("n") + 1) / 4 - w, sd))
    p = F.when(F.col("n") == 0, None).when((F.col("n") <= EXACT_PAIRS) & (F.col("most") <= 1), exact).otherwise(normal)
    return t.select("n", "w_plus", "w_minus", F.round(p, 6).alias("p"))


def _two_sided(z: Column) -> Column:
    """Probability of a normal value at least z from 0 (z >= 0), by a rational approximation whose error is below 1.2e-7."""
    t = 1 / (1 + 0.5 * z / F.sqrt(F.lit(2.0)))
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(0.0)
    for c in reversed(coefficients):
        power = power * t + c
    return t * F.exp(-z * z / 2 + power)

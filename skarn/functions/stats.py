"""Test statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the lower binomial tail, at most 1."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.when(i < n, F.ln((n - i) / (i + 1))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"] - n * math.log(2))).alias("sum"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), k), start, step, lambda s: s["sum"])))


def guarded(x: Column, y: Column) -> Column:
    """x / y, 0 when y is."""
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def seed_band(a: Column, b: Column) -> Column:
    """The values of two seeds as one number or a range."""
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))


def readable_move(base_a: Column, base_b: Column, new_a: Column, new_b: Column) -> Column:
    """Whether both seeds move the same way by more than the base seeds differ (and more than 2)."""
    a, b, band = new_a - base_a, new_b - base_b, F.greatest(F.abs(base_a - base_b), F.lit(2))
    return (
        F.when((a == 0) & (b == 0), "no - unchanged")
        .when(F.signum(a) * F.signum(b) <= 0, "no - seeds disagree")
        .when(F.least(F.abs(a), F.abs(b)) <= band, F.concat(F.lit("no - inside seed band (+-"), band.cast("string"), F.lit(")")))
        .otherwise(F.format_string("YES (%+d/%+d)", a, b))
    )

"""Evaluation metrics: confusion, ranking quality, thresholds, agreement, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.stats import guarded, mcnemar_p
from skarn.operators.ranking import running_by_value


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """A1: counts and precision, recall, F1, accuracy (0 where undefined) of each group; rows without a verdict are left out."""
    rows = df.select(*by, truth.alias("t"), predicted.alias("p")).where("t is not null and p is not null")
    out = rows.groupBy(*by).agg(F.count_if(F.expr("t and p")).alias("tp"), F.count_if(F.expr("not t and p")).alias("fp"), F.count_if(F.expr("t and not p")).alias("fn"), F.count_if(F.expr("not t and not p")).alias("tn"))
    out = out.withColumn("precision", guarded(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", guarded(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", guarded(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.withColumn("accuracy", guarded(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")))
    return out.select(*by, "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def trivial_baselines(df: DataFrame, positive: Column) -> DataFrame:
    """What always saying positive scores."""
    b = F.avg(positive.cast("double"))
    return df.agg(F.round(b, 6).alias("base_rate"), F.round(2 * b / (1 + b), 6).alias("always_f1"), F.round(b, 6).alias("always_accuracy"), F.round(1 - b, 6).alias("never_accuracy"))


def _ranked(df: DataFrame, positive: Column, score: str) -> DataFrame:
    one = positive.cast("long")
    return running_by_value(df.where(positive.isNotNull()), score, {"pos": F.sum(one), "neg": F.sum(1 - one)})


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """M8: area under the ROC curve, ties counted half."""
    r = _ranked(df, positive, score)
    return r.agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """M8: sum of recall gained times precision over distinct thresholds, from the highest score."""
    r = _ranked(df, positive, score)
    total = F.broadcast(r.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return r.join(total).agg(F.round(F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * tp / (tp + fp))), 6).alias("average_precision"))


def threshold_for_recall(df: DataFrame, positive: Column, score: str, recall: float) -> DataFrame:
    """M6: the positives' score at index int((1 - recall) * n), clamped, the recall there and the share of rows below it; no row without positives."""
    r = _ranked(df, positive, score)
    total = r.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum(F.expr("pos + neg")), F.lit(0)).alias("n"))
    at = F.least(F.floor((F.lit(1.0) - recall) * F.col("P")), F.col("P") - 1)
    hit = r.join(F.broadcast(total)).where((F.col("pos_below") <= at) & (at < F.col("pos_below") + F.col("pos")))
    hit = hit.select(F.round(score, 6).alias("threshold"), F.round((F.col("P") - F.col("pos_below")) / F.col("P"), 6).alias("recall"), F.round(1 - (F.col("n") - F.col("pos_below") - F.col("neg_below")) / F.col("n"), 6).alias("saved"))
    return hit


def operating_points(df: DataFrame, positive: Column, score: str, cuts: list[float]) -> DataFrame:
    """M7: at each cut: rows reviewed, recall, precision."""
    rows = df.select(positive.alias("t"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    out = rows.groupBy("cut").agg(F.count_if(F.expr("s >= cut")).alias("reviewed"), F.count_if(F.expr("s >= cut and t")).alias("tp"), F.count_if(F.expr("t")).alias("p"))
    return out.select("cut", "reviewed", F.round(guarded(F.col("tp"), F.col("p")), 6).alias("recall"), F.round(guarded(F.col("tp"), F.col("reviewed")), 6).alias("precision"))


def separation(df: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """True and false positive rate and their difference."""
    c = confusion(df, truth, predicted, by)
    tpr, fpr = guarded(F.col("tp"), F.col("tp") + F.col("fn")), guarded(F.col("fp"), F.col("fp") + F.col("tn"))
    return c.select(*by, F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), F.round(tpr - fpr, 6).alias("separation"))


def mcnemar(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """Discordant pairs of two graders and the exact p."""
    rows = df.select(*by, a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    out = rows.groupBy(*by).agg(F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("not a and b")).alias("only_b"))
    return out.withColumn("p", F.round(mcnemar_p(F.col("only_a"), F.col("only_b")), 6))


def kappa(df: DataFrame, a: Column, b: Column, by: list[str], at_chance: float | None = None) -> DataFrame:
    """Cohen's kappa of two graders over any grades; ``at_chance`` where chance agrees always (X5: null, X6: 1.0)."""
    keys = by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).select(*keys, a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    cells = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("a").alias("g")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*keys, F.col("b").alias("g")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*keys, "g"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    pe = F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    po = F.col("same") / F.col("total")
    return total.join(chance, keys, "left").select(*by, F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).otherwise(F.lit(at_chance)), 6).alias("kappa"))


def calibration(df: DataFrame, band: Column, correct: Column) -> DataFrame:
    """Share correct by confidence band; ungraded rows count in n only."""
    out = df.select(band.alias("band"), correct.alias("c")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("graded"), F.count_if(F.expr("c")).alias("correct"))
    return out.withColumn("share", F.round(guarded(F.col("correct"), F.col("graded")), 6))


def overlap_report(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Count, mean, upper median (the sorted value at n // 2) and share above 0."""
    v = df.select(*by, value.alias("v"))
    w = Window.partitionBy(*by).orderBy("v")
    ranked = v.withColumn("at", F.row_number().over(w) - 1)
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg((F.col("v") > 0).cast("double")), 6).alias("nonzero"))
    return ranked.join(n, by).where(F.col("at") == F.floor(F.col("n") / 2)).select(*by, "n", "mean", F.round("v", 6).alias("median"), "nonzero")


def pair_outcomes(df: DataFrame, pair: str, positive: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Of pairs with both a positive and a negative side: both flagged, neither, correct, backwards."""
    sides = df.groupBy(*by, pair).agg(F.bool_or(F.when(positive, predicted)).alias("p"), F.bool_or(F.when(~positive, predicted)).alias("q")).where("p is not null and q is not null")
    return sides.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *(F.count_if(F.expr(c)).alias(n) for n, c in (("both", "p and q"), ("neither", "not p and not q"), ("correct", "p and not q"), ("backwards", "q and not p"))))


def standardise_log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    """M3: log1p of values (negative ones are 0), less the mean, by the population's deviation (1 where it is under 1e-6)."""
    logs = df.select(*(F.log1p(F.greatest(F.col(c), F.lit(0))).alias(c) if c in columns else F.col(c) for c in df.columns))
    stats = logs.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
    return logs.join(F.broadcast(stats)).select(*(F.round(scaled(c), 6).alias(c) if c in columns else F.col(c) for c in df.columns))  # stats is one row

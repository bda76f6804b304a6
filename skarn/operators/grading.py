"""Grounding of findings in the code that they review, and the score card of a run's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.diff import changed_lines, files_in_diff, lines
from skarn.functions.text import content_words, decorated, identifiers, let
from skarn.operators.metrics import confusion
from skarn.operators.ranking import bucketed_rank

#: Plain names that a finding must share with code that has decorated ones, and categories that a card names at most.
PLAIN_NAMES, TOP = 3, 6


def grounded(file: Column, explanation: Column, diff: Column, context: bool = False) -> Column:
    """the finding names what stands in the changed lines (context: in all lines but headers).

    The file must be one that the diff touches, if one is given. One common
    decorated name is enough; of all names three must be common, or one if the code has no decorated
    ones.
    """
    code = F.array_join(F.filter(lines(diff), lambda x: ~x.rlike(r"^(diff --git|index|\+\+\+|---|@@)")) if context else changed_lines(diff), "\n")
    names = let(F.struct(code.alias("code"), F.coalesce(explanation, F.lit("")).alias("said")), lambda t: F.struct(
        decorated(t["code"]).alias("strong"), decorated(t["said"]).alias("said_strong"), F.size(F.array_intersect(identifiers(t["said"]), identifiers(t["code"]))).alias("common")))
    enough = let(names, lambda x: F.arrays_overlap(x["strong"], x["said_strong"]) | (x["common"] >= F.when(F.size(x["strong"]) == 0, 1).otherwise(PLAIN_NAMES)))
    elsewhere = (F.coalesce(file, F.lit("")) != "") & ~F.array_contains(files_in_diff(diff), file)
    return ~elsewhere & enough


def fix_agreement(explanation: Column, fix_diff: Column) -> Column:
    """T5: share of the explanation's content words that the repair has, too; null without a repair."""
    said = content_words(F.coalesce(explanation, F.lit("")))
    return F.when(F.coalesce(fix_diff, F.lit("")) != "", F.size(F.array_intersect(said, content_words(fix_diff))) / F.greatest(F.size(said), F.lit(1)))


def drop_ungrounded(findings: Column, direction: Column, diff: Column) -> Column:
    """struct of the findings that are grounded in the diff with its context, and the direction: with none left of some, nothing is said to change."""
    kept = F.filter(findings, lambda f: grounded(f["file"], f["explanation"], diff, context=True))
    emptied = lambda k: (F.size(k) == 0) & (F.size(findings) > 0) & direction.isNotNull()
    return let(kept, lambda k: F.struct(k.alias("findings"), F.when(emptied(k), F.lit("unchanged")).otherwise(direction).alias("direction")))


def score_card(results: DataFrame, by: list[str]) -> DataFrame:
    """A2: of each group of results: how many, the share without an error, confusion, findings, the share grounded, category match, agreement with the fix, median seconds, commonest categories.

    results: id, buggy, error, diff, fix_diff, seconds, findings (array of category, file, explanation), teacher
    (array of categories). A result with a finding says "buggy". Category match is the share, of results
    whose teacher has findings, with a category in common; agreement is the mean over findings with a fix. The
    median is the upper one of all results. Category ties go by name.
    """
    usable = results.where(F.coalesce("error", F.lit("")) == "")
    n = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce("error", F.lit("")) == "").cast("double")), 6).alias("valid"))
    said = F.coalesce(F.size("findings"), F.lit(0)) > 0
    cells = confusion(usable, F.col("buggy"), said, by)
    taught = usable.where(F.size("teacher") > 0).groupBy(*by).agg(F.round(F.avg(F.coalesce(F.arrays_overlap("teacher", F.transform("findings", lambda f: f["category"])), F.lit(False)).cast("double")), 6).alias("category_match"))
    each = usable.select(*by, "diff", "fix_diff", F.inline("findings"))
    rated = each.select(*by, "category", grounded(F.col("file"), F.col("explanation"), F.col("diff")).alias("g"), fix_agreement(F.col("explanation"), F.col("fix_diff")).alias("f"))
    found = rated.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.round(F.avg(F.col("g").cast("double")), 6).alias("grounded"), F.round(F.avg("f"), 6).alias("fix_agreement"), F.count("f").alias("n_fix"))
    common = rated.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "category"))).alias("c"))
    names = common.select(*by, F.array_join(F.transform(F.slice("c", 1, TOP), lambda x: F.concat_ws(":", x["category"], (-x["k"]).cast("string"))), ",").alias("categories"))
    timed = results.select(*by, "id", "seconds", F.floor(F.log2(F.greatest(F.col("seconds"), F.lit(1e-9)))).alias("_b"))
    middle = bucketed_rank(timed, by, "_b", ["seconds", "id"], "_r").join(n.select(*by, F.col("n").alias("_n")), by).where("_r = floor(_n / 2) + 1").select(*by, F.col("seconds").alias("median_seconds"))
    out = n.join(cells, by, "left").join(found, by, "left").join(taught, by, "left").join(names, by, "left").join(middle, by, "left")
    return out.withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)), "n_fix": F.coalesce("n_fix", F.lit(0)), "grounded": F.coalesce("grounded", F.lit(0.0))})

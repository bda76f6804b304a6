"""Checks of an answer's claims against measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.text import norm


def contradiction(differs: Column, before: Column, after: Column) -> Column:
    """the answer's verdict against its own two values; null if it agrees or gives no verdict."""
    same = norm(before) == norm(after)
    return F.when(differs & same, "says the runs differ but gives equal values").when(~differs & ~same, "says the runs agree but gives unequal values")


def swapped(claim_before: Column, claim_after: Column, before: Column, after: Column) -> Column:
    """F16: the measured value of after stands on the side of before: exchanged, or on both sides."""
    return (norm(before) != norm(after)) & (norm(claim_before) == norm(after)) & ((norm(claim_after) == norm(before)) | (norm(claim_after) == norm(claim_before)))


#: Fixed value: how a sentence states a change from one value to another.
FROM_TO = r"(?i)(?:from|was)\s+([^,;]{1,80}?)\s+(?:to|into|and\s+is\s+now|,?\s*now)\s+([^,;.]{1,80})"


def direction_reversed(text: Column, before: Column, after: Column) -> Column:
    """'from X to Y' where X is part of the measured after and not of before, and Y the other way round."""
    value = lambda i: F.regexp_extract_all(text, F.lit(FROM_TO), F.lit(i))
    bare = lambda x: F.btrim(norm(x), F.lit("`'\" "))
    pairs = F.zip_with(value(1), value(2), lambda x, y: F.struct(bare(x).alias("x"), bare(y).alias("y")))
    b, a = norm(before), norm(after)
    wrong = lambda p: (p["x"] != "") & (p["y"] != "") & F.contains(a, p["x"]) & ~F.contains(b, p["x"]) & F.contains(b, p["y"]) & ~F.contains(a, p["y"])
    return F.coalesce((b != a) & F.exists(pairs, wrong), F.lit(False))


def run_class(pre_failed: Column, post_failed: Column, same_output: Column) -> Column:
    """What a change did to a measured run."""
    return F.when(pre_failed & ~post_failed, "fixes").when(~pre_failed & post_failed, "breaks").when(same_output, "same").otherwise("changes")

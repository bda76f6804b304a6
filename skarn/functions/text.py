"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no defect meaning
STOP = (
    "a an the and or but if then than that this these those is are was were be been being to of in on at for with from by as it its into over under "
    "new old code line lines change changes commit method function call calls when which while not no null true false return returns set get add adds added remove "
    "removed use used using should would could may might can will"
).split()
#: fixed value: how a name starts, three characters or more
NAME = r"[A-Za-z_][A-Za-z0-9_.]{2,}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: as a lambda's argument, as Spark puts what a column holds in each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of three characters or more, without stop words."""
    return F.array_except(F.array_distinct(_all(F.lower(text), r"[A-Za-z_][A-Za-z0-9_]{2,}")), F.array(*map(F.lit, STOP)))


def decorated(text: Column) -> Column:
    """Distinct names with an underscore, a dot or a camel hump; lower case, outer dots off."""
    names = F.filter(_all(text, NAME), lambda t: t.rlike(r"_|\.|[a-z][A-Z]"))
    return F.array_distinct(F.transform(names, lambda t: F.lower(F.btrim(t, F.lit(".")))))


def identifiers(text: Column) -> Column:
    """Decorated names and plain ones that aren't stop words."""
    plain = F.filter(_all(text, NAME), lambda t: ~t.rlike(r"_|\.|[a-z][A-Z]"))
    plain = F.array_except(F.array_distinct(F.transform(plain, F.lower)), F.array(*map(F.lit, STOP)))
    return F.array_union(decorated(text), plain)


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return _all(F.lower(text), r"[a-z0-9_]+")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank, in order. tokens is computed once a row, as a lambda's argument."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.get(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<string>"))), F.lit(0))


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of the common content words of two texts; 0 when either has none."""
    both = F.size(F.array_intersect(content_words(a), content_words(b)))
    total = F.size(content_words(a)) + F.size(content_words(b))
    return F.when(total > 0, 2 * both / total).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' union; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def first_sentence(text: Column) -> Column:
    """Up to the first . ! or ? that white space follows, else all."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^(.*?[.!?])\s", 1), F.lit("")), text)


def sentences(text: Column) -> Column:
    """Split where white space follows . ! or ? and a capital comes."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def flatten_dashes(text: Column) -> Column:
    """Runs of Unicode dashes, hyphens and underscores, and of white space, become one blank; lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[-_‐-―−]+", " "), r"\s+", " ")


def terminated(text: Column) -> Column:
    """Up to the last . ! or ?, empty without one."""
    return F.btrim(F.regexp_extract(text, r"(?s)^(.*[.!?])", 1))


def norm(text: Column) -> Column:
    """Null is empty, white space collapses."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def frame(text: Column) -> Column:
    """Whole numbers become N, lower-case words ID, white space collapses: what is left is the structure."""
    out = F.regexp_replace(F.regexp_replace(text, r"\b[0-9]+\b", "N"), r"\b[a-z_][a-z0-9_]*\b", "ID")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: What differs from run to run in a program's output, and what stands for it, in this order.
VARYING = (
    (r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)", ""),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<time>"),
    (r"\b\d{1,2}:\d{2}:\d{2}\b", "<time>"),
    (r"(?i)\b\d+(?:\.\d+)?\s*\S*\s*ago\b", "<ago>"),
    (r"(?i)\b\d+(?:[.,]\d+)?(?:ms|s|h)\b|\b\d+(?:[.,]\d+)?\s+(?:ms|secs?|seconds?|minutes?|hours?)\b", "<dur>"),
)


def scrub(text: Column, root: Column | None = None) -> Column:
    """A program's output without what differs between runs: colours, the folder it ran in, times and durations; of a line that is drawn anew the last state. Null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r+(?=\n|\z)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\n]*\r", ""), r"[^\S\n]+(?=\n|\z)", "")
    (colour, nothing), *others = VARYING
    out = F.regexp_replace(out, colour, nothing)
    if root is not None:
        out = F.when(F.coalesce(root, F.lit("")) != "", F.replace(out, root, F.lit("<repo>"))).otherwise(out)
    for pattern, sign in others:
        out = F.regexp_replace(out, pattern, sign)
    return out

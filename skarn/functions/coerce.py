"""Coercion of near-miss values and small classifiers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of findings, directions and confidences, and what is read as them
CATEGORIES = ["null-dereference", "off-by-one", "resource-leak", "concurrency", "input-validation", "error-handling", "security", "api-misuse", "logic-error", "other"]
CATEGORY_ALIASES = {
    "runtime error": "logic-error", "runtime-error": "logic-error",
    "null pointer": "null-dereference", "npe": "null-dereference", "nullpointerexception": "null-dereference", "null-pointer": "null-dereference",
    "off by one": "off-by-one", "boundary": "off-by-one",
    "memory leak": "resource-leak", "leak": "resource-leak",
    "race condition": "concurrency", "race": "concurrency", "deadlock": "concurrency",
    "validation": "input-validation", "input validation": "input-validation",
    "error handling": "error-handling", "exception": "error-handling",
    "vulnerability": "security", "injection": "security",
    "api misuse": "api-misuse", "misuse": "api-misuse",
    "logic": "logic-error", "logic error": "logic-error",
}
DIRECTIONS = ["post-breaks", "post-fixes", "unchanged"]
DIRECTION_ALIASES = {
    "breaks": "post-breaks", "break": "post-breaks", "post_breaks": "post-breaks", "introduces": "post-breaks", "introduces-defect": "post-breaks",
    "regression": "post-breaks", "worse": "post-breaks", "buggy": "post-breaks",
    "fixes": "post-fixes", "fix": "post-fixes", "post_fixes": "post-fixes", "repairs": "post-fixes", "repair": "post-fixes", "better": "post-fixes",
    "no-change": "unchanged", "no change": "unchanged", "none": "unchanged", "same": "unchanged", "identical": "unchanged", "clean": "unchanged",
    "refactor": "unchanged", "no-op": "unchanged",
}
CONFIDENCES = ["likely", "possible"]
CONFIDENCE_ALIASES = {
    "high": "likely", "certain": "likely", "confident": "likely", "sure": "likely", "strong": "likely", "probable": "likely",
    "medium": "possible", "moderate": "possible", "low": "possible", "uncertain": "possible", "unsure": "possible", "maybe": "possible",
    "weak": "possible", "unclear": "possible",
}
TRUE_WORDS = ["1", "true", "yes", "buggy", "defective", "y"]
CHURN_BINS = [5, 15, 40, 100, 250, 500]


def _coerced(value: Column, aliases: dict[str, str], names: list[str], other: str) -> Column:
    key = F.lower(F.trim(value))
    table = F.create_map(*map(F.lit, chain.from_iterable(aliases.items())))
    return F.coalesce(F.try_element_at(table, key), F.when(key.isin(names), key), F.when(value.isNotNull(), F.lit(other)))


def category(value: Column) -> Column:
    """A category's name or alias, else other; null stays."""
    return _coerced(value, CATEGORY_ALIASES, CATEGORIES, "other")


def direction(value: Column) -> Column:
    """Unknown is unclear, never unchanged; null stays."""
    return _coerced(value, DIRECTION_ALIASES, DIRECTIONS, "unclear")


def confidence(value: Column) -> Column:
    """Unknown is possible; null stays."""
    return _coerced(value, CONFIDENCE_ALIASES, CONFIDENCES, "possible")


def is_true(value: Column) -> Column:
    """Text that stands for true; null is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def churn_bin(n: Column) -> Column:
    """Which of CHURN_BINS holds n, or 6."""
    out = F.lit(len(CHURN_BINS))
    for j in reversed(range(len(CHURN_BINS))):
        out = F.when(n <= CHURN_BINS[j], j).otherwise(out)
    return out


def risk_band(score: Column, threshold: float, high: float = 0.75) -> Column:
    """UNSCORED, HIGH, MEDIUM or LOW."""
    return F.when(score.isNull() | F.isnan(score), "UNSCORED").when(score >= high, "HIGH").when(score >= threshold, "MEDIUM").otherwise("LOW")


def first_id(*ids: Column) -> Column:
    """The first id that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in ids), F.lit(""))


def duration_seconds(value: Column) -> Column:
    """Seconds of 3, 9.202s or 1m26.4s; null if it is none of them."""
    pattern = r"^(?:(\d+(?:\.\d+)?)m)?(\d+(?:\.\d+)?)s?$"
    part = lambda i: F.nullif(F.regexp_extract(F.trim(value), pattern, i), F.lit("")).cast("double")
    return F.coalesce(part(1), F.lit(0.0)) * 60 + part(2)


def label_confidence(n_lines: Column, fan_out: Column, has_issue: Column) -> Column:
    """How firm a blamed label is, by blamed lines, commits that the fix blames, and a named issue."""
    c = 0.45 + F.least(n_lines, F.lit(20)) / 20 * 0.20 + 0.15 / F.sqrt(F.greatest(fan_out, F.lit(1))) + F.when(has_issue, 0.10).otherwise(0.0)
    return F.bround(F.least(c, F.lit(0.92)), 2)


def clean_confidence(descendants: Column) -> Column:
    """P25: how firm a clean label is, by the commits that came after without blaming it."""
    return F.bround(F.least(0.50 + F.sqrt(F.least(descendants, F.lit(2000)) / 2000) * 0.28, F.lit(0.78)), 2)


def variant_index(case_id: Column, copy: Column, n: int, salt: str = "") -> Column:
    """Which of n variants a copy of a case takes; copies rotate."""
    start = F.floor(F.crc32(F.concat(case_id.cast("string"), F.lit(":" + salt))) / 7)
    return F.pmod(start + copy, F.lit(n)).cast("int")


def is_fix_subject(subject: Column) -> Column:
    """a subject that tells of a repair (not of typos, style or docs) and is long or names an issue."""
    repair = r"(?i)\b(fix(e[sd])?|bugfix|hotfix|patch(ed)?|resolve[sd]?|correct(ed)?)\b(?!\s+(typo|lint|format|style|doc|readme|comment|test))"
    return subject.rlike(repair) & (subject.rlike(r"#\d+|[A-Z]+-\d+") | (F.length(subject) > 20))

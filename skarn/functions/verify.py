"""Checks of a review's prose against what was measured: rules in order, the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.claims import FROM_TO
from skarn.functions.diff import changed_lines
from skarn.functions.text import let, norm

#: How prose claims what no run showed. In this order, with the reason of each kind.
UNMEASURED = {
    "claims the change is harmless": (
        r"\b(?:does|do|did|will|would|should)\s+not\s+(?:affect|change|alter|impact|break)\b",
        r"\bno\s+(?:new\s+)?(?:bugs?|defects?|regressions?|side[- ]?effects?)\b",
        r"\b(?:does|do|did|will|would|should)\s+not\s+introduce\b[^.]{0,30}?\b(?:bugs?|defects?|regressions?|errors?|issues?|problems?|side[- ]?effects?)\b",
        r"\bnothing\s+(?:is|was|has\s+been)\s+broken\b",
        r"\b(?:appears?|seems?|looks?)\s+(?:to\s+be\s+)?(?:correct|fine|safe|harmless|ok(?:ay)?)\b",
        r"\bno\s+(?:effect|impact|functional\s+change|behaviou?ral\s+change)\b",
        r"\bno\s+change\s+in\s+behaviou?r\b",
        r"\bnon-?functional\b",
        r"\bfunctionally\s+equivalent\b",
        r"\b(?:is|are|remains?|stays?)\s+(?:safe|harmless|unaffected)\b",
        r"\bbehaviou?r\s+(?:is|remains?|stays?)\s+(?:the\s+same|unchanged|identical)\b",
        r"\b(?:purely\s+)?cosmetic\b",
    ),
    "claims the change is a defect": (
        r"\bwill\s+(?:fail|crash|throw|break|error|return\s+the\s+wrong)\b",
        r"\b(?:is|introduces|causes|creates)\s+(?:an?\s+)?(?:bug|defect|regression|off-by-one)\b",
        r"\bis\s+(?:incorrect|wrong|broken|buggy)\b",
    ),
    "blames the run's outcome on this change": (
        r"\bcaus(?:es|ed|ing)\b[^.]{0,40}?\bto\s+(?:fail|crash|break|error|throw)\b",
        r"\b(?:results?|resulted|resulting)\s+in\b[^.]{0,30}?\b(?:failure|crash|error)\b",
        r"\bleads?\s+to\b[^.]{0,30}?\b(?:failure|crash|error)\b",
        r"\bmak(?:es|ing)\b[^.]{0,30}?\b(?:fail|crash|break)\b",
        r"\bexit\s+(?:status|code)\s+(?:changed|becomes?|is\s+now|went)\b",
        r"\bthe\s+(?:program|run|command|tests?)\s+(?:now\s+)?(?:fails?|crashes?|errors?|passes?|succeeds?)\b",
        r"\b(?:did|does|do|would|will)\s+not\s+(?:resolve|fix|address|solve)\b",
    ),
}
#: The same where the runs before and after failed alike.
OBSERVED = {
    "reports an observation that was never made": (
        r"\bthe\s+output\s+(?:remains?|stays?|is\s+still|became?|changed|is\s+now)\b",
        r"\bstill\s+(?:prints?|outputs?|returns?)\b",
    ),
}
#: How prose says that a named thing was removed, and what stands before a name that is no subject.
_NAMED = r"`?([A-Za-z_][\w.]{2,})`?"
REMOVED = (
    _NAMED + r"\s+(?:method|function|field|call|parameter|argument|variable|property)?\s*(?:was|were|has been|have been|is|are)\s+(?:removed|deleted|dropped|stripped)",
    r"(?:the\s+(?:change|commit|diff|edit|patch)|this|it|which)\s+(?:also\s+)?(?:removes|deletes|drops|strips|removed|deleted|dropped|stripped)\s+(?:the\s+)?" + _NAMED,
)
OBJECT_OF = r"(?i)\b(?:with|from|by|against|into|onto|than|via|racing|holding|using|calling|matching|carrying|beating|after|before|during|for|to|of|on|in|at)\s+(?:an?|the|its|their|any|some)?\s*`?$"
#: Numbers that prose may always name, and characters that it has at least.
FREE_NUMBERS, LEAST = ("0", "1", "2"), 15


def _quoted(x: Column) -> Column:
    plain = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(plain, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def unmeasured_claim(prose: Column, baseline_broken: Column) -> Column:
    """the first claim that an unexercised run can't support, with its words; null without one."""

    def found(kinds: dict[str, tuple[str, ...]]) -> list[Column]:
        said = lambda p: F.regexp_extract(prose, f"(?i){p}", 0)
        return [let(said(p), lambda m, why=F.lit(why): F.lit(None)) if False else F.when(said(p) != "", F.concat(F.lit(f"{why} ("), _quoted(said(p)), F.lit(") with nothing measured"))) for why, patterns in kinds.items() for p in patterns]

    return F.coalesce(*found(UNMEASURED), F.when(baseline_broken, F.coalesce(*found(OBSERVED))))


def code_like(name: Column, prose: Column) -> Column:
    """a symbol, not a word: in backticks, with an underscore, a dot or a camel hump, or capitalised."""
    return F.contains(prose, F.concat(F.lit("`"), name, F.lit("`"))) | name.rlike(r"[_.]|^\p{Lu}|\p{Ll}\p{Lu}")


def phantom_removal(prose: Column, diff: Column) -> Column:
    """the first thing that is said to be removed though no removed line names it; null without one.

    Words and objects of a phrase ("with the `X` was") are no such things. What stands before a name is looked at up to the last statement of the kind.
    """

    def named(pattern: str, before: int, name: int) -> Column:
        every = lambda g: F.regexp_extract_all(prose, F.lit(f"(?is)(.*?)({pattern})"), F.lit(g))
        return F.zip_with(every(before), F.zip_with(every(2), every(name), lambda s, n: F.struct(s.alias("said"), n.alias("name"))), lambda b, x: F.struct(b.alias("before"), x["said"].alias("said"), x["name"].alias("name")))

    upto = lambda x: F.concat(x["before"], F.call_function("substring_index", x["said"], x["name"], F.lit(1)))
    subject = lambda x: code_like(x["name"], prose) & ~upto(x).rlike(OBJECT_OF)
    first = F.get(F.filter(F.concat(*(named(p, 1, 3) for p in REMOVED)), subject), F.lit(0))["name"]
    last = F.element_at(F.split(first, r"\."), -1)
    missing = lambda n: n.isNotNull() & ~F.exists(changed_lines(diff, "-"), lambda x: F.contains(x, n))
    why = let(last, lambda n: F.when(missing(n), F.concat(F.lit("says "), _quoted(n), F.lit(" was removed, but no removed line in the diff mentions it"))))
    return F.when(prose.rlike("(?i)remov|delet|drop|strip"), why)  # one of these stands in every such statement


def reversed_claim(prose: Column, before: Column, after: Column) -> Column:
    """F17 with its reason: 'from X to Y' where X is part of the measured after only and Y of before only."""
    value = lambda i: F.regexp_extract_all(prose, F.lit(FROM_TO), F.lit(i))
    bare = lambda x: F.btrim(norm(x), F.lit("`'\" "))
    pairs = F.zip_with(value(1), value(2), lambda x, y: F.struct(bare(x).alias("x"), bare(y).alias("y")))
    sides = F.struct(norm(before).alias("b"), norm(after).alias("a"))
    wrong = lambda p, b, a: (p["x"] != "") & (p["y"] != "") & (p["x"] != p["y"]) & F.contains(a, p["x"]) & ~F.contains(b, p["x"]) & F.contains(b, p["y"]) & ~F.contains(a, p["y"])
    first = let(sides, lambda v: F.when(v["b"] != v["a"], F.get(F.filter(pairs, lambda p: wrong(p, v["b"], v["a"])), F.lit(0))))
    said = lambda p: F.when(p.isNotNull(), F.concat(F.lit("states the change as "), _quoted(p["x"]), F.lit(" -> "), _quoted(p["y"]), F.lit("; the measurement is the reverse")))
    return let(first, said)


def verdict(prose: Column, before: Column, after: Column, diff: Column, measured: Column, baseline_broken: Column, may_judge: bool = False) -> Column:
    """why prose must not be shown: the first rule that fails; null if it may be.

    Too short; a number that no side and no line has; a claim that nothing measured supports (unless measured, or the
    prose may judge from reading); a removal that didn't happen; a change told backwards.
    """
    numbers = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"-?\d+"), F.lit(0))
    invented = F.array_sort(F.array_except(numbers(prose), F.concat(numbers(before), numbers(after), numbers(diff), F.array(*map(F.lit, FREE_NUMBERS)))))
    listed = F.when(prose.rlike(r"\d"), let(invented, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("invented ['"), F.array_join(F.slice(x, 1, 2), "', '"), F.lit("']")))))
    blank = F.length(F.btrim(F.regexp_replace(F.coalesce(prose, F.lit("")), r"^\s+|\s+$", ""))) < LEAST
    unsupported = F.lit(None).cast("string") if may_judge else F.when(~measured, unmeasured_claim(prose, baseline_broken))
    return F.coalesce(F.when(blank, "empty"), listed, unsupported, phantom_removal(prose, diff), reversed_claim(prose, before, after))


def prose_sentences(prose: Column) -> Column:
    """Sentences: cut at white space behind . ! or ? and before a capital, a backtick or a quote, so not within code or numbers."""
    parts = F.transform(F.split(F.coalesce(prose, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z`\"'])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def filtered_prose(prose: Column, before: Column, after: Column, diff: Column, measured: Column, baseline_broken: Column, may_judge: bool = False) -> Column:
    """struct of kept, the sentences that pass the rules, and dropped, the reasons of the others, both in order."""
    judged = F.transform(prose_sentences(prose), lambda s: F.struct(s.alias("text"), verdict(s, before, after, diff, measured, baseline_broken, may_judge).alias("why")))
    texts = lambda j, passes, field: F.transform(F.filter(j, lambda x: x["why"].isNull() if passes else x["why"].isNotNull()), lambda x: x[field])
    return let(judged, lambda j: F.struct(F.array_join(texts(j, True, "text"), " ").alias("kept"), texts(j, False, "why").alias("dropped")))

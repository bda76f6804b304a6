"""The structure of a unified diff: hunks, places of lines on both sides, columns side by side.

All within a row and by built-in functions: a diff is an array of its lines,
what a line belongs to is the last header before it, and its number is its
hunk's first one and the lines of that side in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.diff import lines
from skarn.functions.text import let

#: How lines begin that are no content, a hunk's header, and a definition.
NO_CONTENT = r"^(diff |index |--- |\+\+\+ |old mode|new mode|new file|deleted file|similarity |rename |Binary )"
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
DEFINITION = r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"

_FAR = 1 << 30


def _where(rows: Column, test: Callable[[Column], Column]) -> Column:
    """Indices of the elements that pass a test."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _upto(indices: Column, i: Column) -> Column:
    """The last of some indices up to i; null without one."""
    return F.array_max(F.filter(indices, lambda p: p <= i))


def _behind(x: Column) -> Column:
    return F.substring(x, 2, _FAR)


def _runs(rows: Column, ends_run: Callable[[Column], Column]) -> Column:
    """Stretches between lines that end a run: (first index, their lines, the line that ends it or null)."""
    at = F.concat(F.array(F.lit(-1)), _where(rows, ends_run), F.array(F.size(rows)))
    return let(at, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.struct(
        (F.get(b, k) + 1).alias("first"), F.slice(rows, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1).alias("rows"), F.get(rows, F.get(b, k + 1)).alias("end"))))


def changed_places(diff: Column) -> Column:
    """Each changed line as (offset, path, hunk, old_no, new_no, sign, text, enclosing).

    path, hunk and enclosing are those of the last new-side header, hunk header
    and definition above; a definition holds up to its file's or hunk's end,
    and a hunk's header may name one behind its ranges. old_no is null for an
    added line, new_no for a removed one. Lines before the first hunk and
    behind a hunk's end (a header of the next file) are none.
    """

    def places(d: Column) -> Column:
        rows = d["rows"]

        def place(i: Column) -> Column:
            x, head = F.get(rows, i), _upto(d["heads"], i)
            header, path = F.get(rows, head), F.get(rows, _upto(d["paths"], head))
            before = lambda indices: F.size(F.filter(indices, lambda p: (p > head) & (p < i)))
            number = lambda group, others: F.regexp_extract(header, HUNK, group).cast("long") + (i - head - 1) - before(others)
            own = F.get(rows, _upto(d["definitions"], i))
            inside = F.coalesce(_upto(d["definitions"], i) > head, F.lit(False))
            trailing = F.regexp_extract(F.regexp_replace(header, r"^@@.*@@", ""), DEFINITION, 1)
            return F.struct(
                (i + 1).alias("offset"), F.regexp_replace(F.btrim(F.substring(path, 5, _FAR)), r"^[ab]/", "").alias("path"), header.alias("hunk"),
                F.when(x.startswith("-"), number(1, d["added"])).alias("old_no"), F.when(x.startswith("+"), number(2, d["removed"])).alias("new_no"), F.substring(x, 1, 1).alias("sign"), _behind(x).alias("text"),
                F.when(inside, F.regexp_extract(_behind(own), DEFINITION, 1)).otherwise(F.nullif(trailing, F.lit(""))).alias("enclosing"),
            )

        changed = F.filter(F.array_sort(F.concat(d["added"], d["removed"])), lambda i: _upto(d["heads"], i) > F.coalesce(_upto(d["breaks"], i), F.lit(-1)))
        return F.transform(changed, place)

    no_content = lambda x: x.rlike(NO_CONTENT)
    parts = F.struct(
        lines(diff).alias("rows"), _where(lines(diff), lambda x: x.rlike(HUNK)).alias("heads"), _where(lines(diff), lambda x: x.startswith("+++ ")).alias("paths"),
        _where(lines(diff), no_content).alias("breaks"), _where(lines(diff), lambda x: x.startswith("+") & ~no_content(x)).alias("added"),
        _where(lines(diff), lambda x: x.startswith("-") & ~no_content(x)).alias("removed"),
        _where(lines(diff), lambda x: ~x.rlike(HUNK) & ~no_content(x) & _behind(x).rlike(DEFINITION)).alias("definitions"),
    )
    return let(parts, places)


def line_index(diff: Column) -> Column:
    """(path, line, offset) of the lines of the new side, line by its number there, offset its place in the diff from 1.

    A hunk ends at the next header or at a line that is neither added, removed, context nor empty. If hunks overlap, a
    place comes once for each: the least offset counts.
    """

    def index(d: Column) -> Column:
        def of(head: Column) -> Column:
            end = F.coalesce(F.array_min(F.filter(d["stops"], lambda s: s > head)), F.size(d["rows"]))
            path = F.regexp_replace(F.btrim(F.substring(F.get(d["rows"], _upto(d["paths"], head)), 5, _FAR)), r"^[ab]/", "")
            first = F.nullif(F.regexp_extract(F.get(d["rows"], head), r"\+(\d+)", 1), F.lit("")).cast("long")
            kept = F.filter(F.transform(F.slice(d["rows"], head + 2, end - head - 1), lambda x, k: F.when(~x.startswith("-"), head + k + 2)), lambda k: k.isNotNull())
            places = F.transform(kept, lambda offset, k: F.struct(path.alias("path"), (first + k).alias("line"), offset.alias("offset")))
            return F.when(path.isNotNull() & first.isNotNull(), places).otherwise(F.slice(places, 1, 0))

        return F.flatten(F.transform(d["heads"], of))

    heads = lambda x: x.startswith("@@")
    parts = F.struct(
        lines(diff).alias("rows"), _where(lines(diff), heads).alias("heads"), _where(lines(diff), lambda x: x.startswith("+++ ")).alias("paths"),
        _where(lines(diff), lambda x: heads(x) | x.startswith("+++ ") | ~x.rlike("^([-+ ]|$)")).alias("stops"),
    )
    return let(parts, index)


def side_by_side(diff: Column) -> Column:
    """The diff in two columns: (left_no, left, right_no, right, kind) in order.

    Within a run of changed lines the n-th removed one stands opposite the n-th
    added one, the shorter side is padded with nulls. kind is hunk (a header
    in both columns, without numbers), context or change. Lines before the
    first hunk and headers of files are left out.
    """

    def columns(part: Column) -> Column:
        """part: a hunk's header and what follows up to the next one."""
        header = F.get(part, F.lit(0))
        own = F.filter(F.slice(part, 2, _FAR), lambda x: ~x.rlike(NO_CONTENT))

        def rows(d: Column) -> Column:
            def run(r: Column) -> Column:
                number = lambda side, others: d[side] + r["first"] - F.size(F.filter(d[others], lambda p: p < r["first"]))

                def pairs(s: Column) -> Column:
                    side = lambda name, k: F.when(k < F.size(s[name]), s[f"{name}_no"] + k)
                    longest = F.greatest(F.size(s["minus"]), F.size(s["plus"]))
                    both = F.transform(F.sequence(F.lit(0), longest - 1), lambda k: F.struct(
                        side("minus", k).alias("left_no"), _behind(F.get(s["minus"], k)).alias("left"), side("plus", k).alias("right_no"), _behind(F.get(s["plus"], k)).alias("right"), F.lit("change").alias("kind")))
                    text = F.when(r["end"].startswith(" "), _behind(r["end"])).otherwise(r["end"])
                    end = F.array(F.struct((s["minus_no"] + F.size(s["minus"])).alias("left_no"), text.alias("left"), (s["plus_no"] + F.size(s["plus"])).alias("right_no"), text.alias("right"), F.lit("context").alias("kind")))
                    return F.concat(F.when(longest > 0, both).otherwise(F.slice(both, 1, 0)), F.when(r["end"].isNotNull(), end).otherwise(F.slice(end, 1, 0)))

                sides = F.struct(F.filter(r["rows"], lambda x: x.startswith("-")).alias("minus"), F.filter(r["rows"], lambda x: x.startswith("+")).alias("plus"), number("old", "added").alias("minus_no"), number("new", "removed").alias("plus_no"))
                return let(sides, pairs)

            return F.flatten(F.transform(_runs(d["own"], lambda x: ~x.rlike("^[-+]")), run))

        start = lambda k: F.regexp_extract(header, HUNK, k).cast("long")
        title = F.array(F.struct(F.lit(None).cast("long").alias("left_no"), header.alias("left"), F.lit(None).cast("long").alias("right_no"), header.alias("right"), F.lit("hunk").alias("kind")))
        fields = F.struct(own.alias("own"), start(1).alias("old"), start(2).alias("new"), _where(own, lambda x: x.startswith("+")).alias("added"), _where(own, lambda x: x.startswith("-")).alias("removed"))
        return F.concat(title, let(fields, rows))

    parts = F.filter(F.split(F.array_join(lines(diff), "\n"), rf"(?m)(?={HUNK})"), lambda x: x.rlike(rf"\A{HUNK[1:]}"))
    return F.flatten(F.transform(parts, lambda x: columns(F.split(x.substr(F.lit(1), F.length(x) - F.when(x.endswith("\n"), 1).otherwise(0)), "\n"))))


def reversed_diff(diff: Column, flip: bool = True) -> Column:
    """The diff with its sides exchanged: hunk ranges and signs swap, and within a run removed lines come first. With flip false only the order within runs is mended."""
    turned = lambda rows, sign: F.transform(rows, lambda x: F.concat(F.lit(sign), _behind(x)))

    def mended(r: Column) -> Column:
        minus, plus = F.filter(r["rows"], lambda x: x.startswith("-")), F.filter(r["rows"], lambda x: x.startswith("+"))
        run = F.concat(turned(plus, "-"), turned(minus, "+")) if flip else F.concat(minus, plus)
        end = F.regexp_replace(r["end"], r"^@@ -(\S+) \+(\S+) @@", "@@ -$2 +$1 @@") if flip else r["end"]
        return F.concat(run, F.when(r["end"].isNotNull(), F.array(end)).otherwise(F.slice(F.array(end), 1, 0)))

    unchanged = lambda x: ~x.rlike(r"^[-+]") | x.rlike(r"^(--- |\+\+\+ )")
    return let(F.split(diff, "\n"), lambda rows: F.array_join(F.flatten(F.transform(_runs(rows, unchanged), mended)), "\n"))

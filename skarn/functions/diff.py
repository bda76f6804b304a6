"""Unified diffs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions.text import let


def lines(diff: Column) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(diff, r"\n\z", ""), "\n")


def files_in_diff(diff: Column) -> Column:
    """T4: new-side paths in order."""
    return F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1))


def body(diff: Column) -> Column:
    """Lines that aren't headers."""
    return F.filter(lines(diff), lambda x: ~x.rlike(r"^(diff |---|\+\+\+|@@)"))


def changed_lines(diff: Column, sign: str | None = None) -> Column:
    """Changed lines of both signs or of one, without headers."""
    return F.filter(lines(diff), lambda x: x.rlike(r"^[-+]" if sign is None else rf"^\{sign}") & ~x.rlike(r"^(---|\+\+\+)"))


def sides(diff: Column) -> tuple[Column, Column]:
    """Removed and added text."""
    return tuple(F.array_join(F.transform(changed_lines(diff, s), lambda x: F.substring(x, 2, 1 << 30)), "\n") for s in ("-", "+"))


def count_features(diff: Column) -> dict[str, Column]:
    """Ten counts: added and removed lines and characters, their differences and ratios, sizes."""
    chars = lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + F.length(x))
    rows = body(diff)
    plus, minus = F.filter(rows, lambda x: x.startswith("+")), F.filter(rows, lambda x: x.startswith("-"))
    p, m, pc, mc = F.size(plus), F.size(minus), chars(plus), chars(minus)
    one = F.lit(1)
    return {
        "added": p, "removed": m, "net": p - m, "ratio": p / F.greatest(m, one), "added_chars": pc, "removed_chars": mc,
        "net_chars": pc - mc, "chars_ratio": pc / F.greatest(mc, one), "n_chars": F.length(diff), "n_lines": F.size(rows),
    }


#: What starts a comment line, by the extension of the first changed file.
HASH_EXTENSIONS = ("py", "pyi", "sh", "bash", "zsh", "yml", "yaml", "toml", "rb", "pl", "r", "jl", "tf", "dockerfile")
SLASH_EXTENSIONS = (
    "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "java", "c", "h", "cc", "cpp", "hpp", "cs", "go",
    "rs", "swift", "kt", "scala", "php", "dart", "css", "scss", "less", "sql",
)
MARKUP_EXTENSIONS = ("html", "vue", "svelte", "xml", "md")
HASH_COMMENT, SLASH_COMMENT, MARKUP_COMMENT = r"^\s*#", r"^\s*(//|/\*|\*|<!--|-->)", r"^\s*(<!--|-->)"


def comment_pattern(diff: Column) -> Column:
    """Pattern of a comment line in the first changed file; null for an unknown extension."""
    ext = F.lower(F.regexp_extract(F.get(files_in_diff(diff), F.lit(0)), r"\.([^.]+)$", 1))
    return F.when(ext.isin(*HASH_EXTENSIONS), HASH_COMMENT).when(ext.isin(*SLASH_EXTENSIONS), SLASH_COMMENT).when(ext.isin(*MARKUP_EXTENSIONS), MARKUP_COMMENT)


def cosmetic_only(diff: Column) -> Column:
    """every changed line that isn't blank is a comment, or both sides have the same lines once runs of white space are one blank."""
    # lines are split and squashed once a row; patterns are literals, as one that differs by row is compiled for each line
    changed = F.filter(lines(diff), lambda x: (x.startswith("-") | x.startswith("+")) & ~x.startswith("---") & ~x.startswith("+++"))
    squashed = F.filter(F.transform(changed, lambda x: F.struct(F.substring(x, 1, 1).alias("s"), F.btrim(F.regexp_replace(F.substring(x, 2, 1 << 30), r"\s+", " ")).alias("t"))), lambda x: x["t"] != "")
    ext = F.lower(F.regexp_extract(F.regexp_extract(diff, r"(?m)^\+\+\+ b/(.+)$", 1), r"\.([^.]+)$", 1))
    side = lambda rows, s: F.array_sort(F.transform(F.filter(rows, lambda x: x["s"] == s), lambda x: x["t"]))
    every = lambda rows, pattern: F.forall(rows, lambda x: x["t"].rlike(pattern))
    comments = lambda rows, e: F.when(e.isin(*HASH_EXTENSIONS), every(rows, HASH_COMMENT)).when(e.isin(*SLASH_EXTENSIONS), every(rows, SLASH_COMMENT)).when(e.isin(*MARKUP_EXTENSIONS), every(rows, MARKUP_COMMENT)).otherwise(F.lit(False))
    judged = lambda v: (F.size(v["rows"]) > 0) & (comments(v["rows"], v["ext"]) | (side(v["rows"], "-") == side(v["rows"], "+")))
    return let(F.struct(squashed.alias("rows"), ext.alias("ext")), judged)


def already_word_diff(diff: Column) -> Column:
    """F32: word-diff markers and no line that begins with a sign but for file headers."""
    signed = F.exists(lines(diff), lambda x: x.rlike("^[-+]") & ~x.rlike(r"^(\+\+\+|---)"))
    return (F.contains(diff, F.lit("{+")) | F.contains(diff, F.lit("[-"))) & ~signed


#: How a path of tests looks, and how a line starts that isn't part of a hunk's body.
TEST_PATH = r"(^|/)(tests?|spec|__tests__)/|(_test|_spec|\.test|\.spec)\."
HEADER = r"^(@@|diff --git|index |\+\+\+|---|new file|deleted file|similarity |rename )"


def split_diff(diff: Column) -> Column:
    """(path, text) of each file's part, by its new path; a diff without file headers is one part, a blank one none."""
    header = r"^diff --git a/(.+?) b/(.+)$"
    parts = F.filter(F.split(diff, rf"(?m)(?={header})"), lambda x: x.rlike(rf"\A(?m:{header})"))
    named = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, rf"(?m){header}", 2).alias("path"), x.alias("text")))
    alone = F.filter(F.array(F.struct(F.lit("").alias("path"), diff.alias("text"))), lambda x: F.trim(F.regexp_replace(x["text"], r"\s", "")) != "")
    return F.when(F.size(parts) > 0, named).otherwise(alone)


def _files(diff: Column) -> Column:
    """(path, rows) of what follows each new-side header, up to the next one."""
    parts = F.filter(F.split(diff, r"(?m)^(?=\+\+\+ b/.)"), lambda x: x.rlike(r"\A\+\+\+ b/."))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"\A\+\+\+ b/(.+)", 1).alias("path"), F.slice(lines(x), 2, 1 << 30).alias("rows")))


def hunks_for(diff: Column, path: Column) -> Column:
    """The lines of one file's hunks, without headers of files; empty if the diff doesn't touch it."""
    own = F.flatten(F.transform(F.filter(_files(diff), lambda f: f["path"] == path), lambda f: f["rows"]))
    return F.array_join(F.filter(own, lambda x: ~x.rlike("^(diff --git|index |--- )")), "\n")


def entry_file(diff: Column, files: Column) -> Column:
    """The path with most changed lines, the first of several; paths of tests only if there are no others. Without paths the first of files, else empty."""
    changes = lambda f: F.size(F.filter(f["rows"], lambda x: x.rlike("^[-+]") & ~x.rlike(r"^(\+\+\+|---)")))
    parts = F.transform(_files(diff), lambda f: F.struct(f["path"].alias("path"), changes(f).alias("n")))
    paths = F.array_distinct(F.transform(parts, lambda f: f["path"]))
    source = F.filter(paths, lambda p: ~p.rlike(TEST_PATH))
    pool = F.when(F.size(source) > 0, source).otherwise(paths)
    total = lambda p: F.aggregate(F.filter(parts, lambda f: f["path"] == p), F.lit(0), lambda n, f: n + f["n"])
    best = F.array_max(F.transform(pool, lambda p, i: F.struct(total(p).alias("n"), (-i).alias("i"), p.alias("path"))))
    return F.coalesce(best["path"], F.get(files, F.lit(0)), F.lit(""))


def narrow_context(diff: Column, keep: int) -> Column:
    """Each hunk from ``keep`` lines before its first changed line to ``keep`` after its last; hunks without one and headers stay."""
    far = 1 << 30
    parts = F.split(F.array_join(lines(diff), "\n"), rf"\n(?={HEADER[1:]})")

    def narrowed(part: Column) -> Column:
        rows = F.split(part, "\n")
        start = F.when(part.rlike(rf"\A{HEADER[1:]}"), 1).otherwise(0)
        own = F.slice(rows, start + 1, far)
        changed = F.filter(F.transform(own, lambda x, i: F.when(x.rlike("^[-+]"), i)), lambda i: i.isNotNull())
        lo, hi = F.greatest(F.array_min(changed) - keep, F.lit(0)), F.array_max(changed) + keep + 1
        trimmed = F.when(F.size(changed) > 0, F.slice(own, lo + 1, hi - lo)).otherwise(own)
        return F.concat(F.slice(rows, 1, start), trimmed)

    return F.array_join(F.flatten(F.transform(parts, narrowed)), "\n")

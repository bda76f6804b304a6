"""Which commits carry a signal: their size, structure and language, or nothing for noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions import diff as diffs

# fixed values: limits, extensions, names of files without behaviour, and patterns of comments, imports and structure
MOST_FILES = 5
MOST_LINES = 500
TARGETS = [".py", ".js", ".mjs", ".ts", ".tsx", ".java"]
HALF_PARSED = [".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cs"]
NO_BEHAVIOUR = [
    ".gitignore", ".gitattributes", "readme", "readme.md", "license", "package.json", "package-lock.json", "yarn.lock", "setup.py",
    "pyproject.toml", "go.sum", "cargo.lock", "pom.xml", "build.gradle", "changelog.md", "makefile", "dockerfile",
]
COMMENT = r"^\s*(//|#|/\*|\*|\*/|<!--|--)"
IMPORT = r"^\s*(import|from|#include|use|require|package)\b"
STRUCTURE = r"\b(if|else|elif|for|while|switch|case|catch|when)\b|[<>!=]=|[-+*/%]=|\+\+|--"
LANGUAGES = [(".java", ".java"), (".py", ".py"), (".ts", ".ts"), (".tsx", ".ts"), (".js", ".js"), (".mjs", ".js")]


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, as it is written; names that only begin with a dot have none."""
    return F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1)


def language_of(files: Column) -> Column:
    """The first of LANGUAGES that a file has, else a question mark; no files (or null) have none."""
    found = F.transform(F.coalesce(files, F.array().cast("array<string>")), extension)
    out = F.lit("?")
    for ext, name in reversed(LANGUAGES):
        out = F.when(F.array_contains(found, ext), name).otherwise(out)
    return out


def commit_profile(files: Column, diff: Column) -> Column:
    """(n_lines, structured, lang) of a commit, or null for noise.

    Noise: no files or more than MOST_FILES, none in a target language, one
    in a language that is only half parsed or without behaviour; no changed
    lines or more than MOST_LINES; only blank lines and comments, or else only
    imports. n_lines leaves out blank lines and comments. A null diff is noise.
    """
    changed = F.transform(diffs.changed_lines(diff), lambda x: F.substring(x, 2, 1 << 30))
    real = F.filter(changed, lambda x: x.rlike(r"\S") & ~x.rlike(COMMENT))
    fits = F.size(files).between(1, MOST_FILES) & F.exists(files, lambda f: extension(f).isin(TARGETS))
    fits &= ~F.exists(files, lambda f: extension(f).isin(HALF_PARSED) | F.lower(_name(f)).isin(NO_BEHAVIOUR))
    tells = F.size(changed).between(1, MOST_LINES) & F.exists(real, lambda x: ~x.rlike(IMPORT))
    return F.when(fits & tells, F.struct(F.size(real).alias("n_lines"), F.exists(real, lambda x: x.rlike(STRUCTURE)).alias("structured"), language_of(files).alias("lang")))

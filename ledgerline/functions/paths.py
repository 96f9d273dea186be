"""Paths: normal form, globs, file kinds, languages, populations, protected paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never scanned.
EXCLUDED_SEGMENTS = ("node_modules", ".git", "dist", "coverage", "vendor", "target", "build", "out", ".venv", "venv", ".next", ".turbo", ".cache", "bazel-out")

#: Extensions by language; the first that matches counts.
LANGUAGE_SUFFIXES = (
    ("typescript", (".ts", ".tsx", ".mts", ".cts")),
    ("javascript", (".js", ".jsx", ".mjs", ".cjs")),
    ("vue", (".vue",)),
    ("go", (".go",)),
    ("rust", (".rs",)),
    ("python", (".py",)),
    ("java", (".java",)),
)

POPULATIONS = {"observed": None, "production-governance": ("production",), "test-governance": ("test",), "change-evidence": ("production", "test")}


def normalize_path(path: Column) -> Column:
    """POSIX and relative: backslashes become slashes, repeated slashes one, a leading `./` goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def normalize_target(target: Column) -> Column:
    """`kind:rest` with the kind in lower case; a file's rest with slashes only."""
    kind = F.lower(F.substring_index(target, ":", 1))
    tail = F.regexp_extract(target, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(~target.contains(":"), target).when(kind == "file", F.concat(F.lit("file:"), F.regexp_replace(tail, r"\\", "/"))).otherwise(F.concat(kind, F.lit(":"), tail))


def glob_regex(glob: str, dot: bool = True, ignore_case: bool = False) -> str:
    """A regular expression for a glob with `*`, `**`, `?`, `{a,b}` and `[...]`. Without dot, `*` and `**` skip names that begin with a dot."""
    first = "" if dot else r"(?!\.)"
    out, i, depth = [], 0, 0
    start = True  # of a path segment
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and start:
            out.append(rf"(?:{first}[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i) and start and i + 2 == len(glob):
            out.append(rf"(?:{first}[^/]+)(?:/{first}[^/]+)*" if not dot else ".*")
            i += 2
            continue
        if c == "*":
            out.append((first if start else "") + "[^/]*")
        elif c == "?":
            out.append((first if start else "") + "[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        start = c == "/"
        i += 1
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + "$"


def matches(path: Column, glob: str, dot: bool = True, ignore_case: bool = False) -> Column:
    return path.rlike(glob_regex(glob, dot, ignore_case))


def matches_any(path: Column, globs: Sequence[str], dot: bool = True) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | matches(path, g, dot)
    return out


def first_match(path: Column, rules: Sequence[tuple[str, str]], otherwise: Column, dot: bool = False, ignore_case: bool = False) -> Column:
    """The value of the first (glob, value) whose glob matches."""
    out = None
    for glob, value in rules:
        out = (F.when if out is None else out.when)(matches(path, glob, dot, ignore_case), F.lit(value))
    return otherwise if out is None else out.otherwise(otherwise)


def in_scope(path: Column, extensions: Sequence[str]) -> Column:
    """The path, in lower case, has one of the extensions and no excluded directory."""
    suffix = "(" + "|".join(re.escape(e) for e in extensions) + ")$"
    excluded = "(^|/)(" + "|".join(re.escape(s) for s in EXCLUDED_SEGMENTS) + ")/"
    return F.lower(path).rlike(suffix) & ~path.rlike(excluded)


def without_index(path: Column) -> Column:
    """A path without a last part that stands for its folder."""
    return F.regexp_replace(path, r"/(?:index|mod|__init__)$", "")


def language_of(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    out = None
    for language, suffixes in LANGUAGE_SUFFIXES:
        hit = F.lower(path).rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")
        out = (F.when if out is None else out.when)(hit, F.lit(language))
    return out


def file_kind(path: Column) -> Column:
    """generated, test or production, by the path alone."""
    p = F.lower(F.regexp_replace(path, r"\\\\", "/"))
    generated = p.rlike(r"/(dist|generated)/") | p.endswith(".d.ts")
    test = p.rlike(r"(^|/)(__tests__|tests?)(/|$)") | p.rlike(r"\.(test|spec)\.[^/]+$") | p.endswith("_test.go") | p.rlike(r"(test|tests|it)\.java$")
    return F.when(generated, "generated").when(test, "test").otherwise("production")


def file_kind_with_rules(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The kind of the first matching glob, letter case aside; else file_kind."""
    return first_match(F.lower(path), [(g.lower(), k) for g, k in rules], file_kind(path))


def participates(kind: Column, population: str) -> Column:
    """Whether a file kind belongs to a population; a null kind is production."""
    own = POPULATIONS[population]
    return F.lit(True) if own is None else F.coalesce(kind, F.lit("production")).isin(*own)


def layer_weight(weight: Column) -> Column:
    """A class weight: 1 if missing or not finite, 0.1 at least."""
    usable = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) != F.lit(float("inf")))
    return F.greatest(F.lit(0.1), F.when(usable, weight).otherwise(1.0))


def protected(configured: Column, path: Column) -> Column:
    """A configured path that ends with a slash covers all below it, another only itself."""
    return F.when(configured.endswith("/"), path.startswith(configured)).otherwise(path == configured)


def version_key(version: Column) -> Column:
    """A version's numbers as an array that sorts as versions do."""
    return F.transform(F.split(F.regexp_replace(version, r"^v|[-+].*$", ""), r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("long"), F.lit(0).cast("long")))


def authority_ids(path: Column, authorities: Sequence[tuple[str, str]]) -> Column:
    """The ids of all authorities (id, configured path) that protect a path, in order and each once."""
    hits = [F.when(protected(F.lit(configured), path), F.lit(i)) for i, configured in authorities]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))) if hits else F.array().cast("array<string>")

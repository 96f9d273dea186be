"""Staged rules: a text filter, extractions, and links between what was extracted. A rule is a plan that Spark runs as one.

1. The text filter keeps files whose content can matter at all; it is one pattern on the scan.
2. An extraction is a pattern with groups; every line that it matches gives a record (path, line and the groups by name).
3. A link joins two extractions by their columns: what has a partner (`semi`, `inner`) or has none (`anti`) is a finding.

Rules that need facts which aren't there are unavailable as a whole, never silently empty.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The facts that a rule may require.
CAPABILITIES = ("file-classification.v1", "structure-metrics.v1", "authorities.v1", "test-case-spans.v1", "invocation-bindings.v1", "semantic-relations.v1", "change-surface.v1")


class RuleUnavailable(RuntimeError):
    """A rule requires facts that aren't there."""


@dataclass(frozen=True)
class Extraction:
    """Records of lines: pattern is a regular expression of Java's, columns name its groups in order."""

    name: str
    pattern: str
    columns: tuple[str, ...]
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class Link:
    """left joined with right on pairs of columns; how: semi, anti or inner (right's columns are then prefixed)."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    how: str = "anti"


@dataclass(frozen=True)
class StagedRule:
    name: str
    text_filter: str
    extractions: tuple[Extraction, ...]
    link: Link | None = None
    requires: tuple[str, ...] = ()


def requirements(rules: Sequence[StagedRule]) -> list[str]:
    """The facts that any of the rules requires, each once."""
    return sorted({r for rule in rules for r in rule.requires})


def consumers(rules: Sequence[StagedRule]) -> dict[str, list[str]]:
    """For each fact the rules that require it."""
    return {c: own for c in CAPABILITIES if (own := sorted(r.name for r in rules if c in r.requires))}


def consumer_table(rules: DataFrame) -> DataFrame:
    """The same of a table of rules (rule, requires): fact, its rules in order, and whether there is such a fact."""
    each = rules.select("rule", F.explode(F.array_distinct("requires")).alias("fact"))
    return each.groupBy("fact").agg(F.array_sort(F.collect_set("rule")).alias("rules")).withColumn("known", F.col("fact").isin(*CAPABILITIES))


def check(rule: StagedRule, available: Collection[str]) -> None:
    """Fails for a rule that asks for what no rule may, for what isn't available, or whose parts don't fit."""
    if unknown := sorted(set(rule.requires) - set(CAPABILITIES)):
        raise RuleUnavailable(f"{rule.name}: no such facts: {', '.join(unknown)}")
    if missing := sorted(set(rule.requires) - set(available)):
        raise RuleUnavailable(f"{rule.name}: not available: {', '.join(missing)}")
    names = [e.name for e in rule.extractions]
    if len(set(names)) != len(names) or not names or (rule.link and not {rule.link.left, rule.link.right} <= set(names)):
        raise RuleUnavailable(f"{rule.name}: extractions and link don't fit")
    for e in rule.extractions:
        if re.compile(e.pattern).groups != len(e.columns):
            raise RuleUnavailable(f"{rule.name}: {e.name} has other groups than columns")


def records(files: DataFrame, extraction: Extraction, text_filter: str | None = None) -> DataFrame:
    """(path, line, and the extraction's columns) of files (path, language, content), a row for each line that matches."""
    own = files.where(F.col("language").isin(*extraction.languages)) if extraction.languages else files
    if text_filter:
        own = own.where(F.col("content").rlike(text_filter))
    lines = own.select("path", F.posexplode(F.split("content", "\r?\n")).alias("at", "text")).where(F.col("text").rlike(extraction.pattern))
    return lines.select("path", (F.col("at") + 1).alias("line"), *(F.regexp_extract("text", extraction.pattern, i).alias(c) for i, c in enumerate(extraction.columns, 1)))


def run(rule: StagedRule, files: DataFrame, available: Collection[str] = CAPABILITIES) -> DataFrame:
    """The findings of a rule: rule, path, line and detail (the columns as a map)."""
    check(rule, available)
    found = {e.name: records(files, e, rule.text_filter) for e in rule.extractions}
    columns = {e.name: e.columns for e in rule.extractions}
    if rule.link is None:
        out, names = found[rule.extractions[0].name], columns[rule.extractions[0].name]
    else:
        left, right = found[rule.link.left], found[rule.link.right]
        names = columns[rule.link.left]
        other = right.select(*(F.col(c).alias(f"{rule.link.right}_{c}") for c in ("path", "line", *columns[rule.link.right])))
        keys = [F.col(a) == F.col(f"{rule.link.right}_{b}") for a, b in rule.link.on]
        out = left.join(other.select(*(f"{rule.link.right}_{b}" for _, b in rule.link.on)).distinct() if rule.link.how != "inner" else other, keys, {"semi": "left_semi", "anti": "left_anti", "inner": "inner"}[rule.link.how])
    detail = F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))) if names else F.create_map().cast("map<string,string>")
    return out.select(F.lit(rule.name).alias("rule"), "path", "line", detail.alias("detail"))


def run_all(rules: Sequence[StagedRule], files: DataFrame, available: Collection[str] = CAPABILITIES) -> tuple[DataFrame | None, dict[str, str]]:
    """All rules' findings, and why some could not run: one rule's failure doesn't stop the others."""
    out, failed = None, {}
    for rule in rules:
        try:
            own = run(rule, files, available)
        except RuleUnavailable as e:
            failed[rule.name] = str(e)
            continue
        out = own if out is None else out.unionByName(own)
    return out, failed


def run_on_changes(rule: StagedRule, changes: DataFrame, available: Collection[str] = CAPABILITIES) -> DataFrame:
    """What a change brings: findings after it whose path and detail had none before. changes: path, language, before, after (texts)."""
    sides = {side: run(rule, changes.where(F.col(side).isNotNull()).select("path", "language", F.col(side).alias("content")), available) for side in ("before", "after")}
    key = F.to_json("detail")
    old = sides["before"].select("path", key.alias("_key")).distinct()
    return sides["after"].withColumn("_key", key).join(old, ["path", "_key"], "left_anti").select("rule", "path", "line", "detail")


def target_files(files: DataFrame, rules: Sequence[StagedRule]) -> DataFrame:
    """The files that any of the rules can look at: those of its extractions' languages; all, if one has none."""
    own = [e.languages for r in rules for e in r.extractions]
    return files if not all(own) else files.where(F.col("language").isin(*sorted({x for languages in own for x in languages})))

"""The rule language: a condition's text becomes a Column.

A condition is comparisons joined by && and ||, without precedence, from left to right. A comparison is a value, or
two with ==, !=, >, >=, < or <= between them; a value is a number, a string, a name, or a condition in
parentheses. A lone value counts by its truth. An operator's character next to a name or number
of one character is taken with that character, which is then no valid token: such conditions don't compile.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerline.shipping import ship

#: What a condition may name, and what for.
VARIABLES = {
    "max_func_branch": "gate",
    "crl_local": "gate",
    "exposure": "gate",
    "weighted_branch_total": "report_only",
    "top_level_branch": "report_only",
    "nesting_depth": "report_only",
    "loc": "report_only",
    "declaration_loc": "report_only",
    "i_push": "report_only",
    "branch_count": "retired",
    "crl_state": "retired",
    "module_shape": "report_only",
    "crl_inputs": "retired",
    "cohesion": "retired",
    "function_count": "retired",
    "symbol_scope": "retired",
    "path_class": "classifier",
    "language": "classifier",
}
#: Names above that are composites, not metrics.
COMPOSITES = ("crl_state", "module_shape", "crl_inputs")

LEVELS = ("pass", "warn", "block")
TEXTS = ("path_class", "language")


class RuleError(ValueError):
    """A condition that doesn't compile."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: str | float


#: One alternative for each kind of token, tried in this order. A sign or letter right before a comparison's first character is taken for the
#: comparison: the language's own rule, for which conditions put blanks around comparisons with names or numbers of one character.
_TOKENS = re.compile(
    r"""(?P<blank>\s+)|(?P<paren>[()])|(?P<logic>&&|\|\|)|(?P<compare>(?:[=!><]|.(?=[=!><]))=?)|(?P<string>"[^"]*"?|'[^']*'?)|(?P<number>[0-9.]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"""
)


def _number(text: str) -> float:
    """A number up to its second point; a lone point is none."""
    whole, point, rest = text.partition(".")
    digits = whole + point + rest.partition(".")[0]
    return float(digits) if digits.strip(".") else float("nan")


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if m is None:
            raise RuleError(f"{text!r}: unexpected {text[at]!r}")
        at, kind, found = m.end(), m.lastgroup, m.group()
        if kind == "number":
            out.append(Token("number", _number(found)))
        elif kind == "string":  # one that nothing closes ends with the text
            out.append(Token("string", found[1:].removesuffix(found[0])))
        elif kind != "blank":
            out.append(Token({"logic": "op", "compare": "op"}.get(kind, kind), found))
    return out


@dataclass(frozen=True)
class Value:
    """A column, whether it is text, and whether it is a truth value."""

    column: Column
    text: bool = False
    truth: bool = False


def compile_condition(text: str, names: Mapping[str, Column] | None = None, texts: Collection[str] = TEXTS) -> Column:
    """The condition as a Column that is never null. names: what variables stand for, others being null; texts: those that are text."""
    tokens = tokenize(text)
    at = 0

    def peek() -> Token | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> Token:
        nonlocal at
        if at >= len(tokens):
            raise RuleError(f"{text!r}: it ends early")
        at += 1
        return tokens[at - 1]

    def value() -> Value:
        t = take()
        if t.kind == "number":
            return Value(F.lit(t.value))
        if t.kind == "string":
            return Value(F.lit(t.value), text=True)
        if t.kind == "name":
            if names is None:
                return Value(F.col(t.value), text=t.value in texts)
            return Value(names[t.value], text=t.value in texts) if t.value in names else Value(F.lit(None).cast("double"))
        if t == Token("paren", "("):
            inner = condition()
            if take() != Token("paren", ")"):
                raise RuleError(f"{text!r}: no closing parenthesis")
            return Value(inner, truth=True)
        raise RuleError(f"{text!r}: unexpected {t.value!r}")

    def number(v: Value) -> Column:
        """A number, or null for what is none: an empty or blank text is 0, and NaN compares with nothing."""
        if v.text:
            own = F.when(F.trim(v.column) == "", 0.0).otherwise(v.column.try_cast("double"))
        else:
            own = v.column.cast("int").cast("double") if v.truth else v.column.cast("double")
        return F.when(~F.isnan(own), own)

    def truth(v: Value) -> Column:
        if v.truth:
            return v.column
        return F.coalesce(v.column != "", F.lit(False)) if v.text else F.coalesce((v.column.cast("double") != 0) & ~F.isnan(v.column.cast("double")), F.lit(False))

    def comparison() -> Column:
        left = value()
        t = peek()
        if t is None or t.kind != "op" or t.value not in ("==", "!=", ">", ">=", "<", "<="):
            return truth(left)
        take()
        right = value()
        a, b = (left.column, right.column) if left.text and right.text else (number(left), number(right))
        if t.value in ("==", "!="):
            absent = left.column.isNull() & right.column.isNull()  # missing equals missing, and nothing else
            same = absent | F.coalesce(a == b, F.lit(False))
            return same if t.value == "==" else ~same
        return F.coalesce({">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[t.value], F.lit(False))

    def condition() -> Column:
        out = comparison()
        while (t := peek()) is not None and t.kind == "op" and t.value in ("&&", "||"):
            take()
            right = comparison()
            out = out & right if t.value == "&&" else out | right
        return out

    out = condition()
    if at < len(tokens):
        raise RuleError(f"{text!r}: more after the condition")
    return out


def identifiers(text: str) -> list[str]:
    """Names outside of strings, each once, in order."""
    return list(dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", re.sub(r"\"[^\"]*\"|'[^']*'", " ", text))))


def metrics_in(text: str) -> list[str]:
    return [x for x in identifiers(text) if VARIABLES.get(x) not in (None, "classifier") and x not in COMPOSITES]


def unknown_in(text: str) -> list[str]:
    return sorted(x for x in identifiers(text) if x not in VARIABLES)


def unsupported_in(text: str) -> list[str]:
    """What a gate's condition must not name."""
    return sorted(x for x in identifiers(text) if VARIABLES.get(x) not in ("gate", "classifier"))


def thresholds_in(text: str) -> list[tuple[str, str, float]]:
    """(metric, comparison, number) for each gate metric compared with a number, the metric on the left."""
    plain = re.sub(r"\"[^\"]*\"|'[^']*'", " ", text)
    turned = {">": "<", ">=": "<=", "<": ">", "<=": ">="}
    out = [(m, c, float(x)) for m, c, x in re.findall(r"([A-Za-z_]\w*)\s*(>=|<=|>|<)\s*(\d+(?:\.\d+)?)", plain)]
    out += [(m, turned[c], float(x)) for x, c, m in re.findall(r"(\d+(?:\.\d+)?)\s*(>=|<=|>|<)\s*([A-Za-z_]\w*)", plain)]
    return [x for x in out if VARIABLES.get(x[0]) == "gate"]


@F.pandas_udf(StructType([StructField(n, ArrayType(StringType())) for n in ("metrics", "unknown", "unsupported", "thresholds")]))
def _condition_facts(conditions: pd.Series) -> pd.DataFrame:
    """What the conditions in a column name: metrics, names that there are not, names that a gate must not use, and thresholds (metric, comparison, number in one)."""
    own = conditions.fillna("")
    return pd.DataFrame({"metrics": own.map(metrics_in), "unknown": own.map(unknown_in), "unsupported": own.map(unsupported_in), "thresholds": own.map(lambda c: [f"{m}{o}{n:g}" for m, o, n in sorted(thresholds_in(c))])})


def condition_facts(df: DataFrame, condition: str = "condition") -> DataFrame:
    """df with metrics, unknown, unsupported and thresholds of its conditions."""
    ship(df.sparkSession)
    return df.withColumn("_facts", _condition_facts(condition)).select(*df.columns, "_facts.*")


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    level: str = "warn"


def triggers(df: DataFrame, rules: Sequence[Rule], names: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each row of df and rule that holds: df's columns, rule and level. One pass, no join."""
    for r in rules:
        if bad := unsupported_in(r.condition):
            raise RuleError(f"rule {r.name}: {', '.join(bad)} can't be gated on")
    made = [F.when(compile_condition(r.condition, names), F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"))) for r in rules]
    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*made)))).select(*df.columns, "_hit.rule", "_hit.level")


def severity(level: Column) -> Column:
    return F.when(level == "block", 2).when(level == "warn", 1).otherwise(0)


def verdict(hits: DataFrame) -> DataFrame:
    """One row: the worst level of all triggers, and how many there are."""
    worst = F.coalesce(F.max(severity(F.col("level"))), F.lit(0))
    return hits.agg(F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "BLOCK"))), worst + 1).alias("verdict"), F.count(F.lit(1)).alias("triggers"))


def threshold_shifts(before: DataFrame, after: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows whose set of triggered rules differs between two calibrations."""
    one, two = (triggers(df, rules).groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias(name)) for df, name in ((before, "rules_before"), (after, "rules_after")))
    none = F.array().cast("array<string>")
    both = one.join(two, key, "full_outer").select(key, F.coalesce("rules_before", none).alias("rules_before"), F.coalesce("rules_after", none).alias("rules_after"))
    return both.where(F.col("rules_before") != F.col("rules_after"))


def combined_exit(codes: Column) -> Column:
    """The most severe of exit codes 0 to 3."""
    return F.coalesce(F.max(codes), F.lit(0))


def only_on(rules: Sequence[Rule], metric: str = "crl_local") -> list[Rule]:
    """The rules whose one metric this is."""
    return [r for r in rules if set(metrics_in(r.condition)) == {metric}]


def rules_only_on(rules: DataFrame, metric: str = "crl_local") -> DataFrame:
    """The same of a table of rules (condition)."""
    return condition_facts(rules).where(F.array_distinct("metrics") == F.array(F.lit(metric))).select(*rules.columns)


def shifted(df: DataFrame, before: str, after: str, digest_before: str, digest_after: str) -> DataFrame:
    """Rows whose own facts are what they were (equal, known digests) and whose burden moved all the same."""
    return df.where((F.col(digest_before) == F.col(digest_after)) & (F.col(before) != F.col(after)))


def row_verdict(rules: Sequence[Rule], names: Mapping[str, Column] | None = None) -> Column:
    """The verdict on a row by itself: BLOCK, WARN or PASS."""
    worst = F.greatest(F.lit(0), F.lit(0), *(F.when(compile_condition(r.condition, names), severity(F.lit(r.level))).otherwise(0) for r in rules))
    return F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "BLOCK"))), worst + 1)

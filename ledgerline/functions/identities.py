"""Identities and fingerprints: SHA-256 over canonical forms of rows, groups and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import LANGUAGE_SUFFIXES


def json_number(c: Column) -> Column:
    """A number as JSON has it: its shortest decimal, without an exponent from 1e-6 to under 1e21; whole ones without a fraction; a missing or unbounded one, or none, is null."""
    own = c.cast("double")
    spelled = own.cast("string")  # 1.25E-4
    sign = F.when(own < 0, "-").otherwise("")
    exponent = F.coalesce(F.regexp_extract(spelled, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.regexp_extract(spelled, r"^-?([0-9.]+)", 1), r"\.0$|\.", "")
    after = F.length(digits) - 1  # digits that the mantissa has after its point
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(sign, F.when(after <= exponent, F.concat(digits, F.repeat(F.lit("0"), exponent - after))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))))
    outer = F.concat(sign, F.substring(digits, 1, 1), F.when(after > 0, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""), F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string"))
    whole = (own == F.floor(own)) & (F.abs(own) < 1e15)
    inner = F.when(~spelled.contains("E"), F.regexp_replace(spelled, r"\.0$", "")).when((exponent < -6) | (exponent > 20), outer).when(exponent < 0, small).otherwise(large)
    finite = own.isNotNull() & ~F.isnan(own) & (F.abs(own) < float("inf"))
    return F.coalesce(F.when(finite, F.when(whole, own.cast("long").cast("string")).otherwise(inner)), F.lit("null"))


def json_text(c: Column) -> Column:
    """A text as a JSON string; a missing one is null."""
    own = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNotNull(), F.substring(own, F.lit(6), F.length(own) - 6)).otherwise("null")


def json_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def numbers_fingerprint(*numbers: Column) -> Column:
    """SHA-256 of a row's numbers as a JSON array."""
    return F.sha2(json_array(*map(json_number, numbers)), 256)


def weights_fingerprint(weights: Mapping[str, float], order: Sequence[str] = ("branch", "nesting", "loc", "alpha", "disconnected", "passthrough")) -> Column:
    return numbers_fingerprint(*(F.lit(float(weights[k])) for k in order))


def table_digest(rows: DataFrame, row: Column, distinct: bool = False) -> DataFrame:
    """One row: SHA-256 of all rows' texts, whatever their order.

    Rows are hashed, the hashes of each of 4,096 chunks in order, and then the chunks' hashes in order.
    """
    hashed = rows.select(F.sha2(row, 256).alias("h"))
    if distinct:
        hashed = hashed.distinct()
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("chunk")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("part"))
    return parts.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "chunk", "part")))), 256).alias("digest"))


def profile_id(version: str, scope: Column, contract: Column, population: Column, weights: Column) -> Column:
    """The content address of a calibration profile."""
    return F.concat(F.lit(version + ":"), F.sha2(json_array(*map(json_text, (scope, contract, population, weights))), 256))


def observation_fingerprint(df: DataFrame, measured: Sequence[str], time: str) -> DataFrame:
    """df with observation (all fields but the time) and slot (without the measured values too): SHA-256 of each row's fields by name."""
    named = lambda skip: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in skip)), {"ignoreNullFields": "false"}), 256)
    return df.withColumns({"observation": named({time}), "slot": named({time, *measured})})


def history_entry_id(baseline: Column, revision: Column, evidence: Column) -> Column:
    """The key of a history entry: evidence (an array of file, anchor, kind, null anchors left out) in order, so that a repeated entry is the same."""
    item = lambda e: F.concat(F.lit('{"file":'), json_text(e["file"]), F.when(e["anchor"].isNotNull(), F.concat(F.lit(',"anchor":'), json_text(e["anchor"]))).otherwise(""), F.lit(',"changeKind":'), json_text(e["kind"]), F.lit("}"))
    key = lambda e: F.concat_ws(":", e["file"], F.coalesce(e["anchor"], F.lit("")), e["kind"])
    ordered = F.transform(F.array_sort(F.transform(evidence, lambda e: F.struct(key(e).alias("key"), item(e).alias("item")))), lambda x: x["item"])
    source = F.concat(F.lit('{"version":3,"baselineIdentity":'), json_text(baseline), F.lit(',"revisionKey":'), json_text(revision), F.lit(',"evidence":['), F.concat_ws(",", ordered), F.lit("]}"))
    return F.concat(F.lit("diff-v3-"), F.substring(F.sha2(source, 256), 1, 24))


def declaration_identity(language: Column, file: Column, kind: Column, name: Column) -> Column:
    """The key of a declaration across versions: no line number takes part."""
    return F.concat_ws("\x00", language, file, kind, name)


def evidence_signature(file: Column, digest: Column) -> Column:
    """An aggregate: the distinct `file:digest` of a group, in order, joined. Equal sets have equal signatures."""
    return F.concat_ws("|", F.array_sort(F.collect_set(F.concat_ws(":", file, digest))))


def shard_name(path: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(path, 256), F.lit(".json"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row: a quick check for changes of a folder's files (name, size, modified)."""
    return table_digest(files, F.concat_ws("|", "name", F.col("size").cast("string"), F.unix_micros("modified").cast("string")))


def analysis_scope(languages: Sequence[str], rules: Sequence[tuple[str, str]] = ()) -> str:
    """The fingerprint of what a scan covers: languages, their extensions and the rules (glob, kind), sorted and each once."""
    own = sorted(set(languages))
    extensions = sorted(e for name, suffixes in LANGUAGE_SUFFIXES if name in own for e in suffixes)
    return f"scope-v2:{','.join(own)}:{','.join(extensions)}:{','.join(f'{g}={k}' for g, k in sorted(rules))}"


def scope_fingerprint(languages: Column, rules: Column) -> Column:
    """The same of columns: languages (names) and rules (glob, kind)."""
    suffixes = F.create_map(*(x for name, own in LANGUAGE_SUFFIXES for x in (F.lit(name), F.array(*map(F.lit, own)))))
    own = F.array_sort(F.array_distinct(languages))
    extensions = F.array_sort(F.flatten(F.transform(own, lambda x: F.coalesce(F.try_element_at(suffixes, x), F.array().cast("array<string>")))))
    spelled = F.array_sort(F.array_distinct(F.transform(rules, lambda r: F.concat(r["glob"], F.lit("="), r["kind"]))))
    return F.concat_ws(":", F.lit("scope-v2"), F.array_join(own, ","), F.array_join(extensions, ","), F.array_join(spelled, ","))


def shapes_fingerprint(shapes: DataFrame) -> DataFrame:
    """One row: the declared weak assertions (language, method) by language, sorted and each once; empty if there are none."""
    each = shapes.where(F.col("method").isNotNull()).groupBy("language").agg(F.concat_ws(",", F.array_sort(F.collect_set("method"))).alias("names"))
    ordered = F.array_sort(F.collect_list(F.struct("language", "names")))
    return each.agg(F.concat_ws(";", F.transform(ordered, lambda x: F.concat(x["language"], F.lit(":weak_assertion_methods:"), x["names"]))).alias("fingerprint"))


#: Names that a normal call keeps.
_KEYWORDS = "const|let|var|function|return|if|else|for|new|await|as|of|in|true|false|null|undefined"


def normalize_call(text: Column) -> Column:
    """A call's text with strings and names masked and single blanks, so that calls of one shape are equal."""
    masked = F.regexp_replace(text, r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "__STR__")
    named = F.regexp_replace(masked, rf"(?<![A-Za-z0-9_])(?!(?:{_KEYWORDS})(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*", "_id")
    return F.trim(F.regexp_replace(named, r"\s+", " "))

"""Test cases, assertions and fixtures in sources, by provider: questions to syntax rows (`functions.syntax.nodes`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.syntax import nodes as syntax_nodes
from ledgerline.sources.tables import cut_lineage


@dataclass(frozen=True)
class Provider:
    """A framework: the language of its syntax rows, and what its test files are named like."""

    name: str
    language: str
    files: str


#: The first that supports a file collects its cases.
PROVIDERS = (
    Provider("vitest", "typescript", r"\.(test|spec)\.[cm]?tsx?$"), Provider("node:test", "typescript", r"\.(test|spec)\.[cm]?jsx?$"), Provider("go-testing", "go", r"_test\.go$"),
    Provider("rust-testing", "rust", r"\.rs$"), Provider("java-junit", "java", r"Tests?\.java$"), Provider("python-pytest", "python", r"(^|/)(test_[^/]*|[^/]*_test)\.py$"),
)

#: What a case looks like where cases are declarations: pattern of the head (group 1: its name) and of a modifier that it needs.
DECLARED = {
    "go": (r"^func (Test\w*)\(\s*\w+ \*testing\.T\s*\)", None), "rust": (r"\bfn (\w+)", r"^#\[(?:\w+::)*test\b"), "java": (r"(\w+)\s*\([^()]*\)(?:\s*throws [\w., ]+)?$", r"^@(?:ParameterizedTest|RepeatedTest|TestFactory|Test)\b"), "python": (r"^(?:async )?def (test\w*)\(", None),
}
#: What takes a case out of a run, or leaves it alone in it.
SKIPPED = {"go": None, "rust": r"^#\[ignore\b", "java": r"^@(?:Disabled|Ignore)\b", "python": r"^@(?:pytest\.mark\.(?:skip|skipif|xfail)|unittest\.(?:skip\w*|expectedFailure))\b"}
_CASE_CALL = r"^(?:it|test)(?:\.\w+)*$"

#: Calls that assert, by language: patterns of name and of owner (None: whatever it is); and those that assert little.
ASSERTS = {
    "typescript": ((r"expect(?:TypeOf)?|assert\w*", None), (r"\w+", r"assert(?:\.\w+)*")), "go": ((r"(?:Error|Fatal|Errorf|Fatalf|Fail|FailNow)", r"\w+"), (r"\w+", r"assert|require")), "java": ((r"assert\w*|verify\w*|fail", None),),
    "rust": ((r"(?:debug_)?assert\w*", None),), "python": ((r"assert\w*", None), (r"raises|warns|fail", r"pytest|self")),
}
WEAK = {"typescript": r"toBeDefined|toBeTruthy|toBeFalsy|ok", "java": r"assertNotNull", "python": r"assertTrue|assertIsNotNone", "go": r"NotNil|True", "rust": None}

#: The kinds of nodes that evidence of TypeScript's test files is made of; of other languages it asks for statements too.
TYPESCRIPT_KINDS = ("file", "call", "argument")


def provider_of(path: Column, language: Column) -> Column:
    """The name of the first provider that supports a file, or null."""
    own = F.when(language == "javascript", "typescript").otherwise(language)
    out = None
    for p in PROVIDERS:
        out = (F.when if out is None else out.when)((own == p.language) & path.rlike(p.files), F.lit(p.name))
    return out


def in_nodes(nodes: DataFrame) -> DataFrame:
    """path, provider, name, line, end_line and state (skipped, alone, or null) of the cases in syntax rows.

    A case of TypeScript is a call of `it`, `test` or a member of them (`it.each(…)('…', …)` is one) with a text first, wherever its name stands; of others a function by its name or what is above it.
    """
    own = nodes.withColumn("provider", provider_of(F.col("path"), F.col("language"))).where("provider is not null")
    declared, state = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, (head, mark) in DECLARED.items():
        holds = (F.col("language") == language) & (F.col("kind") == "statement") & F.col("head").rlike(head)
        if mark:
            holds &= F.exists("modifiers", lambda m: m.rlike(mark))  # noqa: B023
        declared = F.when(holds, F.regexp_extract("head", head, 1)).otherwise(declared)
        if SKIPPED[language]:
            state = F.when((F.col("language") == language) & F.exists("modifiers", lambda m: m.rlike(SKIPPED[language])), "skipped").otherwise(state)  # noqa: B023
    one = own.where("kind = 'statement'").select("path", "provider", declared.alias("name"), F.col("head_line").alias("line"), "end_line", state.alias("state"), "language", "node").where("name is not null")
    # a case of Go is skipped by a call in it
    skips = own.where("language = 'go' and kind = 'call' and name in ('Skip', 'SkipNow', 'Skipf')").select("path", F.explode("above").alias("node")).distinct().withColumn("_skips", F.lit(True))
    one = one.join(skips, ["path", "node"], "left").withColumn("state", F.when((F.col("language") == "go") & F.col("_skips"), "skipped").otherwise(F.col("state"))).drop("_skips", "node", "language")
    chain = F.concat_ws(".", "owner", "name")
    calls = own.where("language = 'typescript' and kind = 'call'").where(chain.rlike(_CASE_CALL) & ((F.col("name") != "each") | (F.col("form") == "curried")))
    calls = calls.select("path", "provider", F.col("node").alias("parent"), "line", "end_line", F.when(chain.rlike(r"\.(?:skip|todo|skipIf)\b"), "skipped").when(chain.rlike(r"\.only\b"), "alone").alias("state"))
    first = own.where("kind = 'argument'").groupBy("path", "parent").agg(F.min_by(F.struct("form", "name", "head"), "node").alias("a"))
    text = F.when(F.col("a.form") == "string", F.col("a.name")).when(F.col("a.head").startswith("`"), F.regexp_extract("a.head", "(?s)^`(.*)`$", 1))
    two = calls.join(first, ["path", "parent"]).select("path", "provider", text.alias("name"), "line", "end_line", "state").where("name is not null")
    return one.unionByName(two)


def cases(files: DataFrame) -> DataFrame:
    """The same of files (path, language, content); only test files are read."""
    return in_nodes(syntax_nodes(files.where(provider_of(F.col("path"), F.col("language")).isNotNull())))


def assertions(nodes: DataFrame) -> DataFrame:
    """path, line, end_line and weak of what asserts in syntax rows: calls, and Python's statement. What a chain like `expect(x).toBe(y)` asserts is one row: its longest call."""
    holds, weak = F.lit(False), F.lit(False)
    whole = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike(f"^(?:{p})$")
    for language, own in ASSERTS.items():
        mine = F.col("language") == language
        for name, owner in own:
            holds |= mine & whole("name", name) & (whole("owner", owner) if owner else F.lit(True))
        if WEAK[language]:
            weak |= mine & whole("name", WEAK[language])
    # a matcher's call has the assertion's call as its owner, and begins where that does
    matcher = (F.col("language") == "typescript") & F.col("owner").rlike(r"^expect\s*\(")
    calls = nodes.where("kind = 'call'").where(holds | matcher).select("path", "line", "end_line", "start", "end", weak.alias("weak"))
    best = calls.groupBy("path", "start").agg(F.max_by(F.struct("line", "end_line", "weak"), "end").alias("a")).select("path", "a.*")
    return best.unionByName(nodes.where("language = 'python' and kind = 'statement' and form = 'assert'").select("path", "line", "end_line", F.lit(False).alias("weak")))


def evidence(nodes: DataFrame) -> DataFrame:
    """path, provider, cases, skipped, alone, assertions, weak, assertion_lines, case_lines, call_lines and without_assertion (names of cases that hold none) of test files in syntax rows.

    Lines are those that any of the kind covers, each once: what blocks of a file are judged by (`operators.testing.block_semantics`).
    """
    own = nodes.withColumn("provider", provider_of(F.col("path"), F.col("language"))).where("provider is not null").drop("provider").where("kind != 'string'")
    columns = ("path", "language", "node", "parent", "above", "kind", "form", "name", "owner", "head", "modifiers", "line", "head_line", "end_line", "start", "end")
    own = cut_lineage(own.select(*columns), "rows", shuffled=True)  # read nine times, and files should be parsed once
    found = cut_lineage(in_nodes(own), "cases", shuffled=True)
    files = own.where("node = 0 and kind = 'file'").select("path", provider_of(F.col("path"), F.col("language")).alias("provider"))
    asserted = assertions(own)
    lines = lambda: F.sequence("line", F.greatest("line", "end_line"))
    covered = lambda df, name: df.select("path", F.explode(lines()).alias("l")).groupBy("path").agg(F.array_sort(F.collect_set("l")).alias(name))
    held = asserted.select("path", F.col("line").alias("_l"))
    # an assertion belongs to the innermost case around its first line
    around = found.select("path", "name", F.col("line").alias("_a"), F.explode(lines()).alias("_l"))
    inside = held.join(around, ["path", "_l"]).select("path", "_a", "name").distinct()
    bare = found.withColumnRenamed("line", "_a").join(inside, ["path", "_a", "name"], "left_anti").where("state is null or state != 'skipped'").groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("without_assertion"))
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("state") == "skipped").alias("skipped"), F.count_if(F.col("state") == "alone").alias("alone"))
    sums = asserted.groupBy("path").agg(F.count(F.lit(1)).alias("assertions"), F.count_if("weak").alias("weak"))
    out = files
    for part in (counts, sums, covered(asserted, "assertion_lines"), covered(found, "case_lines"), covered(own.where("kind = 'call'"), "call_lines"), bare):
        out = out.join(part, "path", "left")
    none, empty = F.lit(0).cast("long"), F.array().cast("array<int>")
    return out.select("path", "provider", *(F.coalesce(c, none).alias(c) for c in ("cases", "skipped", "alone", "assertions", "weak")), *(F.coalesce(c, empty).alias(c) for c in ("assertion_lines", "case_lines", "call_lines")), F.coalesce("without_assertion", F.array().cast("array<string>")).alias("without_assertion"))


def collected(files: DataFrame) -> DataFrame:
    """For each provider its files, those among them without any case, and cases."""
    own = files.select("path", provider_of(F.col("path"), F.col("language")).alias("provider")).where("provider is not null")
    found = cases(files).groupBy("path").agg(F.count(F.lit(1)).alias("cases"))
    return own.join(found, "path", "left").groupBy("provider").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("cases").isNull()).alias("without_cases"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"))

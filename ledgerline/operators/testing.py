"""Test suites: associations, coverage, facts by provider, policies, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import not_within, within
from ledgerline.operators.scores import exact_p95_by


def unbaselined(discovered: DataFrame, canonical: DataFrame) -> DataFrame:
    return discovered.join(canonical.select("path").distinct(), "path", "left_anti")


def summarize(facts: DataFrame) -> DataFrame:
    """For each provider its files, cases and 95th percentiles; that of control flow only if every row has it."""
    measured = ("loc", "assertions", "mocks", "control_flow")
    counts = facts.groupBy("provider").agg(F.countDistinct("file").alias("files"), F.sum("cases").alias("cases"), F.bool_and(F.col("control_flow").isNotNull()).alias("_all"))
    ranked = exact_p95_by(facts.withColumn("provider", F.coalesce("provider", F.lit(""))), ["provider"], {c: F.col(c) for c in measured})
    wide = ranked.groupBy("provider").agg(*(F.max(F.when(F.col("metric") == c, F.col("v"))).alias(f"_{c}") for c in measured)).withColumnRenamed("provider", "_provider")
    out = counts.join(wide, F.coalesce("provider", F.lit("")) == F.col("_provider"), "left")
    value = lambda c: F.coalesce(f"_{c}", F.lit(0.0))
    return out.select("provider", "files", "cases", *(value(c).alias(f"p95_{c}") for c in measured[:3]), F.when(F.col("_all"), value("control_flow")).alias("p95_control_flow"))


def coverage_status(discovered: Column, supported: Column, parsed: Column, failed: Column) -> Column:
    """The first that holds: nothing to cover, unsupported, unavailable, partial, complete. All are numbers of files."""
    return F.when(discovered == 0, "not_applicable").when(supported == 0, "unsupported").when(parsed == 0, "unavailable").when((failed > 0) | (parsed < discovered), "partial").otherwise("complete")


def apply_policy(findings: DataFrame, policy: DataFrame, exemptions: DataFrame, now: Column) -> DataFrame:
    """Each finding (rule_id, kind, file) with its action: exempted by an exemption (rule_id, file: null for all, expires) that runs on, else by policy (key, action) for its kind or rule, else review."""
    live = exemptions.where(F.col("expires") > now).select(F.col("rule_id").alias("_rule"), F.col("file").alias("_file")).distinct()
    everywhere = live.where("_file is null").select(F.col("_rule").alias("rule_id"), F.lit(True).alias("_all"))
    there = live.where("_file is not null").select(F.col("_rule").alias("rule_id"), F.col("_file").alias("file"), F.lit(True).alias("_here"))
    by_kind, by_rule = policy.select(F.col("key").alias("kind"), F.col("action").alias("_by_kind")), policy.select(F.col("key").alias("rule_id"), F.col("action").alias("_by_rule"))
    out = findings.join(everywhere, "rule_id", "left").join(there, ["rule_id", "file"], "left").join(by_kind, "kind", "left").join(by_rule, "rule_id", "left")
    action = F.when(F.coalesce("_all", "_here", F.lit(False)), "exempted").otherwise(F.coalesce("_by_kind", "_by_rule", F.lit("review")))
    return out.select("rule_id", "kind", "file", "line", action.alias("action"))


def worst_action(actions: DataFrame) -> DataFrame:
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "warn", 2).when(F.col("action") == "review", 1).otherwise(0)
    return actions.agg(F.element_at(F.array(*map(F.lit, ("pass", "review", "warn", "block"))), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("verdict"))


def control_flow(bodies: DataFrame, flow: DataFrame, nested: DataFrame) -> DataFrame:
    """For each test body (file, test, start, end) its control flow (file, line, weight), without that in nested functions (file, start, end); null without a span."""
    own = bodies.where("start is not null").withColumnsRenamed({"start": "a", "end": "z"})
    outside = not_within(flow, nested.withColumnsRenamed({"start": "na", "end": "nz"}), "file", "line", "na", "nz")
    inside = within(outside, own, "file", "line", "a", "z").groupBy("file", "test").agg(F.sum("weight").alias("flow"))
    return bodies.join(inside, ["file", "test"], "left").select("file", "test", F.when(F.col("start").isNotNull(), F.coalesce("flow", F.lit(0.0))).alias("control_flow"))


def assertion_wrappers(functions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Functions (file, name, start, end) that hold an assertion (file, line)."""
    return within(assertions, functions, "file", "line", "start", "end").select("file", "name", "start", "end").distinct()


def block_semantics(block: Column, assertions: Column, case_lines: Column, call_lines: Column) -> Column:
    """What a block of lines is, by the lines that it shares: assertion, case_body, assembly or unclassified."""
    return F.when(F.arrays_overlap(block, assertions), "assertion").when(F.arrays_overlap(block, case_lines), "case_body").when(F.arrays_overlap(block, call_lines), "assembly").otherwise("unclassified")


def case_lines(spans: DataFrame) -> DataFrame:
    """The lines of each file that are in a test case."""
    return spans.where(F.col("start") <= F.col("end")).select("file", F.explode(F.sequence("start", "end")).alias("line")).groupBy("file").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def growth(numstat: DataFrame) -> DataFrame:
    """One row: lines added and removed in test files and in others, and their ratio. numstat: path, added, removed."""
    test = F.col("path").endswith(".test.ts")
    n = F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))
    out = numstat.where(F.col("path").endswith(".ts")).agg(F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias("test_lines"), F.coalesce(F.sum(F.when(~test, n)), F.lit(0)).alias("other_lines"))
    return out.withColumn("growth", F.when(F.col("other_lines") > 0, F.col("test_lines") / F.col("other_lines")))


def semantic_buckets(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """For each file the lines of its repeated blocks (file, lines, semantics) by what they are, overlaps counted again; charged: those that are neither assertions nor case bodies, and their share of the file's lines (file, total)."""
    own = blocks.groupBy("file").agg(*(F.sum(F.when(F.col("semantics") == k, F.col("lines")).otherwise(0)).alias(k) for k in ("assertion", "case_body", "assembly", "unclassified")))
    charged = F.col("assembly") + F.col("unclassified")
    return own.join(totals, "file").select("file", "assertion", "case_body", "assembly", "unclassified", charged.alias("charged"), F.when(F.col("total") > 0, charged / F.col("total")).alias("share"))


def assertion_language(path: Column) -> Column:
    return F.when(path.endswith(".java"), "java").when(path.endswith(".py"), "python").when(F.lower(path).rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|vue)$"), "ts")


def declares_expected_failure(modifiers: Column) -> Column:
    """Whether a test's annotation says that it is to fail."""
    return modifiers.rlike(r"@(?:[A-Za-z0-9_.]+\.)?Test\s*\([^)]*?\bexpected\s*=")


def weak_patterns(files: DataFrame, declared: DataFrame, builtin: DataFrame) -> DataFrame:
    """files (path, language) with the weak assertions of their language: the project's own (language, patterns) before the built-in ones, and whose they are."""
    out = files.join(declared.withColumnRenamed("patterns", "_own"), "language", "left").join(builtin.withColumnRenamed("patterns", "_built"), "language", "left")
    return out.select("path", "language", F.coalesce("_own", "_built").alias("patterns"), F.when(F.col("_own").isNotNull(), "project").when(F.col("_built").isNotNull(), "builtin").alias("origin"))


def suggested_adapters(languages: DataFrame, adapters: DataFrame) -> DataFrame:
    """The distinct adapters (language, adapter) of the languages found (language), in order."""
    return adapters.join(languages.distinct(), "language", "left_semi").select("adapter").distinct().orderBy("adapter")


def selected_adapters(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Wanted adapters (adapter) with what the registry has (adapter, kind), or an error for unknown ones."""
    return wanted.join(registry, "adapter", "left").select("adapter", "kind", F.when(F.col("kind").isNull(), F.concat(F.lit("unknown adapter "), F.col("adapter"))).alias("error"))


def span_availability(files: DataFrame, handled: DataFrame, failed: DataFrame, providers: int) -> DataFrame:
    """One row: whether spans of all files (path) are there: unavailable without a provider or a file, partial where a file isn't handled or a collection failed."""
    missing = files.join(handled.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    n = files.agg(F.count(F.lit(1)).alias("n")).join(missing).join(failed.agg(F.count(F.lit(1)).alias("failed")))
    return n.select(F.when((F.lit(providers) == 0) | (F.col("n") == 0), "unavailable").when((F.col("missing") > 0) | (F.col("failed") > 0), "partial").otherwise("available").alias("availability"))


def scoped_evidence(findings: DataFrame, provider: str, rule: str, complete: Column) -> DataFrame:
    """One row: number of a provider's and rule's findings, and the worst verdict; no verdict where coverage isn't complete."""
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "warn", 2).when(F.col("action") == "review", 1).otherwise(0)
    own = findings.where((F.col("provider") == provider) & (F.col("rule_id") == rule))
    worst = F.element_at(F.array(*map(F.lit, ("PASS", "REVIEW", "WARN", "BLOCK"))), F.coalesce(F.max(rank), F.lit(0)) + 1)
    return own.agg(F.count(F.lit(1)).alias("findings"), F.when(complete, worst).alias("verdict"))


def wrapper_exports(functions: DataFrame, assertions: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, name) of exported functions (exports: file, name) that hold an assertion."""
    return assertion_wrappers(functions, assertions).select("file", "name").join(exports.select("file", "name"), ["file", "name"], "left_semi").distinct()

"""Reports over facts: test suites under a policy, the state of baselines, readiness of what enforces rules. A part that fails leaves the others as they are."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import syntax, test_cases
from ledgerline.operators import testing, trees
from ledgerline.sources.tables import cut_lineage

FINDINGS = ("rule_id", "kind", "file", "test", "line")


def test_findings(nodes: DataFrame, rules: Sequence[trees.TreeRule] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rule_id, kind, file, test, line) of test files in syntax rows, and why some rules can't run: cases that are skipped or run alone, cases without an assertion, assertions that say little, and what rules find."""
    cases = test_cases.in_nodes(nodes)
    stated = cases.where("state is not null").select(F.concat(F.lit("test-"), "state").alias("rule_id"), "state", F.col("path").alias("file"), F.col("name").alias("test"), "line").withColumnRenamed("state", "kind")
    evidence = test_cases.evidence(nodes)
    bare = evidence.select("path", F.explode("without_assertion").alias("name")).join(cases.select("path", "name", "line"), ["path", "name"]).select(F.lit("test-missing-assertion").alias("rule_id"), F.lit("missing_assertion").alias("kind"), F.col("path").alias("file"), F.col("name").alias("test"), "line").distinct()
    tests = nodes.where(test_cases.provider_of(F.col("path"), F.col("language")).isNotNull())
    weak = test_cases.assertions(tests).where("weak").select(F.lit("test-weak-assertion").alias("rule_id"), F.lit("weak_assertion").alias("kind"), F.col("path").alias("file"), F.lit(None).cast("string").alias("test"), "line")
    parts, failed = [stated, bare, weak], {}
    if rules:
        found, failed = trees.findings(rules, tests)
        parts.append(found.select(F.col("rule").alias("rule_id"), F.col("scope").alias("kind"), F.col("path").alias("file"), F.lit(None).cast("string").alias("test"), "line"))
    return reduce(DataFrame.unionByName, [p.select(*FINDINGS) for p in parts]), failed


def test_report(files: DataFrame, policy: DataFrame, exemptions: DataFrame, now: Column, canonical: DataFrame | None = None, rules: Sequence[trees.TreeRule] = ()) -> dict[str, DataFrame | dict]:
    """The report on the test files among files (path, language, content), which are read once.

    findings: with their actions under the policy (key, action) and its exemptions (rule_id, file, expires). verdict: the worst of them; BLOCK where a rule can't run. providers: files, those read, failed and without cases, cases,
    skipped, alone, assertions, weak and the status of coverage. unbaselined: test files that canonical (path) lacks. failed: rules that can't run.
    """
    provider = test_cases.provider_of(F.col("path"), F.col("language"))
    tests = files.withColumn("provider", provider).where("provider is not null")
    nodes = cut_lineage(syntax.nodes(tests), "nodes")
    found, failed = test_findings(nodes, rules)
    found = cut_lineage(found, "findings")
    actions = testing.apply_policy(found.drop("test"), policy, exemptions, now)
    verdict = testing.worst_action(actions).withColumn("verdict", F.when(F.lit(bool(failed)), "block").otherwise(F.col("verdict")))
    evidence = test_cases.evidence(nodes)
    errors = nodes.where("kind = 'error'").select("path", F.lit(True).alias("_bad"))
    each = tests.select("path", "provider").join(evidence.drop("provider"), "path", "left").join(errors, "path", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cases", "skipped", "alone", "assertions", "weak")]
    providers = each.groupBy("provider").agg(F.count(F.lit(1)).alias("files"), F.count_if("_bad").alias("failed"), F.count_if(F.col("cases") == 0).alias("without_cases"), *sums)
    read = F.col("files") - F.col("failed")
    providers = providers.withColumn("status", testing.coverage_status(F.col("files"), F.col("files"), read - F.col("without_cases"), F.col("failed") + F.col("without_cases")))
    out: dict[str, DataFrame | dict] = {"findings": actions, "verdict": verdict, "providers": providers, "failed": failed}
    if canonical is not None:
        out["unbaselined"] = testing.unbaselined(tests.select("path"), canonical)
    return out


def assembled(spark: SparkSession, reports: Mapping[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all reports by source, states): a report that fails gives no rows and its reason; the others go on. Each report's rows are written, so that what fails does so alone."""
    rows, states = spark.createDataFrame([], f"source string, {schema}"), []
    for name, make in reports.items():
        try:
            own = cut_lineage(make().select(F.lit(name).alias("source"), *rows.columns[1:]), "report")
        except (PySparkException, ValueError, RuntimeError) as e:
            states.append((name, "unavailable", f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
            continue
        rows = rows.unionByName(own)
        states.append((name, "available", None))
    return rows, spark.createDataFrame(states, "source string, state string, reason string")


def source_snapshots(sources: DataFrame, key: str = "project") -> DataFrame:
    """An identity of each project's files (path, hash), whatever their order; hashes meet by chunks first, so no project's files come together."""
    hashed = sources.select(key, F.sha2(F.concat_ws("\0", "path", "hash"), 256).alias("h"))
    parts = hashed.groupBy(key, F.substring("h", 1, 3).alias("chunk")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("part"))
    return parts.groupBy(key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "chunk", "part")))), 256).alias("snapshot"))


def status(projects: DataFrame, baselines: DataFrame, sources: DataFrame) -> DataFrame:
    """For each project (project, expected_scope) its baseline (project, n_files, scope, snapshot): exists, n_files, scope, freshness, and why there is none.

    Freshness compares the baseline's snapshot with that of the sources as they are; it is known only where the scope is what it was and the baseline has a snapshot.
    """
    own = projects.join(baselines.withColumn("_there", F.lit(True)), "project", "left").join(source_snapshots(sources).withColumnRenamed("snapshot", "_now"), "project", "left")
    there = F.coalesce("_there", F.lit(False))
    scope = F.when(~there | F.col("scope").isNull(), "unknown").when(F.col("scope") == F.col("expected_scope"), "compatible").otherwise("incompatible")
    reason = F.when(~there, "no_readable_index").when(scope != "compatible", "scope_not_compatible").when(F.col("snapshot").isNull(), "baseline_missing_snapshot_identity").when(F.col("_now").isNull(), "source_snapshot_unavailable")
    fresh = F.when(reason.isNotNull(), "unknown").when(F.col("snapshot") == F.col("_now"), "current").otherwise("stale")
    return own.select("project", there.alias("exists"), F.coalesce("n_files", F.lit(0)).alias("n_files"), scope.alias("scope"), fresh.alias("freshness"), reason.alias("reason"))


#: What each item of the checklist is for.
ITEM_KINDS = {
    "code-hook": "enforcing", "code-hook-runtime": "enforcing", "coordination-service": "optional", "document-store": "advisory", "document-scope": "advisory", "document-hook": "advisory", "document-hook-runtime": "advisory", "document-similarity": "advisory",
}


def readiness_items(projects: DataFrame) -> DataFrame:
    """(project, item, state, kind) of a checklist by project: ready, unavailable, not_configured or not_observed.

    projects: project, code_hook and document_hook (missing, external, stale or own), runtime (whether the hooks' executable is there), coordination (missing, invalid or configured), store (missing, project-local or shared), scope_configured,
    associated, registered and observed_at.
    """
    hook = lambda c: F.when(F.col(c) == "missing", "not_configured").when(F.col(c) == "own", "ready").otherwise("unavailable")
    ready = lambda c: F.when(c, "ready").otherwise("unavailable")
    shared, scoped = F.col("store") == "shared", F.col("scope_configured")
    store = F.when(F.col("store") == "missing", "not_configured").when(F.col("store") == "project-local", "ready").otherwise(ready(scoped & F.col("associated")))
    items = {
        "code-hook": hook("code_hook"), "code-hook-runtime": F.when(F.col("code_hook") == "own", ready(F.col("runtime"))), "coordination-service": F.when(F.col("coordination") == "missing", "not_configured").otherwise(ready(F.col("coordination") == "configured")),
        "document-store": store, "document-scope": F.when(shared & scoped, ready(F.col("registered"))), "document-hook": F.when(shared & scoped, hook("document_hook")), "document-hook-runtime": F.when(shared & scoped, ready(F.col("runtime"))),
        "document-similarity": F.when((F.col("store") == "project-local") | (shared & scoped), F.when(F.col("observed_at").isNotNull(), "ready").otherwise("not_observed")),
    }
    each = F.array(*(F.struct(F.lit(name).alias("item"), state.alias("state"), F.lit(ITEM_KINDS[name]).alias("kind")) for name, state in items.items()))
    return projects.select("project", F.explode(F.filter(each, lambda x: x["state"].isNotNull())).alias("i")).select("project", "i.item", "i.state", "i.kind")


def display_width(text: Column) -> Column:
    """Columns that a text takes up: wide characters two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{2E81}-\x{10FFFF}]", ""))


def aligned(df: DataFrame, columns: Mapping[str, str], order: str, right: Sequence[str] = ()) -> DataFrame:
    """(position, line) of a table as text, the headers (columns: header by name) at position 0 and the rows in their order: each column as wide as its widest cell, `right` ones flush right. Missing cells are empty."""
    names = list(columns)
    cells = df.select(F.col(order).alias("_order"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))
    widths = cells.agg(*(F.greatest(F.coalesce(F.max(display_width(F.col(c))), F.lit(0)), display_width(F.lit(columns[c]))).alias(f"_w{i}") for i, c in enumerate(names)))
    head = df.sparkSession.range(1).select(F.lit(None).cast(cells.schema["_order"].dataType).alias("_order"), *(F.lit(columns[c]).alias(c) for c in names))

    def padded(i: int, c: str) -> Column:
        gap = F.repeat(F.lit(" "), F.col(f"_w{i}") - display_width(F.col(c)))
        return F.concat(gap, c) if c in right else F.concat(c, gap)

    every = head.withColumn("_head", F.lit(True)).unionByName(cells.withColumn("_head", F.lit(False))).crossJoin(F.broadcast(widths))  # one row of widths
    line = F.concat_ws(" ", *(padded(i, c) for i, c in enumerate(names)))
    return every.select(F.when(F.col("_head"), None).otherwise(F.col("_order")).alias("position"), line.alias("line"))


#: The classes of names that a project may declare for a language, those that are named but have no effect yet, and the languages.
SHAPE_CLASSES, LATER_CLASSES, SHAPE_LANGUAGES = ("weak_assertion_methods",), ("assertion_methods", "fixture_call_patterns"), ("java", "typescript")


def shape_declarations(configurations: DataFrame, column: str = "shapes") -> tuple[DataFrame, DataFrame]:
    """(shapes: id, language, names; errors: id, path, kind) of JSON mappings of language to class to names, read strictly: what has an error must not be used in part.

    Kinds: invalid_value (no mapping, or no list of texts that aren't blank), invalid_language_key, not_wired (a language or a class without effect yet) and unknown_shape_class. A missing declaration has neither.
    """
    mapping = r"^\s*\{"
    own = configurations.select("id", F.col(column).alias("raw")).where("raw is not null")
    bad = own.where(~F.col("raw").rlike(mapping)).select("id", F.lit("shapes").alias("path"), F.lit("invalid_value").alias("kind"))
    entries = own.where(F.col("raw").rlike(mapping)).select("id", F.explode(F.from_json("raw", "map<string,string>")).alias("language", "value"))
    path = F.concat(F.lit("shapes."), F.col("language"))
    problem = F.when(~F.col("language").rlike("^[a-z][a-z0-9_+-]*$"), "invalid_language_key").when(~F.col("language").isin(*SHAPE_LANGUAGES), "not_wired").when(~F.coalesce(F.col("value"), F.lit("")).rlike(mapping), "invalid_value")
    judged = entries.select("id", "language", "value", path.alias("path"), problem.alias("kind"))
    classes = judged.where("kind is null").select("id", "language", F.explode(F.from_json("value", "map<string,string>")).alias("class", "names"))
    listed = r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'
    names = F.from_json("names", "array<string>")
    fine = F.coalesce(F.col("names"), F.lit("")).rlike(listed) & ~F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(n) == "")
    wrong = F.when(F.col("class").isin(*LATER_CLASSES), "not_wired").when(~F.col("class").isin(*SHAPE_CLASSES), "unknown_shape_class").when(~fine, "invalid_value")
    each = classes.select("id", "language", names.alias("names"), F.concat_ws(".", F.lit("shapes"), "language", "class").alias("path"), wrong.alias("kind"))
    errors = bad.unionByName(judged.where("kind is not null").select("id", "path", "kind")).unionByName(each.where("kind is not null").select("id", "path", "kind"))
    return each.where("kind is null").select("id", "language", "names").where(F.size("names") > 0), errors

"""Checks and states: integrity of references and snapshots, calibration states, audits, status folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.paths import matches


def first_failing(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails; null if all hold."""
    out = None
    for holds, reason in checks:
        out = (F.when if out is None else out.when)(~F.coalesce(holds, F.lit(False)), F.lit(reason))
    return out


def baseline_compatibility(df: DataFrame) -> DataFrame:
    """df (has_index, scope, shapes, snapshot, contract, each with expected_*) with the first reason that rules a baseline out."""
    same = lambda c: F.col(c).eqNullSafe(F.col(f"expected_{c}"))
    return df.withColumn("reason", first_failing((F.col("has_index"), "missing_index"), (same("scope"), "scope"), (same("shapes"), "shapes"), (same("snapshot"), "snapshot"), (same("contract"), "contract")))


def snapshot_violations(rows: DataFrame, declared: DataFrame, key: str = "path") -> DataFrame:
    """Reasons why rows aren't the snapshot that declared (n_files, n_production, n_test: one row) says."""
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.count_if(F.coalesce("kind", F.lit("production")) == "production").alias("p"), F.count_if(F.col("kind") == "test").alias("t"))
    both = own.crossJoin(F.broadcast(declared))
    reasons = F.array_compact(F.array(F.when(F.col("n") != F.col("d"), "repeated"), F.when(F.col("n") != F.col("n_files"), "files"), F.when(F.col("p") != F.col("n_production"), "production"), F.when(F.col("t") != F.col("n_test"), "test")))
    return both.select(F.explode(reasons).alias("reason"))


def dangling(children: DataFrame, parents: DataFrame, reference: str, key: str) -> DataFrame:
    """Children whose reference, not null, is no parent's key."""
    return children.where(F.col(reference).isNotNull()).join(parents.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def invalid_facts(facts: DataFrame) -> DataFrame:
    """Facts (id, availability, value, reason) that break their form, with what is wrong: no id, an available one without a value, an unavailable one with a value, one that isn't available without a reason."""
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    state = F.col("availability")
    wrong = (
        F.when(~text(F.col("id")), "id").when((state == "available") & F.col("value").isNull(), "value").when((state == "unavailable") & F.col("value").isNotNull(), "exposed")
        .when((state != "available") & ~text(F.col("reason")), "reason")
    )
    return facts.withColumn("wrong", wrong).where("wrong is not null")


def audit(hashes: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """Each recorded configuration with its state: initialized, unchanged, drift, or missing_config."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(at))
    first = F.row_number().over(Window.partitionBy(key).orderBy(at)) == 1
    state = F.when(F.col(digest).isNull(), "missing_config").when(first | before.isNull(), "initialized").when(F.col(digest) == before, "unchanged").otherwise("drift")
    return hashes.withColumn("state", state)


def evidence_status(statuses: DataFrame, group: str, status: str = "status") -> DataFrame:
    """For each group: unavailable if all are, partial if some are, confirmed if any is, else not_confirmed."""
    n, missing, confirmed = F.count(F.lit(1)), F.count_if(F.col(status) == "unavailable"), F.count_if(F.col(status) == "confirmed")
    return statuses.groupBy(group).agg(F.when(missing == n, "unavailable").when(missing > 0, "partial").when(confirmed > 0, "confirmed").otherwise("not_confirmed").alias("status"))


def admission(requirements: DataFrame, group: str, available: str = "available") -> DataFrame:
    """For each group: available if all requirements are, unavailable if none is, else partial."""
    return requirements.groupBy(group).agg(F.when(F.bool_and(available), "available").when(~F.bool_or(available), "unavailable").otherwise("partial").alias("admission"))


def gaps_by_language(gaps: DataFrame) -> DataFrame:
    """For each language the last reason by position and the number of distinct files."""
    return gaps.groupBy("language").agg(F.max_by("reason", "position").alias("reason"), F.countDistinct("file").alias("files"))


def calibration_profiles(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each group of samples (id, kind, matched) the first reason against it: repeated ids, no matched positive, no rejected negative."""
    positive, negative = F.count_if((F.col("kind") == "positive") & F.col("matched")), F.count_if((F.col("kind") == "negative") & ~F.col("matched"))
    out = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("id").alias("ids"), positive.alias("positives"), negative.alias("negatives"))
    return out.withColumn("reason", first_failing((F.col("samples") == F.col("ids"), "repeated"), (F.col("positives") > 0, "no_positive"), (F.col("negatives") > 0, "no_negative")))


def next_calibration(state: DataFrame, observed: Column, seal: Column) -> DataFrame:
    """A calibration state (current, previous, gate) after an observation: sealing moves current to previous and gates on what is observed."""
    moved = F.when(observed.eqNullSafe(F.col("current")), F.col("previous")).otherwise(F.col("current"))
    return state.withColumns({"current": observed, "previous": moved, "gate": F.when(seal | F.col("gate").isNull(), observed).otherwise(F.col("gate"))})


def capability_drift(changed: DataFrame, watches: Sequence[tuple[str, str]]) -> DataFrame:
    """(asset, path): changed paths that an asset watches by glob, for assets that didn't change themselves. watches: asset, glob."""
    hits = [F.when(matches(F.col("path"), glob) & (F.col("path") != asset), F.lit(asset)) for asset, glob in watches]
    found = changed.withColumn("asset", F.explode(F.array_distinct(F.array_compact(F.array(*hits))))).select("asset", "path")
    return found.join(changed.select(F.col("path").alias("asset")), "asset", "left_anti")


def latest_observations(observations: DataFrame, key: str = "operation", at: str = "at") -> DataFrame:
    """The last observation of each operation."""
    return observations.groupBy(key).agg(F.max_by(F.struct(*[c for c in observations.columns if c != key]), at).alias("o")).select(key, "o.*")


def invalid_projections(projections: DataFrame) -> DataFrame:
    """Policy projections (policy_id, action, subject_kind, subject_id) that no policy may rest on, with what is wrong; a signal is no subject."""
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    wrong = F.when(~text(F.col("policy_id")), "policy_id").when(~F.coalesce(F.col("action").isin("report", "warn", "block"), F.lit(False)), "action").when(~(F.coalesce(F.col("subject_kind").isin("metric", "finding"), F.lit(False)) & text(F.col("subject_id"))), "subject")
    return projections.withColumn("wrong", wrong).where("wrong is not null")


def invalid_evidence(evidence: DataFrame) -> DataFrame:
    """Validation evidence with the first thing that is wrong with it: names, identifiers, languages, times, their order, counts."""
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    # fixed values of the format: what an identifier may be
    identifier = lambda c: F.coalesce(F.col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:@-]{0,127}$"), F.lit(False))
    counts = F.lit(True)
    for c in ("findings", "false_positives", "false_negatives"):
        counts = counts & F.coalesce((F.col(c) >= 0) & (F.col(c) == F.floor(c)), F.lit(False))
    languages = (F.size("languages") > 0) & ~F.exists("languages", lambda x: ~text(x))
    times = F.col("observed_at").isNotNull() & F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
    wrong = first_failing((text(F.col("project")) & text(F.col("provider")), "names"), (identifier("provider") & identifier("rule_id") & identifier("authority_id"), "identifiers"), (languages, "languages"), (times, "times"), (F.col("started_at") <= F.col("ended_at"), "window"), (counts, "counts"))
    return evidence.withColumn("wrong", wrong).where("wrong is not null")


def same_population(left: Column, right: Column) -> Column:
    """Whether two calibration profiles (structs) describe one population: scope, contract, population and source."""
    out = F.lit(True)
    for field in ("scope", "contract", "population", "source"):
        out = out & left[field].eqNullSafe(right[field])
    return out


def gate_profile(gate: Column, current: Column) -> Column:
    """The calibration that a gate uses."""
    return F.coalesce(gate, current)


def orphaned(baseline: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of a baseline whose source is gone."""
    return baseline.select("path").join(files.select("path"), "path", "left_anti")


def select_facts(facts: DataFrame, domains: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Facts of the domains or with the ids, each once."""
    return facts.where(F.col("domain").isin(*domains) | F.col("id").isin(*ids))


def unreferenced(declarations: DataFrame, references: DataFrame, coverage: DataFrame) -> DataFrame:
    """Internal declarations (language, name, surface) without any reference (name), of languages (language, coverage) that are covered completely."""
    whole = coverage.where("coverage = 'complete'").select("language")
    return declarations.where("surface = 'internal'").join(whole, "language", "left_semi").join(references.select("name").distinct(), "name", "left_anti")


def hygiene(hits: DataFrame, levels: DataFrame, selected: DataFrame, ran: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: the worst level of all hits (source), by the sources' levels (source, level); BLOCK where a selected rule (rule) didn't run or failed."""
    rank = F.when(F.col("level") == "block", 2).when(F.col("level") == "warn", 1).otherwise(0)
    worst = hits.join(levels, "source", "left").agg(F.coalesce(F.max(rank), F.lit(0)).alias("worst"), F.count(F.lit(1)).alias("hits"))
    missing = selected.select("rule").distinct().join(ran.select("rule").distinct().join(failed.select("rule"), "rule", "left_anti"), "rule", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return worst.join(missing).select(F.when(F.col("missing") > 0, "BLOCK").otherwise(F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "BLOCK"))), F.col("worst") + 1)).alias("quality"), "hits", "missing")


def unique_facts(facts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Facts that are told apart by these fields alone, each once."""
    return facts.select(*fields).distinct()


def first_known(*values: Column) -> Column:
    """What is known first: the profile's own state before a change, else what was read from the last commit, else none."""
    return F.coalesce(*values)


def shadow_evidence(rows: DataFrame) -> DataFrame:
    """(identity, availability): of rows (identity, availability) each identity once; one that comes more than once is partial."""
    return rows.groupBy("identity").agg(F.when(F.count(F.lit(1)) > 1, "partial").otherwise(F.first("availability")).alias("availability"))


def overall(rows: DataFrame) -> DataFrame:
    """One row: available if all are, unavailable if none is or there are none, else partial."""
    n, available, missing = F.count(F.lit(1)), F.count_if(F.col("availability") == "available"), F.count_if(F.col("availability") == "unavailable")
    return rows.agg(F.when(n == missing, "unavailable").when(n == available, "available").otherwise("partial").alias("availability"), n.alias("identities"))


def scope_admissions(symbols: DataFrame) -> DataFrame:
    """For each changed public symbol (id, and a flag for each requirement) its admission and the requirements that it lacks."""
    wanted = ("declaration", "references", "calibration", "population", "consumers", "surface")
    each = symbols.select("id", F.explode(F.array(*(F.struct(F.lit(w).alias("requirement"), F.coalesce(F.col(w), F.lit(False)).alias("available")) for w in wanted))).alias("r")).select("id", "r.*")
    lacking = each.groupBy("id").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("requirement"))))).alias("lacking"))
    return admission(each, "id").join(lacking, "id")


def comparable(previous: Column, current: Column) -> Column:
    """Whether two calibrations (structs) differ in their population alone, so that a shift of burdens comes from it."""
    same = F.lit(True)
    for field in ("scope", "contract", "weights"):
        same = same & previous[field].eqNullSafe(current[field])
    return F.coalesce(previous.isNotNull() & current.isNotNull() & same & ~previous["population"].eqNullSafe(current["population"]), F.lit(False))


def calibration_samples(reports: DataFrame) -> DataFrame:
    """Samples of version pairs (id, files, family, before_provider, after_provider, available, reason, observed, state) with the reasons against them, joined, and their availability."""
    same = F.col("before_provider").isNull() | F.col("after_provider").isNull() | (F.col("before_provider") == F.col("after_provider"))
    reasons = F.array_compact(F.array(
        F.when(F.size(F.coalesce("files", F.array().cast("array<string>"))) == 0, "no common population"), F.when(F.col("family") == "unknown", "family is not unique"), F.when(~same, "providers differ"),
        F.when(~F.col("available"), F.coalesce("reason", F.lit("coverage is not complete"))), F.when(F.col("observed") == "unavailable", "not observed"), F.when(F.col("observed") == "ambiguous", "ambiguous")))
    state = F.when(F.col("available") & (F.size(reasons) == 0), "available").when(F.col("state") == "unavailable", "unavailable").otherwise("partial")
    provider = F.when(same, F.coalesce("before_provider", "after_provider"))
    return reports.select("id", F.coalesce(provider, F.lit("none")).alias("provider"), F.concat_ws("; ", reasons).alias("reason"), state.alias("availability"))


def evidence_state(profiles: DataFrame, reports: DataFrame) -> DataFrame:
    """Profiles (id, language) with what their language's report (language, availability, complete) allows: absent, unavailable, partial or complete."""
    state = F.when(F.col("availability").isNull(), "absent").when(F.col("availability") == "unavailable", "unavailable").when((F.col("availability") == "partial") | ~F.coalesce("complete", F.lit(False)), "partial").otherwise("complete")
    return profiles.join(reports.select("language", "availability", "complete"), "language", "left").select("id", "language", state.alias("state"))


def pair_evidence(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each wanted symbol (language, file, symbol) with whether its language's first available pair (language, position, availability, files, before, matched: arrays) had it before, matched it after, and holds its file."""
    first = pairs.where("availability = 'available'").groupBy("language").agg(F.min_by(F.struct("files", "before", "matched"), "position").alias("p"))
    held = lambda c, of: F.coalesce(F.array_contains(F.col(f"p.{of}"), F.col(c)), F.lit(False))
    return wanted.join(first, "language", "left").select("language", "file", "symbol", held("symbol", "before").alias("existed"), held("symbol", "matched").alias("matched"), held("file", "files").alias("in_population"))


def with_local_authorities(facts: DataFrame, local: DataFrame) -> DataFrame:
    """Authorities (id, path) of the project with a rule's own; an id that both have is an error."""
    clash = [r[0] for r in facts.select("id").join(local.select("id"), "id", "left_semi").distinct().orderBy("id").limit(3).collect()]
    if clash:
        raise ValueError(f"authorities with one id: {', '.join(map(str, clash))}")
    return facts.unionByName(local)


#: Why a gate can't judge; the first that holds is given.
READINESS = ("configuration_missing", "configuration_invalid", "no_rules", "unsupported_rule", "baseline_missing", "baseline_unreadable", "baseline_incompatible", "scope_changed", "shapes_changed", "calibration_missing", "calibration_incompatible", "language_unavailable", "no_files")


def readiness(df: DataFrame) -> DataFrame:
    """df (a flag for each of READINESS, true where it holds) with the first reason against a gate, or null."""
    out = None
    for reason in READINESS:
        out = (F.when if out is None else out.when)(F.coalesce(F.col(reason), F.lit(False)), F.lit(reason))
    return df.withColumn("reason", out)


#: Files that tell of a language's own project.
INDICATORS = {"go.mod": "go", "Cargo.toml": "rust", "package.json": "typescript", "tsconfig.json": "typescript", "pyproject.toml": "python", "setup.py": "python", "pom.xml": "java", "build.gradle": "java"}


def nested_languages(files: DataFrame, covered: Sequence[str]) -> DataFrame:
    """(folder, language) of folders below the root whose files (path) tell of a language that isn't covered, each once and in order."""
    name = F.element_at(F.split("path", "/"), -1)
    language = F.element_at(F.create_map(*(F.lit(x) for pair in INDICATORS.items() for x in pair)), name)
    own = files.where(F.col("path").contains("/") & name.isin(*INDICATORS)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), language.alias("language"))
    return own.where(~F.col("language").isin(*covered)).distinct().orderBy("folder", "language")


def demanded(declarations: DataFrame, demand: DataFrame) -> DataFrame:
    """The declarations (file, name) that somebody asks for (file, name; a null name: all of the file), so that a provider resolves no others."""
    named = declarations.join(demand.where("name is not null").select("file", "name").distinct(), ["file", "name"], "left_semi")
    whole = declarations.join(demand.where("name is null").select("file").distinct(), "file", "left_semi")
    return named.unionByName(whole).distinct()


def governance_facts(spark: SparkSession, reports: Sequence[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """(domain, id, availability, value, reason) of all reports (name, what makes its table of id and value), in one.

    A report that can't be made is one unavailable fact of its own with the reason; the others aren't touched.
    """
    out = None
    for name, make in reports:
        try:
            own = make().select(F.lit(name).alias("domain"), F.col("id").cast("string").alias("id"), F.lit("available").alias("availability"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
        except (AnalysisException, ValueError) as e:
            own = spark.createDataFrame([(name, name, "unavailable", None, type(e).__name__)], "domain string, id string, availability string, value double, reason string")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "domain string, id string, availability string, value double, reason string")

"""Joins by glob, interval and key: policies, containers, revisions, consumers, dispositions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.paths import matches_any, without_index
from ledgerline.sources.tables import cut_lineage, deal, hubs_of, spread


@dataclass(frozen=True)
class Policy:
    """A structural policy: languages, and globs to include (none: all) and exclude."""

    name: str
    languages: tuple[str, ...]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    mode: str = "enforce"
    rules: tuple = field(default=())


def policy_applies(policy: Policy, path: Column, language: Column) -> Column:
    inside = matches_any(path, policy.include) if policy.include else F.lit(True)
    return language.isin(*policy.languages) & inside & ~matches_any(path, policy.exclude)


def policies_of(df: DataFrame, policies: Sequence[Policy], path: str = "path", language: str = "language") -> DataFrame:
    """A row for each row of df and policy that covers it: a glob join as one pass, the policies being part of the plan."""
    named = [F.when(policy_applies(p, F.col(path), F.col(language)), F.lit(p.name)) for p in policies]
    return df.withColumn("policy", F.explode(F.array_compact(F.array(*named))))


def sole_policy(df: DataFrame, policies: Sequence[Policy], path: str = "path", language: str = "language") -> DataFrame:
    """df with the policy that covers a row if exactly one does, else null."""
    named = F.array_compact(F.array(*[F.when(policy_applies(p, F.col(path), F.col(language)), F.lit(p.name)) for p in policies]))
    return df.withColumn("_own", named).withColumn("policy", F.when(F.size("_own") == 1, F.get("_own", 0))).drop("_own")


#: Widths of buckets for intervals, by their lengths.
WIDTHS = tuple(1 << k for k in range(8, 63, 4))


def _dealt(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals, each in the buckets that it touches (_width, _bucket): of the least width that is no less than a sixteenth of its length, so in 17 of them at most."""
    own = intervals.where(F.col(start) <= F.col(end))
    length = F.col(end) - F.col(start)
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(length <= 16 * w, w).otherwise(width)
    own = own.withColumn("_width", width.cast("long"))
    return own.withColumn("_bucket", F.explode(F.expr(f"sequence(floor({start} / _width), floor({end} / _width))")))


def _offered(points: DataFrame, dealt: DataFrame, at: str) -> DataFrame:
    """Points, each in its bucket of every width that occurs."""
    used = sorted(r[0] for r in dealt.select("_width").distinct().collect())  # of WIDTHS
    own = points.withColumn("_width", F.explode(F.array(*(F.lit(w).cast("long") for w in used or WIDTHS[:1]))))
    return own.withColumn("_bucket", F.expr(f"floor({at} / _width)"))


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points in intervals of the same key, both ends included.

    Intervals are dealt to buckets of positions, so that the join is an equi-join; the ends are checked after it.
    """
    dealt = _dealt(intervals, start, end)
    out = _offered(points, dealt, at).join(dealt, [key, "_width", "_bucket"])
    return out.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket", "_width")


def not_within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points in no interval of the same key."""
    inside = within(points.select(key, at).distinct(), intervals.select(key, start, end), key, at, start, end).select(key, at).distinct()
    return points.join(inside, [key, at], "left_anti").select(points.columns)


def smallest_container(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """For each point the narrowest interval that holds it; of equal ones the first by start and name."""
    hits = within(points, intervals, key, at, start, end)
    w = Window.partitionBy(key, at).orderBy(F.col(end) - F.col(start), F.col(start), F.col(name))
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pair_revisions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: matched, added or removed; ambiguous where a side has the key more than once."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    n, m = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    status = F.when((n > 1) | (m > 1), "ambiguous").when(n == 0, "added").when(m == 0, "removed").otherwise("matched")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def sole_associations(imports: DataFrame, production: DataFrame) -> DataFrame:
    """(test, target, source): imports of production files by tests, for each target the first source by position, sorted."""
    hit = imports.join(production.select(F.col("path").alias("target")), "target", "left_semi")
    return hit.groupBy("test", "target").agg(F.min_by("source", "pos").alias("source"))


def promote_associations(associations: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """associations with confidence: `high` and the symbol where a call's source has exactly one target and that exports the function, else `low`."""
    w = Window.partitionBy("test", "source")
    single = associations.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    used = calls.select("test", "source", "symbol").distinct()
    promoted = single.join(used, ["test", "source"]).join(exports.where("kind = 'function'").select(F.col("path").alias("target"), F.col("name").alias("symbol")), ["target", "symbol"], "left_semi")
    promoted = promoted.groupBy("test", "target", "source").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return associations.join(promoted, ["test", "target", "source"], "left").withColumn("confidence", F.when(F.col("symbols").isNull(), "low").otherwise("high"))


def consumers_by_leaf(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor the files of facts (name, file) whose last name part is the anchor's; a file-level anchor (no name) has all."""
    leaf = F.element_at(F.split("name", r"\."), -1)
    f = cut_lineage(facts.select(leaf.alias("leaf"), "file").distinct(), "leaves")  # read three times
    a = anchors.select("anchor", F.when(F.col("symbol").isNotNull(), F.element_at(F.split("symbol", r"\."), -1)).alias("leaf"))
    # a leaf's files meet in one list, which its anchors get as it is: anchors with their files would be as many rows as all lists together
    lists = f.groupBy("leaf").agg(F.array_sort(F.collect_set("file")).alias("files"))
    leaves = cut_lineage(a.where("leaf is not null").groupBy("anchor").agg(F.collect_set("leaf").alias("leaves")), "anchors")
    single = leaves.where(F.size("leaves") == 1).select("anchor", F.element_at("leaves", 1).alias("leaf"))
    named = deal(single, lists, "leaf", hubs_of(single, "leaf")).select("anchor", "files")
    several = leaves.where(F.size("leaves") > 1).select("anchor", F.explode("leaves").alias("leaf")).join(f, "leaf")
    every = f.agg(F.array_sort(F.collect_set("file")).alias("files"))  # one row: the list that each file-level anchor has
    whole = a.where("leaf is null").select("anchor").distinct().join(every).where(F.size("files") > 0)
    return named.unionByName(several.groupBy("anchor").agg(F.array_sort(F.collect_set("file")).alias("files"))).unionByName(whole)


def consumer_sets(symbols: DataFrame, static: DataFrame, key: str = "file") -> DataFrame:
    """For each file its consumers by symbols, by imports alone and by both, as sorted arrays."""
    a = symbols.groupBy(key).agg(F.collect_set("consumer").alias("s"))
    b = static.groupBy(key).agg(F.collect_set("consumer").alias("i"))
    none = F.array().cast("array<string>")
    both = a.join(b, key, "full_outer").select(key, F.coalesce("s", none).alias("s"), F.coalesce("i", none).alias("i"))
    return both.select(key, F.array_sort(F.array_intersect("s", "i")).alias("shared"), F.array_sort(F.array_except("i", "s")).alias("static_only"), F.array_sort(F.array_except("s", "i")).alias("symbol_only"))


def unordered(left: Column, right: Column) -> tuple[Column, Column]:
    return F.least(left, right), F.greatest(left, right)


def latest_dispositions(records: DataFrame) -> DataFrame:
    """The last record (left, right, disposition, at) of each unordered pair."""
    a, b = unordered(F.col("left"), F.col("right"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("at"), F.desc("disposition"))
    return records.select(a.alias("a"), b.alias("b"), "disposition", "at").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unresolved(candidates: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Candidate pairs (left, right) that have no disposition in either order."""
    a, b = unordered(F.col("left"), F.col("right"))
    return candidates.withColumns({"a": a, "b": b}).join(latest_dispositions(dispositions).select("a", "b"), ["a", "b"], "left_anti").drop("a", "b")


def exactly_one(profiles: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the profile of the same keys if exactly one is eligible, else the reason: missing or ambiguous."""
    found = profiles.where("eligible").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("profile").alias("profile"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(found, keys, "left").select(wanted.columns + [F.when(n == 1, F.col("profile")).alias("profile"), F.when(n == 0, "missing").when(n > 1, "ambiguous").alias("reason")])


def fan_out(imports: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each import (importer, source, candidates) and existing candidate path, or one with null.

    Imports are made once, and only they and their candidates are sorted. Those that are dealt by importer and source before (`tables.spread`) stay where they are if files are few.
    """
    tried = imports.select("importer", "source", F.explode_outer("candidates").alias("candidate"))
    known = files.select(F.col("path").alias("candidate"), F.lit(True).alias("_hit")).distinct()
    hit = tried.join(known, "candidate", "left").select("importer", "source", F.when(F.col("_hit"), F.col("candidate")).alias("resolved"))
    first = F.row_number().over(Window.partitionBy("importer", "source").orderBy(F.col("resolved").desc_nulls_last()))
    return hit.withColumn("_first", first).where("resolved is not null or _first = 1").select("importer", "source", "resolved")


def first_existing(imports: DataFrame, files: DataFrame, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each import (importer, source, candidates, and where they are known the stems of the candidates) with its first candidate that exists, or null.

    Files are keyed by their paths without suffix and index name, which nearly all candidates of an import share, and joined once by it, by shuffle.
    candidates: for imports that have base and stems in place of candidates, what adds these to rows; lists of candidates are long, and so they are made only after the join.
    """
    stems = F.col("stems") if "stems" in imports.columns else F.array_distinct(F.transform("candidates", stem))
    none = F.concat(F.lit("\n"), F.xxhash64("importer", "source").cast("string"))  # no file's: what has no candidates must not meet in one task
    asked = imports.select("importer", "source", "candidates" if candidates is None else "base", F.explode_outer(stems).alias("stem")).withColumn("stem", F.coalesce("stem", none))
    known = files.select(stem(F.col("path")).alias("stem"), "path").groupBy("stem").agg(F.collect_set("path").alias("paths"))
    met = spread(asked, "stem").join(known.hint("merge"), "stem", "left")
    found = F.array_min(F.transform(F.array_intersect("candidates", "paths"), lambda c: F.struct(F.array_position("candidates", c).alias("at"), c.alias("path"))))
    if candidates is not None:
        met = candidates(met.withColumn("base", F.when(F.col("paths").isNotNull(), F.col("base"))))  # lists are made only where there is a file
    tried = met.select("importer", "source", F.when(F.col("paths").isNotNull(), found).alias("hit"))
    return spread(tried, "importer", "source").groupBy("importer", "source").agg(F.min("hit")["path"].alias("resolved"))


def stem(path: Column) -> Column:
    """A path without its suffix, and without a last part that stands for its folder."""
    return without_index(F.regexp_replace(path, r"(?:\.d)?\.[A-Za-z]+$", ""))


def dependencies_done(dependencies: DataFrame, status: DataFrame) -> DataFrame:
    """(task, ready): whether all of a task's dependencies are completed; an unknown one isn't."""
    joined = dependencies.join(status.select(F.col("task").alias("depends_on"), "status"), "depends_on", "left")
    return joined.groupBy("task").agg(F.bool_and(F.col("depends_on").isNull() | F.coalesce(F.col("status") == "completed", F.lit(False))).alias("ready"))


def link_events(emits: DataFrame, listeners: DataFrame) -> DataFrame:
    """Implicit edges from each emitter of an event to each listener of it, once each."""
    return emits.select("event", F.col("file").alias("src")).distinct().join(listeners.select("event", F.col("file").alias("dst")).distinct(), "event").select("src", "dst", F.col("event").alias("via")).distinct()


def linked_members(emits: DataFrame, listeners: DataFrame) -> DataFrame:
    """(via, file, role, links): each emitter and each listener of an event once, with how many files of the other role it is linked to.

    The links of `link_events` are, for each event, all emitters with all listeners; of which there are as many as products of the two, and here their sum.
    """
    role = lambda df, name: df.select(F.col("event").alias("via"), "file", F.lit(name).alias("role"))
    members = role(emits, "emits").unionByName(role(listeners, "listens")).where("via is not null").distinct()
    members = cut_lineage(members, "members")
    counts = members.groupBy("via").agg(F.count_if(F.col("role") == "emits").alias("_emit"), F.count_if(F.col("role") == "listens").alias("_listen"))
    out = deal(members, counts, "via", hubs_of(members, "via"))
    return out.select("via", "file", "role", F.when(F.col("role") == "emits", F.col("_listen")).otherwise(F.col("_emit")).alias("links"))


def change_containers(hunks: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each hunk (file, after_start, after_lines) with the narrowest declaration (file, name, start, end) around its first line, or null."""
    at = hunks.select("file", F.col("after_start").alias("line")).distinct()
    inside = smallest_container(at, declarations.select("file", "name", "start", "end"), "file", "line", "start", "end", "name").select("file", F.col("line").alias("after_start"), F.col("name").alias("container"))
    return hunks.join(inside, ["file", "after_start"], "left")


def union_scopes(stores: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Documents of several stores (scope, table) in one, with their scope; columns that a store lacks are null."""
    out = None
    for scope, df in stores:
        own = df.withColumn("scope_id", F.lit(scope))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no store")
    return out


def common_population(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files (path) of both revisions, each once."""
    return before.select("path").intersect(after.select("path"))


def contract_findings(files: DataFrame, imports: DataFrame, roles: Sequence[str], authorities: Sequence[str], required: str) -> DataFrame:
    """(file, authority, kind) of files (path, parsed: null where nothing reads the language) in a role that don't import what they should.

    The first path that an authority glob matches is the authority; without one there is nothing to ask for. Files that can't be parsed are findings of their own kind.
    """
    authority = files.where(matches_any(F.col("path"), authorities)).agg(F.min("path").alias("authority")).where("authority is not null")
    own = files.where(matches_any(F.col("path"), roles)).join(F.broadcast(authority)).where("path != authority")
    joined = own.join(imports.where(F.col("source") == required).select("path").distinct().withColumn("_has", F.lit(True)), "path", "left")
    kind = F.when(~F.col("parsed"), "unparseable").when(F.col("parsed") & F.col("_has").isNull(), "missing_import")
    return joined.select(F.col("path").alias("file"), "authority", kind.alias("kind")).where("kind is not null")


def foreign_wrappers(imports: DataFrame, production: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(test, names): assertion wrappers (path, name) of the files that tests import (test, path), production files left out."""
    own = imports.select("test", "path").distinct().join(production.select("path"), "path", "left_anti")
    return own.join(wrappers, "path").groupBy("test").agg(F.array_sort(F.collect_set("name")).alias("names"))


def resolved_associations(imports: DataFrame, production: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """Associations of tests with production files, with what their calls prove: `sole_associations`, then `promote_associations` over the files that are targets at all."""
    found = sole_associations(imports, production)
    targets = found.select(F.col("target").alias("path")).distinct()
    return promote_associations(found, calls, exports.join(targets, "path", "left_semi"))

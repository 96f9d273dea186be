"""Scores: exact percentiles, burden, structural weight, impact, diagnosis, decayed history."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.tables import prefix_sums

#: The weight of a change kind.
CHANGE_WEIGHTS = {
    "interface_add_remove": 100,
    "class_add_remove": 80,
    "public_method_sig": 60,
    "function_sig": 50,
    "field_add_remove": 40,
    "compatible_field_add": 5,
    "function_body": 10,
    "branch_add": 5,
    "dependency_remove": 15,
    "dependency_add": 5,
    "comment_whitespace": 0,
}

#: The weights of the burden's parts.
BURDEN_WEIGHTS = {"branch": 0.20, "nesting": 0.20, "loc": 0.15, "passthrough": 0.15, "alpha": 0.15, "disconnected": 0.15}

HALF_LIFE_DAYS = 60
DECAY = math.log(2) / HALF_LIFE_DAYS
DAY_MICROS = 86_400_000_000


def p95(column: Column | str) -> Column:
    """The exact 95th percentile with linear interpolation; 0 for no rows."""
    return F.coalesce(F.percentile(column, F.lit(0.95)), F.lit(0.0))


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n, and how many of the same keys' values are below: by distinct values, in ranges."""
    return prefix_sums(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), keys, [value], "n")


def floor_p95(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group, the value at rank floor(0.95 n) from 0, n - 1 at most."""
    ranks = counted(df, [group], value)
    sizes = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    rank = F.least(F.col("_all") - 1, F.floor(F.col("_all") * 0.95))
    return ranks.join(sizes, group).where((F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))).select(group, F.col(value).alias("threshold"))


def size_dispersion(df: DataFrame, size: str) -> DataFrame:
    """One row: 1 for five rows or fewer, else the largest size over the floor-rank 95th percentile (1 at least)."""
    threshold = floor_p95(df.select(F.lit(1).alias("_all_rows"), size), "_all_rows", size)
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"))
    return whole.join(F.broadcast(threshold.select("threshold")), how="left").select("n", F.when(F.col("n") <= 5, 1.0).otherwise(F.col("most") / F.greatest(F.lit(1), F.col("threshold"))).alias("dispersion"))


def exact_p95(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row with the exact 95th percentile, linearly interpolated, of each column; 0 for one without values."""
    found = exact_p95_by(df, [], columns)
    return found.agg(*(F.coalesce(F.max(F.when(F.col("metric") == k, F.col("v"))), F.lit(0.0)).alias(f"p95_{k}") for k in columns))


def exact_p95_by(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """(keys, metric, v): the exact 95th percentile, linearly interpolated, of each column that has values for the keys.

    Columns are taken as rows (keys, metric, value), counted by distinct value and ranked in ranges, so no task sees all values.
    """
    own = [*keys, "metric"]
    pairs = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in columns.items()))).alias("p")).select(*keys, "p.*")
    ranks = counted(pairs, own, "value")
    sizes = pairs.where("value is not null").groupBy(*own).agg(F.count(F.lit(1)).alias("all"))
    at = (F.col("all") - 1) * F.lit(0.95)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    ends = ranks.join(sizes, own).where(holds(low) | holds(high)).groupBy(*own).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max(at - low).alias("share"))
    return ends.select(*own, (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("v"))


def calibration(df: DataFrame) -> DataFrame:
    """One row with the six percentiles of the metric rows. A missing connectedness counts as 0 here."""
    columns = {"branch": F.col("max_func_branch"), "nesting": F.col("nesting_depth"), "loc": implementation_loc(), "external_passthrough": passthrough(), "alpha": F.col("alpha_struct"), "one_minus_connectedness": 1 - F.coalesce(F.col("connectedness"), F.lit(0.0))}
    return exact_p95(df, columns)


def implementation_loc() -> Column:
    return F.greatest(F.lit(0), F.col("loc") - F.coalesce(F.col("declaration_loc"), F.lit(0)))


def passthrough() -> Column:
    return F.coalesce(F.col("external_passthrough_calls"), F.col("passthrough_calls"), F.lit(0))


def _part(value: Column, percentile: Column, weight: float) -> Column:
    return F.when(percentile > 0, weight * F.least(F.lit(1.0), value / percentile)).otherwise(0.0)


def burden(df: DataFrame, percentiles: DataFrame, weights: Mapping[str, float] = BURDEN_WEIGHTS) -> DataFrame:
    """df with the burden's parts, local_burden (the first four), composite, exposure and module_shape. percentiles is one row.

    A missing connectedness counts as 1 here.
    """
    disconnected = 1 - F.coalesce(F.col("connectedness"), F.lit(1.0))
    parts = {
        "part_branch": _part(F.coalesce(F.col("max_func_branch"), F.lit(0.0)), F.col("p95_branch"), weights["branch"]),
        "part_nesting": _part(F.col("nesting_depth"), F.col("p95_nesting"), weights["nesting"]),
        "part_loc": _part(implementation_loc(), F.col("p95_loc"), weights["loc"]),
        "part_passthrough": _part(passthrough(), F.col("p95_external_passthrough"), weights["passthrough"]),
        "part_alpha": _part(F.col("alpha_struct"), F.col("p95_alpha"), weights["alpha"]),
        "part_disconnected": _part(disconnected, F.col("p95_one_minus_connectedness"), weights["disconnected"]),
    }
    out = df.crossJoin(F.broadcast(percentiles)).withColumns(parts)
    local = F.col("part_branch") + F.col("part_nesting") + F.col("part_loc") + F.col("part_passthrough")
    return out.withColumns({"local_burden": local, "composite": local + F.col("part_alpha") + F.col("part_disconnected"), "exposure": F.col("alpha_struct"), "module_shape": disconnected}).drop(*percentiles.columns)


def confidence(passes: Column, flows: Column, nodes: Column) -> Column:
    return F.when(nodes <= 0, 0.2).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), (passes + 0.3 * flows) / nodes)))


def alpha(reach: Column, trust: Column, n_files: Column) -> Column:
    """The structural weight of a file, from what depends on it."""
    bottom = F.log2(n_files + 1.0)
    return F.when(bottom <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log2(reach * trust + 1) / bottom)))


def change_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CHANGE_WEIGHTS.items() for x in pair)), kind).cast("double")


def magnitude(kind: Column, branch_delta: Column) -> Column:
    return F.when(kind == "branch_add", F.greatest(F.lit(0.0), F.coalesce(branch_delta, F.lit(1.0)))).otherwise(1.0)


def push_impact(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """i_push, severity budget and their ratio over rows of changes (change_kind, weighted_branch_delta, alpha_struct, in_degree, layer_weight)."""
    severity = change_weight(F.col("change_kind")) * magnitude(F.col("change_kind"), F.col("weighted_branch_delta"))
    impact = severity * F.col("alpha_struct") * F.log2(F.col("in_degree") + 1.0) * F.coalesce(F.col("layer_weight"), F.lit(1.0))
    out = df.groupBy(*(by or [])).agg(F.coalesce(F.sum(impact), F.lit(0.0)).alias("i_push"), F.coalesce(F.sum(severity), F.lit(0.0)).alias("severity_budget"))
    return out.withColumn("intensity", F.when(F.col("severity_budget") > 0, F.col("i_push") / F.col("severity_budget")).otherwise(0.0))


def change_surface(anchors: DataFrame, consumers: DataFrame) -> DataFrame:
    """For each anchor (anchor, kind) its distinct consumers (anchor, file, layer_weight) and impact; an anchor without consumers has 0."""
    seen = consumers.groupBy("anchor").agg(F.countDistinct("file").alias("n"), F.max("layer_weight").alias("w"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return anchors.join(seen, "anchor", "left").select("anchor", "kind", n.cast("long").alias("consumers"), F.when(n == 0, 0.0).otherwise(change_weight(F.col("kind")) * F.log2(n + 1.0) * F.coalesce(F.col("w"), F.lit(1.0))).alias("impact"))


def file_count_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 9, "4-9").when(n <= 19, "10-19").otherwise("20+")


def impact_scale(samples: DataFrame, facts: DataFrame) -> DataFrame:
    """For each sample (sample_id, i_push, file_count), the weighted share, in percent with one decimal, of facts (i_push, file_count, weight) of its bucket below it; null without facts. A negative weight counts as 0.

    Facts are summed by bucket and value first; the weight below each value comes from sums over ranges of values.
    """
    f = facts.select(file_count_bucket(F.col("file_count")).alias("bucket"), F.col("i_push").alias("v"), F.greatest(F.lit(0.0), F.col("weight")).alias("w"))
    s = samples.select("sample_id", file_count_bucket(F.col("file_count")).alias("bucket"), F.col("i_push").alias("v"))
    totals = f.groupBy("bucket").agg(F.sum("w").alias("total"))
    both = f.groupBy("bucket", "v").agg(F.sum("w").alias("w")).unionByName(s.select("bucket", "v", F.lit(0.0).alias("w"))).groupBy("bucket", "v").agg(F.sum("w").alias("w"))
    below = prefix_sums(both, ["bucket"], ["v"], "w")
    out = s.join(below.drop("w"), ["bucket", "v"]).join(totals, "bucket", "left")
    return out.select("sample_id", "bucket", F.when(F.col("total") > 0, F.round(F.col("below") / F.col("total") * 1000) / 10).alias("percentile"))


def diagnosis(df: DataFrame, percentiles: DataFrame, weights: Mapping[str, float] = BURDEN_WEIGHTS) -> DataFrame:
    """Deterioration and improvement between before_* and after_* metrics, uncapped and never netted; null where they can't be compared."""
    terms = []
    for name, column, percentile in (("branch", "branch", "p95_branch"), ("nesting", "nesting", "p95_nesting"), ("loc", "loc", "p95_loc"), ("passthrough", "passthrough", "p95_external_passthrough")):
        delta = F.col(f"after_{column}") - F.col(f"before_{column}")
        terms.append(F.when(F.col(percentile) > 0, weights[name] * delta / F.col(percentile)).otherwise(F.when(delta.isNotNull(), 0.0)))
    up, down = [F.greatest(F.lit(0.0), t) for t in terms], [F.greatest(F.lit(0.0), -t) for t in terms]
    known = terms[0].isNotNull()
    for t in terms[1:]:
        known = known & t.isNotNull()
    return df.crossJoin(F.broadcast(percentiles)).withColumns({
        "deterioration": F.when(known, up[0] + up[1] + up[2] + up[3]), "improvement": F.when(known, down[0] + down[1] + down[2] + down[3]), "exposure_delta": F.col("after_alpha") - F.col("before_alpha"),
    }).drop(*percentiles.columns)


def age_days(ts: Column, now: Column) -> Column:
    """Fractional days, in UTC; a time after now has age 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(float(DAY_MICROS)))


def decayed(history: DataFrame, now: Column, file: str = "file", ts: str = "ts", delta: str = "delta_i") -> DataFrame:
    """The decayed sum of each file's deltas."""
    return history.groupBy(file).agg(F.sum(F.col(delta) * F.exp(F.lit(-DECAY) * age_days(F.col(ts), now))).alias("crl"))


def retention_cutoff(now: Column, days: int) -> Column:
    return F.date_trunc("DAY", now.cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def compact(history: DataFrame, checkpoint: DataFrame | None, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(checkpoint, rest): records up to cutoff become one decayed row for each file, at cutoff; an earlier checkpoint is carried over to it.

    Replaying both gives what replaying all records gives. Rows that decay to 0 or to no number go.
    """
    old = history.where(F.col("ts") <= cutoff).select("file", "ts", "delta_i")
    if checkpoint is not None:
        old = old.unionByName(checkpoint.select("file", "ts", "delta_i"))
    made = decayed(old, cutoff).where((F.col("crl") != 0) & ~F.isnan("crl")).select("file", cutoff.alias("ts"), F.col("crl").alias("delta_i"))
    return made, history.where(F.col("ts") > cutoff)


def history_facts(history: DataFrame) -> DataFrame:
    """For each history entry its impact, number of changed files and weight."""
    return history.groupBy("entry_id").agg(F.sum("delta_i").alias("i_push"), F.count_if(F.col("delta_i") != 0).alias("file_count")).withColumn("weight", F.lit(1.0))


#: The columns that a gate reads.
GATE_COLUMNS = ("path", "language", "path_class", "kind", "loc", "declaration_loc", "branch_count", "weighted_branch_total", "top_level_branch", "max_func_branch", "nesting_depth", "function_count", "connectedness", "cohesion", "alpha_struct", "in_degree", "passthrough_calls", "external_passthrough_calls")


def gate_metrics(df: DataFrame) -> DataFrame:
    """The columns that a gate reads, those that df has; nothing else is scanned."""
    return df.select(*(c for c in GATE_COLUMNS if c in df.columns))


def weighted_branch_total(total: Column, count: Column) -> Column:
    return F.coalesce(total, count.cast("double"), F.lit(0.0))


def max_func_weighted_branch(branch: Column) -> Column:
    return F.coalesce(branch, F.lit(0.0))


def symbol_scope(df: DataFrame) -> DataFrame:
    """df with symbol_scope_impact and static_comparable_impact, null unless every precondition holds, and the reasons why not.

    df: file, change_kind, alpha_struct, layer_weight, references and static_consumers (arrays of files; the latter may be null), eligible,
    same_population, public_surface, declarations_coverage, references_coverage. A file isn't its own consumer.
    """
    usable = lambda c: F.coalesce((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) != F.lit(float("inf"))), F.lit(False))
    checks = (
        (usable("alpha_struct"), "alpha"), (usable("layer_weight"), "layer_weight"), (F.col("eligible"), "not_eligible"), (F.col("same_population"), "other_population"),
        (F.col("public_surface") != "unknown", "unknown_surface"), ((F.col("declarations_coverage") == "complete") & (F.col("references_coverage") == "complete"), "incomplete"),
    )
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for holds, reason in checks)))
    others = lambda c: F.size(F.array_distinct(F.expr(f"filter({c}, x -> x != file)")))
    impact = lambda n: change_weight(F.col("change_kind")) * F.col("alpha_struct") * F.log2(n + 1.0) * F.col("layer_weight")
    out = df.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    return out.withColumns({"symbol_scope_impact": F.when(ok, impact(others("references"))), "static_comparable_impact": F.when(ok & F.col("static_consumers").isNotNull(), impact(others("static_consumers")))})


def sorted_deltas(deltas: DataFrame) -> DataFrame:
    """(file, delta_i) without zeros and what is no number, by file."""
    d = F.col("delta_i")
    return deltas.where(d.isNotNull() & (d != 0) & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))).orderBy("file")


def file_impact(changes: DataFrame, files: DataFrame) -> DataFrame:
    """i_push, severity_budget and intensity of each changed file: changes (path, change_kind, weighted_branch_delta), files (path, kind, alpha_struct, in_degree, layer_weight). Files that aren't production have none, and neither has an unknown file."""
    production = F.coalesce("kind", F.lit("production")) == "production"
    own = files.where(production).select("path", "alpha_struct", "in_degree", "layer_weight")
    found = push_impact(changes.join(own, "path"), ["path"])
    return changes.select("path").distinct().join(found, "path", "left").select("path", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("i_push", "severity_budget", "intensity")))

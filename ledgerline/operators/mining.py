"""Co-change mining: closed sets of files that change together, coordinators, the Pareto front, budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerline.shipping import ship
from ledgerline.sources.tables import cut_lineage, prefix_sums, release

MAX_SETS, MAX_INTERSECTIONS = 10_000, 200_000


def change_sets(changes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, files): the known files (path) of each commit (id, path, kind), sorted; commits of fewer than two, or of additions alone, go."""
    own = changes.join(known.select("path"), "path", "left_semi").select("id", "path", "kind").distinct()
    grouped = own.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("files"), F.bool_and(F.col("kind") == "added").alias("added"))
    return grouped.where((F.size("files") >= 2) & ~F.col("added")).select("id", "files")


def closed_sets(sets: DataFrame, minimum_size: int = 3, minimum_support: int = 3, max_sets: int = MAX_SETS, max_intersections: int = MAX_INTERSECTIONS) -> tuple[str, DataFrame]:
    """("available", closed sets with their support), or ("unavailable", none of them) beyond the budget.

    The sets are closed under intersection to a fixpoint: each round meets the sets found last with all change sets.
    The budget is the feature's: it bounds both sides of the join, and the rounds stop when it is used up. A set
    is closed if it is the intersection of all change sets that contain it. Result: files, occurrences, average_batch, ids.
    """
    sets = cut_lineage(sets.select("id", F.array_sort("files").alias("files")), "change-sets")
    n_sets = sets.count()
    base = sets.select(F.col("files").alias("own"))
    found = cut_lineage(sets.select("files").distinct(), "itemsets")
    fresh, operations = found, 0
    empty = found.where("false").select("files", F.lit(0).cast("long").alias("occurrences"), F.lit(0.0).alias("average_batch"), F.array().cast("array<string>").alias("ids"))
    while True:
        n = fresh.count()
        operations += n * n_sets
        if operations > max_intersections or found.count() >= max_sets:
            return "unavailable", empty
        if not n:
            break
        # within the budget this side has at most max_intersections / n_sets rows
        met = fresh.join(base, F.arrays_overlap("files", "own")).select(F.array_sort(F.array_intersect("files", "own")).alias("files")).where(F.size("files") >= minimum_size).distinct()
        fresh = cut_lineage(met.join(found, "files", "left_anti"), "itemsets")
        found = cut_lineage(found.unionByName(fresh), "itemsets")
    large = found.where(F.size("files") >= minimum_size)
    held = large.join(sets.select("id", F.col("files").alias("own")), F.size(F.array_except("files", "own")) == 0)
    grouped = held.groupBy("files").agg(F.count(F.lit(1)).alias("occurrences"), F.avg(F.size("own")).alias("average_batch"), F.array_sort(F.collect_list("id")).alias("ids"), F.collect_list("own").alias("all"))
    closure = F.size(F.reduce(F.col("all"), F.get("all", 0), lambda a, x: F.array_intersect(a, x)))
    return "available", grouped.where((F.col("occurrences") >= minimum_support) & (closure == F.size("files"))).drop("all")


def member_coverage(closed: DataFrame, sets: DataFrame) -> DataFrame:
    """closed with minimum_coverage: the least share, over its files, of a file's change sets that hold the whole set."""
    counts = sets.select(F.explode("files").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    least = closed.select("files", "occurrences", F.explode("files").alias("file")).join(counts, "file").groupBy("files").agg(F.min(F.col("occurrences") / F.col("n")).alias("minimum_coverage"))
    return closed.join(least, "files")


#: Fronts that meet in one task of a round.
FRONTS = 8


def pareto_front(df: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Rows that no other row is as good as on all criteria (larger is better) and better than on one. A missing criterion counts as the least.

    Each task keeps the front of its own points; fronts then meet by eights, in a tree of a few rounds that each drop what another front dominates. Equal points count once on the way.
    """
    ship(df.sparkSession)
    names = [f"_c{i}" for i in range(len(criteria))]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in criteria]
    points = df.select(*(v.alias(n) for v, n in zip(values, names, strict=True))).distinct()
    schema = StructType([*points.schema.fields, StructField("_part", LongType())])
    front = cut_lineage(points.withColumn("_part", F.spark_partition_id().cast("long")).mapInPandas(_local_front, schema), "front")
    while front.where("_part > 0").limit(1).count():
        groups = front.agg(F.max("_part")).first()[0] // FRONTS + 1
        met = front.withColumn("_part", F.floor(F.col("_part") / FRONTS)).repartitionByRange(groups, "_part").sortWithinPartitions("_part")
        new = cut_lineage(met.mapInPandas(_local_front, schema), "front")
        release(front)
        front = new
    matched = F.lit(True)
    for v, n in zip(values, names, strict=True):
        matched = matched & (v == F.col(n))
    return df.join(front.drop("_part"), matched, "left_semi")


def front_of(points: np.ndarray) -> np.ndarray:
    """The points that none dominates, of different ones. By falling sum, so that what dominates a point stands before it; a block at a time."""
    width = points.shape[1]
    sums = (np.where(np.isneginf(points), -1e300, points) / width).sum(1)
    own = points[np.lexsort((*points.T[::-1], sums))[::-1]]
    kept = np.empty((0, width))
    for i in range(0, len(own), 256):
        block = own[i : i + 256]
        for k in range(0, len(kept), 4096):
            block = block[~(kept[None, k : k + 4096] >= block[:, None]).all(2).any(1)]
        before = np.tril((block[None] >= block[:, None]).all(2), -1)
        kept = np.concatenate((kept, block[~before.any(1)]))
    return kept


def _local_front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fronts of the parts (_part) that come one after the other."""
    part, kept, columns = None, None, None
    for batch in batches:
        columns = list(batch.columns[:-1])
        for own, rows in batch.groupby("_part", sort=False):
            if part is not None and own != part:
                yield pd.DataFrame(kept, columns=columns).assign(_part=part)
                kept = None
            points = rows[columns].to_numpy()
            part, kept = own, front_of(points if kept is None else np.concatenate((kept, points)))
    if part is not None:
        yield pd.DataFrame(kept, columns=columns).assign(_part=part)


def extensions(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, coordinator, extension): within a commit, a modified file that imports an added one."""
    modified = changes.where("kind = 'modified'").select("id", F.col("path").alias("coordinator")).distinct()
    added = changes.where("kind = 'added'").select("id", F.col("path").alias("extension")).distinct()
    edges = imports.select(F.col("src").alias("coordinator"), F.col("dst").alias("extension")).distinct()
    # over the import edges, so that a large commit's pairs are never all made
    return modified.join(edges, "coordinator").join(added, ["id", "extension"], "left_semi").select("id", "coordinator", "extension")


def coordinators(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """For each coordinator its members, commits and facts of the members, if there are two of both; best first."""
    own = relations.join(facts.select(F.col("path").alias("extension"), "loc", "in_degree", "alpha_struct"), "extension", "left")
    grouped = own.groupBy("coordinator").agg(F.countDistinct("extension").alias("members"), F.countDistinct("id").alias("commits"), F.count(F.lit(1)).alias("events"), F.avg("loc").alias("average_loc"), F.max("in_degree").alias("max_in_degree"), F.max("alpha_struct").alias("max_alpha"))
    return grouped.where("members >= 2 and commits >= 2 and average_loc > 0").orderBy(F.desc("members"), F.desc("commits"), F.desc("max_in_degree"), "coordinator")


def action_summary(changes: DataFrame, files: DataFrame) -> DataFrame:
    """One row: additions, modifications and deletions of the files, and commits with any."""
    own = changes.join(files.select("path"), "path", "left_semi")
    return own.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")), F.countDistinct("id").alias("commits"))


def round_robin(df: DataFrame, group: str, order: Sequence[Column], budget: int, per_group: int | None = None) -> DataFrame:
    """Rows in rounds over the groups, each group's best first, up to a budget."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if per_group is not None:
        ranked = ranked.where(F.col("turn") <= per_group)
    return ranked.orderBy("turn", group, *order).limit(budget)


def by_key_waves(df: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Rows in waves of one for each key, whole waves while the budget lasts; of the last one, keys spaced evenly."""
    ranked = df.withColumn("wave", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("wave") <= budget)
    waves = ranked.groupBy("wave").agg(F.count(F.lit(1)).alias("n"))  # budget rows at most
    before = waves.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < budget)
    own = cut_lineage(ranked.join(F.broadcast(before), "wave").withColumn("left", F.lit(budget) - F.col("before")), "waves")
    partial = prefix_sums(own.where("n > left").withColumn("one", F.lit(1)), ["wave"], [key], "one", "i")
    return own.where("n <= left").select(df.columns + ["wave"]).unionByName(partial.where(_holds_place("i", F.col("left"), F.col("n"))).select(df.columns + ["wave"]))


def _holds_place(i: str, budget: Column, n: Column) -> Column:
    """Whether the row at place i of n, from 0, holds one of `budget` evenly spaced places."""
    return F.ceil((F.col(i) + 1) * budget / n - 0.5) > F.ceil(F.col(i) * budget / n - 0.5)


def evenly_sampled(df: DataFrame, order: str, budget: int) -> DataFrame:
    """At most budget rows, spaced evenly in order."""
    n = df.count()
    if n <= budget:
        return df
    placed = prefix_sums(df.withColumn("_one", F.lit(1)), [], [order], "_one", "_i")
    return placed.where(_holds_place("_i", F.lit(budget), F.lit(n))).select(df.columns)


def commonest_kinds(events: DataFrame) -> DataFrame:
    """One row: the commonest set of change kinds (by count, then the key), and aligned if it is the only one, else mixed."""
    counts = events.groupBy("kinds").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("kinds", F.struct("n", F.col("kinds"))).alias("kinds"), F.when(F.count(F.lit(1)) == 1, "aligned").otherwise("mixed").alias("evidence"))


def intersect(left: Column, right: Column) -> Column:
    """What two sets of files have in common, in order."""
    return F.array_sort(F.array_intersect(left, right))


def contains_all(container: Column, subset: Column) -> Column:
    return F.size(F.array_except(subset, container)) == 0


def enrichment_plan(candidates: DataFrame, commits: DataFrame, most_candidates: int = 3, most_commits: int = 3, budget: int = 9) -> DataFrame:
    """(candidate, id): the commits to look into: of the first candidates (candidate, rank) the first commits (candidate, id, position) each, until the budget is used up. Sizes are the report's."""
    first = candidates.orderBy("rank").limit(most_candidates).select("candidate", "rank")
    own = commits.join(F.broadcast(first), "candidate").withColumn("_r", F.row_number().over(Window.partitionBy("candidate").orderBy("position"))).where(F.col("_r") <= most_commits)
    return own.orderBy("rank", "position").limit(budget).select("candidate", "id")


def corroborated(candidates: DataFrame) -> DataFrame:
    """Candidates (files, components, evidence) that imports tie together or whose history isn't mixed."""
    return candidates.where((F.col("components") < F.size("files")) | (F.coalesce("evidence", F.lit("")) != "mixed"))


def plain_imports(imports: Column, reexports: Column) -> Column:
    return F.array_except(imports, reexports)


def forwards_only(imports: Column, reexports: Column) -> Column:
    """Whether a file publicly forwards modules and imports nothing else."""
    return (F.size(F.coalesce(reexports, F.array().cast("array<string>"))) > 0) & (F.size(plain_imports(F.coalesce(imports, F.array().cast("array<string>")), reexports)) == 0)


def projected_changes(changes: DataFrame, extension_commits: DataFrame, forwarding: DataFrame, coordinator: str) -> DataFrame:
    """(id, files): of the commits in which the coordinator was extended (id), the modified files that do more than forward, where the coordinator is one."""
    own = changes.where("kind = 'modified'").join(extension_commits.select("id").distinct(), "id", "left_semi").join(forwarding.select("path"), "path", "left_anti")
    return own.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("files")).where(F.array_contains("files", coordinator))


def production_files(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, files, unknown): the distinct production files (path, kind) of each commit, and how many of its paths have no facts."""
    own = changes.select("id", "path").distinct().join(facts.select("path", F.coalesce("kind", F.lit("production")).alias("kind")), "path", "left")
    return own.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "production", F.col("path")))).alias("files"), F.count_if(F.col("kind").isNull()).alias("unknown"))


def extension_surfaces(changes: DataFrame, relations: DataFrame, forwarding: DataFrame, coordinators_: Sequence[str], least: int = 2) -> dict[str, tuple[str, DataFrame]]:
    """For each coordinator with several members the closed sets, of `least` files in `least` commits, of what was modified with it each time it was extended.

    relations: id, coordinator, extension. The number of coordinators is the report's.
    """
    out = {}
    for coordinator in coordinators_:
        own = relations.where(F.col("coordinator") == coordinator)
        if own.select("extension").distinct().limit(2).count() < 2:
            continue
        sets = projected_changes(changes, own, forwarding, coordinator)
        state, closed = closed_sets(sets, least, least)
        out[coordinator] = (state, closed.where(F.array_contains("files", coordinator)))
    return out

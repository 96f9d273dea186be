"""Dependency graphs as edge tables (src, dst); edges repeat where the graph has them more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.tables import cut_lineage, deal, hubs_of, release


def dependency_edges(imports: DataFrame, nodes: DataFrame, implicit: DataFrame | None = None) -> DataFrame:
    """Explicit imports (src, dst) of known nodes (node), repeats kept, and implicit edges between known nodes that aren't there yet, once each."""
    known = nodes.select(F.col("node").alias("dst"))
    explicit = imports.where(F.col("dst").isNotNull()).join(known, "dst", "left_semi").select("src", "dst")
    if implicit is None:
        return explicit
    own = implicit.select("src", "dst").join(known, "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").distinct()
    return explicit.unionByName(own.join(explicit.distinct(), ["src", "dst"], "left_anti"))


def in_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with the number of edges into it, repeats counted."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def reverse(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges turned around, without those whose target is no node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """For each start (node), the number of nodes within depth steps, itself included.

    A breadth-first search of all starts at once: each round joins the frontier to the edges and keeps pairs not
    seen before. Cycles end by themselves. Each round's frontier is written to the shared folder once; what was seen is all of them.
    """
    steps = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    seen = frontier = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct()
    for _ in range(depth):
        found = frontier.join(steps, frontier["at"] == steps["src"]).select("start", F.col("dst").alias("at")).distinct()
        frontier = cut_lineage(found.join(seen, ["start", "at"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("reach"))


def reach_depth(n_files: int) -> int:
    """Large projects are searched less deeply."""
    return 3 if n_files > 5000 else 5


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is connected with, edges taken both ways.

    In each round a node takes the least label among its own and its neighbours', and then that label's own label, until none changes: what labels pass on
    doubles its way. A hub's edges are dealt to several tasks, once for all rounds; nodes that share a label are the outer side of a left join, which adaptive execution splits. What the round before wrote is deleted.
    """
    own = edges.select("src", "dst").where("src != dst")
    both = cut_lineage(own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    hubs = hubs_of(both, "src")
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        offered = deal(both, labels.select(F.col("node").alias("src"), "component"), "src", hubs).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("offer"))
        taken = labels.join(offered, "node", "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("next"), "component")
        hop = taken.select(F.col("node").alias("next"), F.col("next").alias("hop"))
        new = cut_lineage(taken.join(hop, "next", "left").select("node", F.least("next", F.coalesce("hop", "next")).alias("next"), "component"), "labels")
        release(labels)
        labels = new.select("node", F.col("next").alias("component"))
        labels._ledgerline_path = new._ledgerline_path
        if new.where("next != component").isEmpty():
            release(both)
            return labels


#: A group of more nodes is not put into one row.
GROUP_NODES = 64


def parts_of(nodes: str, ties: Column) -> Column:
    """The parts (arrays) in which ties (src, dst) between its elements leave a column of few nodes: each tie joins the two parts that it touches."""
    holds = lambda x, e: F.coalesce(F.array_contains(x, e["src"]) | F.array_contains(x, e["dst"]), F.lit(False))
    joined = lambda parts, e: F.concat(F.filter(parts, lambda x: ~holds(x, e)), F.array(F.flatten(F.filter(parts, lambda x: holds(x, e)))))
    return F.aggregate(ties, F.transform(nodes, lambda n: F.array(n)), joined)


def component_share(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """For each file the share of its functions in the largest group connected by calls; 1 for one function or none.

    functions: file, name (a repeated name is one node but counts as often as it occurs); calls: file, caller, callee. A file of at most GROUP_NODES names is joined up in its row, a larger one by rounds.
    """
    files = cut_lineage(functions.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.sum("n").alias("functions"), F.collect_list("name").alias("names")).where("file is not null"), "files")
    small, large = files.where(F.size("names") <= GROUP_NODES), files.where(F.size("names") > GROUP_NODES)
    within = calls.where("caller != callee").join(small.select("file", "names").hint("merge"), "file").where(F.array_contains("names", F.col("caller")) & F.array_contains("names", F.col("callee")))
    ties = within.groupBy("file").agg(F.collect_set(F.struct(F.least("caller", "callee").alias("src"), F.greatest("caller", "callee").alias("dst"))).alias("ties"))
    most = F.array_max(F.transform(parts_of("names", F.col("ties")), lambda x: F.size(x)))
    sizes = small.join(ties.hint("merge"), "file", "left").select("file", "functions", F.when(F.col("ties").isNull(), 1).otherwise(most).cast("long").alias("largest"))
    if not large.isEmpty():
        nodes = large.select(F.explode(F.transform("names", lambda n: F.struct("file", n.alias("name")))).alias("node"))
        edges = calls.select(F.struct("file", F.col("caller").alias("name")).alias("src"), F.struct("file", F.col("callee").alias("name")).alias("dst"))
        edges = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found = components(edges, nodes).groupBy("node.file", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.max("n").alias("largest"))
        sizes = sizes.unionByName(large.select("file", "functions").join(found, "file"))
    return sizes.select("file", "functions", F.when(F.col("functions") <= 1, 1.0).otherwise(F.col("largest") / F.col("functions")).alias("connectedness"))


def dirty_files(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files to be read again: the changed ones, and those that import a changed or deleted one. changes: path, status."""
    touched = changes.where(F.col("status").isin("changed", "deleted")).select(F.col("path").alias("dst"))
    importers = edges.join(touched, "dst", "left_semi").select(F.col("src").alias("path"))
    return changes.where("status = 'changed'").select("path").unionByName(importers).distinct().join(changes.where("status = 'deleted'").select("path"), "path", "left_anti")


def cyclic(dependencies: DataFrame) -> DataFrame:
    """The nodes on or behind a cycle of dependencies (task, depends_on): what is left when tasks without open dependencies are taken away until none is. Unknown tasks hold nothing up.

    A task with one open dependency has that one's fate, so whole chains of such tasks are skipped at once, by pointers that double; a chain that never ends is a
    cycle. Then a level of tasks goes. There are as many rounds as the longest path has tasks with several dependencies that end at different times.
    """
    tasks = dependencies.select("task").distinct()
    left = dependencies.where(F.col("depends_on").isNotNull()).join(tasks.withColumnRenamed("task", "depends_on"), "depends_on", "left_semi").select("task", "depends_on").distinct()
    left = cut_lineage(left, "open")
    fates = []  # of each round: tasks whose fate is another's
    while not left.isEmpty():
        single = left.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("depends_on").alias("to")).where("n = 1").select("task", "to")
        pointers = cut_lineage(single, "pointers")
        going = pointers.count()  # pointers that lead to another
        while True:
            on = pointers.select(F.col("task").alias("to"), F.col("to").alias("far"))
            new = cut_lineage(pointers.join(on, "to", "left").select("task", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "pointers")
            release(pointers)
            pointers = new
            before, going = going, new.where("moved").count()
            # ends are found at distances that double, and before a far task stand all nearer ones: where a round finds no end, no more will come
            if going in (0, before):
                break
        # what still points at a task with one dependency never ends: it keeps itself open, as what leads to it does
        ended = pointers.join(pointers.select(F.col("task").alias("to")), "to", "left_anti").where("task != to").select("task", "to")
        ended = cut_lineage(ended, "fates")
        fates.append(ended)
        kept = left.join(ended.select("task"), "task", "left_anti")
        far = kept.join(ended.select(F.col("task").alias("depends_on"), "to"), "depends_on", "left").select("task", F.coalesce("to", "depends_on").alias("depends_on")).distinct()
        far = cut_lineage(far, "open")
        open_ = far.join(far.select(F.col("task").alias("depends_on")).distinct(), "depends_on", "left_semi").select("task", "depends_on")
        new = cut_lineage(open_, "open")
        same = new.count() == far.count() and ended.isEmpty()
        release(left, far, pointers)
        left = new
        if same:
            break
    out = left.select("task").distinct()
    for ended in reversed(fates):
        out = cut_lineage(out.unionByName(ended.join(out.select(F.col("task").alias("to")), "to", "left_semi").select("task")).distinct(), "cyclic")
    return out


def group_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """For each group (id, files) the number of parts that edges among its own files leave it in.

    A group of at most GROUP_NODES files goes to each of its files' edges as a whole and is joined up in its row; a larger one's files are rows, and its parts are found by rounds.
    """
    files = groups.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("files"))).alias("files")).where(F.size("files") > 0)
    files = cut_lineage(files, "groups")
    small, large = files.where(F.size("files") <= GROUP_NODES), files.where(F.size("files") > GROUP_NODES)
    own = edges.where("src is not null and dst is not null and src != dst").select("src", "dst").distinct()
    # pairs within small groups: a file's edges that lead into its group
    met = small.select("id", "files", F.explode("files").alias("src")).join(own.hint("merge"), "src").where(F.array_contains("files", F.col("dst"))).select("id", F.struct("src", "dst").alias("e"))
    tied = met.groupBy("id").agg(F.collect_list("e").alias("ties"))
    one = small.join(tied.hint("merge"), "id", "left").select("id", F.when(F.col("ties").isNull(), F.size("files")).otherwise(F.size(parts_of("files", F.col("ties")))).cast("long").alias("components"))
    if large.isEmpty():
        return one
    members = large.select("id", F.explode("files").alias("file"))
    inside = members.join(edges.select(F.col("src").alias("file"), "dst").distinct(), "file").withColumnRenamed("file", "src")
    inside = inside.join(members.withColumnRenamed("file", "dst"), ["id", "dst"], "left_semi")
    node = lambda c: F.struct("id", F.col(c).alias("file"))
    labels = components(inside.select(node("src").alias("src"), node("dst").alias("dst")), members.select(node("file").alias("node")))
    return one.unionByName(labels.groupBy("node.id").agg(F.countDistinct("component").alias("components")))


def call_sites(functions: DataFrame) -> DataFrame:
    """For each file and callee the number of calls: functions (file, name, calls: callees once each, call_counts: by callee); a missing count is 1."""
    called = functions.select("file", F.explode(F.array_distinct("calls")).alias("callee"), "call_counts")
    return called.groupBy("file", "callee").agg(F.sum(F.coalesce(F.try_element_at("call_counts", F.col("callee")), F.lit(1))).cast("long").alias("sites"))


def cohesion(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """For each file the share of its pairs of functions that a call ties, 1 at most, and 1 for one function. functions: file, name; calls: file, caller, callee."""
    known = functions.select("file", F.col("name").alias("n")).distinct()
    inside = calls.join(known.withColumnRenamed("n", "caller"), ["file", "caller"], "left_semi").join(known.withColumnRenamed("n", "callee"), ["file", "callee"], "left_semi").where("caller != callee")
    ties = inside.select("file", F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).distinct().groupBy("file").agg(F.count(F.lit(1)).alias("ties"))
    n = F.col("functions")
    counts = functions.groupBy("file").agg(F.count(F.lit(1)).alias("functions"))
    return counts.join(ties, "file", "left").select("file", "functions", F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("ties", F.lit(0)) / (n * (n - 1) / 2))).alias("cohesion"))


def internal_call_shape(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """For each file: connectedness, cohesion, functions called from within, those called from one place alone, and their share (null if none is called).

    functions: file, name; calls: file, caller, callee, sites. A file of one function has (1, 1, 0, 0, null).
    """
    known = functions.select("file", F.col("name").alias("n")).distinct()
    inside = calls.join(known.withColumnRenamed("n", "callee"), ["file", "callee"], "left_semi").groupBy("file", "callee").agg(F.sum("sites").alias("sites"))
    called = inside.groupBy("file").agg(F.count(F.lit(1)).alias("called"), F.count_if(F.col("sites") == 1).alias("single"))
    shape = component_share(functions, calls).join(cohesion(functions, calls).select("file", "cohesion"), "file").join(called, "file", "left")
    several = F.col("functions") > 1
    n, one = F.when(several, F.coalesce("called", F.lit(0))).otherwise(0), F.when(several, F.coalesce("single", F.lit(0))).otherwise(0)
    return shape.select("file", "connectedness", "cohesion", n.cast("long").alias("called"), one.cast("long").alias("single_call_site"), F.when(n > 0, one / n).alias("single_call_ratio"))


def replace_adjacency(edges: DataFrame, changed: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with those from changed files (path) replaced by the ones found in them now."""
    own = changed.select(F.col("path").alias("src")).distinct()
    return edges.join(own, "src", "left_anti").select("src", "dst").unionByName(found.join(own, "src", "left_semi").select("src", "dst"))


def may_have_consumers(profiles: DataFrame, metrics: DataFrame, several: bool, implicit: bool) -> DataFrame:
    """Profiles (path) that something may depend on: all but those known to have no importer, in a change of one file without implicit edges; a Go file counts unless it is alone in its folder.

    metrics: path, kind, in_degree.
    """
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    own = profiles.join(metrics.select("path", "in_degree"), "path", "left")
    if several or implicit:
        return own.select(profiles.columns)
    go = metrics.where("kind = 'production'").where(F.col("path").endswith(".go")).groupBy(folder(F.col("path")).alias("_folder")).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("in_degree").isNull() | (F.col("in_degree") > 0) | (F.col("path").endswith(".go") & (F.coalesce("_n", F.lit(0)) > 1))
    return own.withColumn("_folder", folder(F.col("path"))).join(go, "_folder", "left").where(keep).select(profiles.columns)

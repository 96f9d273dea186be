"""Graphs, fronts, joins and folds of shapes that their plain forms would not survive."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import graphs, joins, mining, scores, testing
from ledgerline.sources import tables
from ledgerline.streaming import lifecycle


def brute_cyclic(edges):
    left = {(a, b) for a, b in edges if b in {x for x, _ in edges}}
    while True:
        open_ = {a for a, _ in left}
        new = {(a, b) for a, b in left if b in open_}
        if new == left:
            return {a for a, _ in left}
        left = new


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(400)] + [(400, None)], [(i, (i + 1) % 50) for i in range(50)] + [(100 + i, 99 + i) for i in range(1, 60)] + [(100, 3)], [(1, 1)], [(1, 2), (2, None)], [], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7), (6, 99), (7, None)],
    [(a, b) for i in range(6) for a in (2 * i, 2 * i + 1) for b in (2 * i + 2, 2 * i + 3)] + [(12, None), (13, None)],
])
def test_cycles(spark, edges):
    found = graphs.cyclic(spark.createDataFrame(edges, "task long, depends_on long"))
    assert {r.task for r in found.collect()} == brute_cyclic(edges)


def test_cycles_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((20, 18), (60, 70), (40, 120)):
        edges = [(rng.randrange(n), rng.choice([rng.randrange(n), rng.randrange(n), None])) for _ in range(m)]
        assert {r.task for r in graphs.cyclic(spark.createDataFrame(edges, "task long, depends_on long")).collect()} == brute_cyclic(edges)


def test_components_of_chains_hubs_and_lone_nodes(spark, monkeypatch):
    monkeypatch.setattr(tables, "HUB_ROWS", 4)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"x{i}") for i in range(60)] + [("a", "a"), ("p", "q"), ("q", "p")]
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert found == {n: "c000" if n[0] == "c" else "hub" if n == "hub" or n[0] == "x" else "p" if n in "pq" else n for n in nodes}


def test_joins_by_one_row_deal_hubs(spark, monkeypatch):
    monkeypatch.setattr(tables, "HUB_ROWS", 10)
    rows = tables.cut_lineage(spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), "id"), "rows")
    one = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert sorted(map(str, tables.deal(rows, one, "k", tables.hubs_of(rows, "k"), how).select("k", "id", "v").collect())) == sorted(map(str, rows.join(one, "k", how).select("k", "id", "v").collect()))


@pytest.mark.parametrize("width, n", [(1, 50), (2, 400), (4, 700)])
def test_fronts(spark, monkeypatch, width, n):
    monkeypatch.setattr(mining, "FRONTS", 2)
    rng = np.random.default_rng(width)
    points = [tuple(None if x < 0 else float(x) for x in rng.integers(-1, 9, width)) for _ in range(n)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, " + ", ".join(f"c{k} double" for k in range(width))).repartition(9)
    value = lambda x: float("-inf") if x is None else x
    at_least = lambda a, b: all(value(x) >= value(y) for x, y in zip(a, b, strict=True))
    expected = {i for i, p in enumerate(points) if not any(at_least(q, p) and not at_least(p, q) for q in points)}
    assert {r.id for r in mining.pareto_front(df, [f"c{k}" for k in range(width)]).collect()} == expected


def test_first_existing(spark):
    files = ["a/m.ts", "a/m.d.ts", "a/n/index.tsx", "a/o.js", "a/p/__init__.py", "x.y/z.tsx", "a/mod.rs"]
    imports = [("i", "m", ["a/m.ts", "a/m.tsx", "a/m.d.ts"]), ("i", "d", ["a/m.tsx", "a/m.d.ts", "a/m.ts"]), ("i", "n", ["a/n.ts", "a/n/index.ts", "a/n/index.tsx"]), ("i", "o", ["a/o.ts", "a/o.js"]), ("i", "p", ["a/p.py", "a/p/__init__.py"]), ("i", "z", ["x.y/z.ts", "x.y/z.tsx"]), ("i", "gone", ["a/g.ts"]), ("i", "out", []), ("i", "out", None), ("j", "mod", ["b.rs", "a/mod.rs"])]
    found = {(r.importer, r.source): r.resolved for r in joins.first_existing(spark.createDataFrame(imports, "importer string, source string, candidates array<string>"), spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert found == {(i, s): next((c for c in cs or [] if c in files), None) for i, s, cs in imports}


def test_percentiles_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(rng.integers(0, 40)) if i % 5 else None, None) for i in range(101)] + [("c", None, 1.0)]
    found = {(r.k, r.metric): r.v for r in scores.exact_p95_by(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], {"x": F.col("x"), "y": F.col("y")}).collect()}
    assert found == pytest.approx({("a", "x"): np.percentile([x for k, x, _ in rows if k == "a" and x is not None], 95), ("b", "x"): np.percentile([x for k, x, _ in rows if k == "b" and x is not None], 95), ("c", "y"): 1.0})
    facts = spark.createDataFrame([("p", "f", 1, 2, 3, None, None), (None, "g", 2, 4, None, 1, 1.0)], "provider string, file string, cases int, loc int, assertions int, mocks int, control_flow double")
    assert {tuple(r) for r in testing.summarize(facts).collect()} == {("p", 1, 1, 2.0, 3.0, 0.0, None), (None, 1, 2, 4.0, 0.0, 1.0, 1.0)}


def test_leases_of_targets_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(t, f"{t}{i}", "acquire", f"o{i % 2}", 0, i * 10, 25) for t in "ab" for i in range(12)]
        found = {r.request_id: (r.answer, r.token) for r in lifecycle.lease_answers(spark.createDataFrame(rows, "target string, request_id string, action string, owner string, token long, now long, ttl long"), "request_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {f"{t}{i}": ("acquired" if i % 3 == 0 else "held", i // 3 + 1) for t in "ab" for i in range(12)}

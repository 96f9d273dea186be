"""Groups that are joined up in their rows give what rounds over all of them give; lists that many share are made once."""

import random

from pyspark.sql import functions as F

from ledgerline.functions import fingerprints as fp
from ledgerline.operators import graphs, joins
from ledgerline.sources import tables


def test_parts_of_small_and_large_groups(spark, monkeypatch):
    rng = random.Random(3)
    groups = [(g, rng.sample(range(40), n)) for g, n in enumerate((1, 2, 5, 9, 20, 33))] + [(9, [])]
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    files, ties = spark.createDataFrame(groups, "id int, files array<int>"), spark.createDataFrame(edges, "src int, dst int")
    calls = 0
    rounds = graphs.components

    def counted(*args):
        nonlocal calls
        calls += 1
        return rounds(*args)

    monkeypatch.setattr(graphs, "components", counted)
    found = {}
    for most in (64, 6, 0):
        monkeypatch.setattr(graphs, "GROUP_NODES", most)
        found[most] = {r.id: r.components for r in graphs.group_components(files, ties).collect()}
        functions = files.select(F.col("id").alias("file"), F.explode("files").alias("name"))
        shares = graphs.component_share(functions, functions.select("file").distinct().crossJoin(ties.toDF("caller", "callee")))
        found[-most - 1] = {r.file: round(r.connectedness, 9) for r in shares.collect()}
        assert calls == {64: 0, 6: 2, 0: 4}[most]  # small ones alone need no rounds
    assert found[64] == found[6] == found[0] and set(found[64]) == set(range(6))
    assert found[-65] == found[-7] == found[-1]


def test_cycles_end_early(spark, monkeypatch):
    written = []
    write = tables.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df, label, **named: (written.append(label), write(df, label, **named))[1])
    n = 3000
    found = graphs.cyclic(spark.range(n).select(F.col("id").alias("task"), ((F.col("id") + 1) % n).alias("depends_on")))
    assert found.count() == n
    assert written.count("pointers") == 2  # none ends in the first round


def test_consumers_share_their_leaf_s_list(spark, monkeypatch):
    lists = []
    monkeypatch.setattr(joins, "deal", lambda rows, one, *rest: (lists.append(one), tables.deal(rows, one, *rest))[1])
    facts = spark.createDataFrame([(f"A.n{i % 3}", f"f{i}") for i in range(30)], "name string, file string")
    anchors = spark.createDataFrame([("one", "x.n1"), ("two", "y.n1"), ("both", "n0"), ("both", "z.n2"), ("gone", "n9"), ("twice", "n2"), ("twice", "q.n2")], "anchor string, symbol string")
    found = {r.anchor: r.files for r in joins.consumers_by_leaf(facts, anchors).collect()}
    leaf = lambda *k: sorted(f"f{i}" for i in range(30) if i % 3 in k)
    assert found == {"one": leaf(1), "two": leaf(1), "both": leaf(0, 2), "twice": leaf(2)}
    assert {r.leaf: r.files for r in lists[0].collect()} == {f"n{i}": leaf(i) for i in range(3)}  # a row for each leaf, not for each of its files


def test_code_features_take_their_lines_once(spark):
    lines = fp.code_features(F.col("c"))
    plan = spark.createDataFrame([("a",)], "c string").select(lines.alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(c") == 1
    assert spark.createDataFrame([("aaaaa\nbbbbb\nccccc\nddddd",), ("aaaaa\nb",), (None,)], "c string").select(lines.alias("f")).collect()[0].f == ["aaaaa\nbbbbb\nccccc", "bbbbb\nccccc\nddddd"]

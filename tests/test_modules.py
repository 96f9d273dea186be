"""Imports are made once, and go through no shuffle with their lists of candidates."""

from __future__ import annotations

from ledgerline.functions import modules
from ledgerline.operators import joins
from ledgerline.plans import catalog

IMPORTS = [("a", "x", ["p1", "p2"]), ("a", "y", ["p9"]), ("b", "x", []), ("b", "y", ["p2", "p9", "p1"]), ("c", "z", None)]


def test_fan_out_reads_imports_once(spark, tmp_path):
    spark.createDataFrame(IMPORTS, "importer string, source string, candidates array<string>").write.parquet(str(tmp_path / "imports"))
    files = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string")
    out = joins.fan_out(spark.read.parquet(str(tmp_path / "imports")).distinct(), files)
    expected = [("a", "x", "p1"), ("a", "x", "p2"), ("a", "y", None), ("b", "x", None), ("b", "y", "p1"), ("b", "y", "p2"), ("c", "z", None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1, plan


def test_first_existing_makes_candidates_after_the_join(spark):
    imports = spark.createDataFrame([("p/a.ts", s) for s in ("./b", "./c.js", "../x", "react", "../../up", "./none", "./d")] + [("a.ts", "./b")], "importer string, source string")
    files = spark.createDataFrame([("p/b.ts",), ("p/b/index.ts",), ("p/c.tsx",), ("p/c.js",), ("x.d.ts",), ("p/d/index.js",), ("b.jsx",)], "path string")
    out = joins.first_existing(modules.typescript_bases(imports), files, modules.typescript_candidates)
    expected = {("p/a.ts", "./b"): "p/b.ts", ("p/a.ts", "./c.js"): "p/c.tsx", ("p/a.ts", "../x"): "x.d.ts", ("p/a.ts", "react"): None, ("p/a.ts", "../../up"): None, ("p/a.ts", "./none"): None, ("p/a.ts", "./d"): "p/d/index.js", ("a.ts", "./b"): "b.jsx"}
    assert {(r.importer, r.source): r.resolved for r in out.collect()} == expected
    assert {(r.importer, r.source): r.resolved for r in joins.first_existing(modules.typescript(imports), files).collect()} == expected


def test_typescript_modules_join_by_shuffle_in_dealt_tasks(spark):
    plan = catalog.QUERIES["o47_typescript_modules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 3, plan

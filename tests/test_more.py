"""Brace-language facts, staged rules, configuration, change sets, ranks by ranges and the rest that queries don't reach."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import brace_facts, identities, modules
from ledgerline.operators import diffing, graphs, joins, mining, scores, similarity, staged, testing, validation
from ledgerline.sources import changes, config, tables
from ledgerline.streaming import lifecycle

TYPESCRIPT = """import { a } from "x"; import "y"; export * from './z'; const q = require('w');
// if (no) { }
export function f(a: number): string {
  if (a) { return "if"; }
  if (a > 1) { g(); } else if (a > 2) { h(a); } else { h(b); }
  switch (a) { case 1: g(); break; case 2: { if (z) q(); break; } default: k(); }
  return `x${a}`;
}
export const arrow = (x) => x ? g(x) : h(x);
class C { constructor(private a: string) { if (a) this.b(); } async m<T>(): Promise<void> { items.map(i => { if (i) throw 1; }); } }
if (top) run();
"""


def test_typescript_facts():
    f = brace_facts.brace_facts(TYPESCRIPT, "typescript")
    assert (f["branch_count"], f["weighted_branch_total"], f["top_level_branch"], f["nesting_depth"], f["function_count"]) == (11, 7.5, 1.0, 2, 5)
    by = {x["name"]: x for x in f["functions"]}
    assert by["f"]["branch"] == 5.2 and by["f"]["call_counts"] == {"g": 2, "h": 2, "q": 1, "k": 1} and by["arrow"]["calls"] == ["g", "h"] and by["m"]["calls"] == ["map"]
    assert by[""]["branch"] == 0.3 and by["constructor"]["branch"] == 1.0
    assert [(i["source"], i["reexport"]) for i in f["imports"]] == [("x", False), ("y", False), ("./z", True), ("w", False)] and f["exports"] == ["f", "arrow"]


def test_other_brace_languages():
    go = brace_facts.brace_facts('package m\nimport ("fmt"; x "a/b")\nfunc (r *T) M(a int) (int, error) { if err := f(a); err != nil { return 0, err }; switch a { case 1: g(); default: h() }; return 1, nil }\nfunc own(f func(int) bool) { select { case <-c: g() } }\n', "go")
    assert (go["weighted_branch_total"], [x["name"] for x in go["functions"]], [i["source"] for i in go["imports"]]) == (3.2, ["M", "own"], ["fmt", "a/b"])
    java = brace_facts.brace_facts("import a.B; class A { A(int x) { if (x > 1) { throw new E(); } } <T> int m() { Object o = new Object() { void z() { if (y) g(); } }; return 0; } }", "java")
    assert {x["name"]: x["branch"] for x in java["functions"]} == {"A": 0.3, "m": 0.0, "z": 1.0}
    rust = brace_facts.brace_facts("use std::{fmt, io::Write}; pub use crate::a::B as C;\npub fn f<'a>(x: &'a str) { match x { \"a\" => 1, _ => { if x { return; } } } }\ntrait T { fn d(&self); fn e(&self) { h!() } }", "rust")
    assert ([i["source"] for i in rust["imports"]], rust["imports"][2]["reexport"], rust["weighted_branch_total"], rust["nesting_depth"], [x["name"] for x in rust["functions"]]) == (["std::fmt", "std::io::Write", "crate::a::B"], True, 1.9, 2, ["f", "e"])


def test_broken_sources_give_what_was_read():
    random.seed(1)
    for language in brace_facts.SWITCHES:
        for _ in range(200):
            cut = random.randrange(len(TYPESCRIPT))
            text = "".join(random.sample(TYPESCRIPT, 60)) if cut % 2 else TYPESCRIPT[:cut]
            assert brace_facts.brace_facts(text, language)["branch_count"] >= 0
    assert brace_facts.brace_facts("", "go")["loc"] == 0


def test_files_of_several_languages(spark):
    rows = [("a.ts", "typescript", "if (x) { y(); }"), ("b.vue", "vue", "<template>\n<p v-if=x>\n</template>\n<script lang=\"ts\">\nfunction f() { if (x) return; }\n</script>"), ("c.css", "css", "a { }"), ("d.go", "go", None)]
    found = {r.path: r for r in brace_facts.file_facts(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert found["a.ts"].branch_count == 1 and found["b.vue"].functions[0].line == 5 and found["b.vue"].max_func_branch == pytest.approx(0.3)
    assert found["c.css"].branch_count is None and found["d.go"].branch_count == 0 and brace_facts.vue_script("<p>") == ""


def test_module_candidates(spark):
    df = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "../../c"), ("a/b.ts", "../c.js")], "importer string, source string")
    out = {r.source: r.candidates for r in modules.typescript(df).collect()}
    assert out["./c"][:2] == ["a/c", "a/c.ts"] and out["../../c"] == [] and out["../c.js"][:2] == ["c.ts", "c.tsx"]
    rust = spark.createDataFrame([("src/a/b.rs", "super::super::x::Y"), ("src/a/b.rs", "super::super::super::super::x"), ("src/a/b.rs", "crate")], "importer string, source string")
    out = {r.source: r.candidates for r in modules.rust(rust).collect()}
    assert out["super::super::x::Y"][0] == "x/Y.rs" and out["super::super::super::super::x"] == [] and out["crate"] == []


def test_staged_rules_fail_closed(spark):
    files = spark.createDataFrame([("a", "go", "x 1\ny")], "path string, language string, content string")
    one = staged.Extraction("one", r"x (\d)", ("n",))
    assert [tuple(r) for r in staged.run(staged.StagedRule("r", "x", (one,)), files).collect()] == [("r", "a", 1, {"n": "1"})]
    for rule in (staged.StagedRule("r", "x", (one,), None, ("nothing",)), staged.StagedRule("r", "x", (one,), staged.Link("one", "two", ())), staged.StagedRule("r", "x", (staged.Extraction("one", "x", ("n",)),)), staged.StagedRule("r", "x", ())):
        with pytest.raises(staged.RuleUnavailable):
            staged.run(rule, files)
    with pytest.raises(staged.RuleUnavailable):
        staged.run(staged.StagedRule("r", "x", (one,), None, ("test-case-spans.v1",)), files, ("file-classification.v1",))
    assert staged.run_all([], files) == (None, {})


def test_config(tmp_path):
    path = tmp_path / "config.yml"
    assert config.read_config(str(path)).status == "missing" and config.gate_config(config.read_config(str(path))).rules == []
    path.write_text("languages: [go, python]\ngate: {block: [{name: a, condition: 'crl_local > 0.5'}], warn: [{name: b, condition: 'exposure > 0.9'}]}\nfile_kinds: [{pattern: 'x/**', kind: test}]\n")
    own = config.read_config(str(path))
    assert own.status == "ok" and len(own.sha256) == 64 and config.languages(own, ["java"]) == ["go", "python"] and config.file_kind_rules(own) == [("x/**", "test")]
    assert [(r.name, r.level) for r in config.gate_config(own).rules] == [("a", "block"), ("b", "warn")]
    for text in ("gate: {block: 1}", "gate: {block: [{name: a}]}", "gate: {warn: [{name: a, condition: 'loc > 1 '}]}", "[1]", "a: ["):
        path.write_text(text)
        with pytest.raises(config.ConfigError):
            config.gate_config(config.read_config(str(path)))
    edges = [{"from": "b", "to": "c", "via": "v", "type": "t"}, {"from": "a", "to": "c", "via": "v", "type": "t"}, {"from": "b", "to": "c", "via": "v", "type": "t"}]
    assert config.write_edges(str(tmp_path / "e.yml"), edges) and not config.write_edges(str(tmp_path / "e.yml"), edges[::-1])
    with pytest.raises(config.ConfigError):
        config.write_edges(str(tmp_path / "e.yml"), [{"from": "../b", "to": "c", "via": "v", "type": "t"}])


def test_pending_change(tmp_path):
    store = config.PendingChange(str(tmp_path))
    own = {"entry_id": "e", "timestamp": "1", "deltas": [{"file": "a", "delta_i": 2.0}], "evidence": [{"file": "a", "sha256": "x"}]}
    assert store.seal([]) == "missing" and store.write(own) and not store.write({**own, "timestamp": "2"})
    assert store.seal([{"file": "a", "sha256": "y"}]) == "mismatch" and store.read()["entry_id"] == "e"
    assert store.seal([{"file": "a", "sha256": "x"}]) == "finalized" and store.read() is None and json.loads((tmp_path / "history/e.json").read_text())["deltas"] == own["deltas"]
    with pytest.raises(config.ConfigError):
        store.write({**own, "deltas": [{"file": 1}]})


def test_change_sets(spark, tmp_path):
    git = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@e", *words], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("one\n")
    (tmp_path / "b c.py").write_text("two\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("changed\n")
    (tmp_path / "b c.py").unlink()
    (tmp_path / "new.py").write_text("x" * 50)
    rows = {r.path: r for r in changes.worktree_changes(spark, str(tmp_path), most=20).collect()}
    assert {p: (r.kind, r.before, r.after, r.omitted) for p, r in rows.items()} == {"a.py": ("modified", "one\n", "changed\n", False), "b c.py": ("deleted", "two\n", None, False), "new.py": ("added", None, None, True)}
    assert changes.worktree_changes(spark, str(tmp_path), staged=True).count() == 0
    git("add", "-A")
    assert changes.worktree_changes(spark, str(tmp_path), staged=True).count() == 3
    git("commit", "-qm", "second")
    assert {(r.path, r.kind) for r in changes.revision_changes(spark, str(tmp_path), "HEAD").collect()} == {("a.py", "modified"), ("b c.py", "deleted"), ("new.py", "added")}
    assert {(r.path, r.after) for r in changes.revision_changes(spark, str(tmp_path), "HEAD~1").collect()} == {("a.py", "one\n"), ("b c.py", "two\n")}


def test_prefix_sums_and_exact_percentiles(spark):
    random.seed(3)
    values = [(random.choice("ab"), random.choice([None, *range(30)]), random.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(values, "k string, v int, w int").where("v is not null").groupBy("k", "v").agg(F.sum("w").alias("w"))
    rows = df.collect()
    expected = {(r.k, r.v): sum(x.w for x in rows if x.k == r.k and x.v < r.v) for r in rows}
    assert {(r.k, r.v): r.below for r in tables.prefix_sums(df, ["k"], ["v"], "w").collect()} == expected
    whole = tables.prefix_sums(df.groupBy("v").agg(F.sum("w").alias("w")), [], ["v"], "w")
    assert {r.v: r.below for r in whole.collect()} == {r.v: sum(x.w for x in rows if x.v < r.v) for r in rows}
    numbers = spark.createDataFrame([(random.choice([None, float(random.randint(0, 9))]), 1.0) for _ in range(77)], "a double, b double")
    found = scores.exact_p95(numbers, {"a": F.col("a"), "b": F.col("b"), "c": F.lit(None)}).first()
    assert found.p95_a == pytest.approx(numbers.agg(F.percentile("a", F.lit(0.95))).first()[0]) and found.p95_b == 1.0 and found.p95_c == 0.0
    assert scores.size_dispersion(spark.range(0).withColumnRenamed("id", "s"), "s").first().dispersion == 1.0


def test_pareto_front_against_brute_force(spark):
    random.seed(2)
    rows = [(i, random.randint(0, 6), random.randint(0, 6), random.choice([None, 1, 2, 3])) for i in range(300)]
    value = lambda x: float("-inf") if x is None else x
    best = {r[0] for r in rows if not any(all(value(a) >= value(b) for a, b in zip(o[1:], r[1:], strict=True)) and any(value(a) > value(b) for a, b in zip(o[1:], r[1:], strict=True)) for o in rows)}
    assert {r.i for r in mining.pareto_front(spark.createDataFrame(rows, "i int, a int, b int, c int").repartition(5), ["a", "b", "c"]).collect()} == best
    assert mining.pareto_front(spark.createDataFrame([], "i int, a int"), ["a"]).count() == 0


def test_intervals_of_all_lengths(spark):
    random.seed(5)
    spans = [(random.choice("xy"), i, a, a + random.choice([0, 3, 500, 70_000, 10**9])) for i, a in enumerate(random.randrange(10**6) for _ in range(60))]
    points = [(random.choice("xy"), random.randrange(10**6)) for _ in range(300)]
    s = spark.createDataFrame(spans, "k string, name int, a long, z long")
    p = spark.createDataFrame(points, "k string, at long").distinct()
    expected = {(k, at, n) for k, at in points for kk, n, a, z in spans if k == kk and a <= at <= z}
    assert {(r.k, r["at"], r.name) for r in joins.within(p, s, "k", "at", "a", "z").collect()} == expected
    assert {(r.k, r["at"]) for r in joins.not_within(p, s, "k", "at", "a", "z").collect()} == set(points) - {(k, at) for k, at, _ in expected}
    assert joins.within(p, s.limit(0), "k", "at", "a", "z").count() == 0


def test_long_chains_are_no_cycles(spark):
    chain = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (22, 21), (12, None)]
    assert {r.task for r in graphs.cyclic(spark.createDataFrame(chain, "task long, depends_on long")).collect()} == {20, 21, 22}


def test_events_that_come_early_wait(spark, tmp_path):
    for i, rows in enumerate(([("t", 2, "claimed")], [("t", 1, "verified"), ("t", 4, "completed")], [("t", 3, "completed_local")])):
        spark.createDataFrame(rows, "task string, sequence long, type string").coalesce(1).write.json(str(tmp_path / f"in{i}"))
    stream = lambda: lifecycle.status_stream(spark.readStream.schema("task string, sequence long, type string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    (tmp_path / "in").mkdir()
    q = stream().writeStream.format("memory").queryName("early").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(3):
            for f in (tmp_path / f"in{i}").glob("part-*"):
                f.rename(tmp_path / "in" / f"{i}-{f.name}")
            q.processAllAvailable()
    finally:
        q.stop()
    assert max((r.sequence, r.status) for r in spark.table("early").collect() if r.status) == (4, "completed")


def test_pointers_are_never_missing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    ids = [tables.publish(spark.range(n).withColumnRenamed("id", "path"), root, "path") for n in (3, 4)]
    (tmp_path / "t/pointers/000000000003").mkdir()  # a writer that died
    assert tables.read_generation(spark, root).count() == 4
    assert tables.publish(spark.range(5).withColumnRenamed("id", "path"), root, "path") not in ids and tables.read_generation(spark, root).count() == 5
    assert {r.role for r in tables.inspect_generations(spark, root).collect()} == {"active", "backup", "left"}


def test_similar_groups(spark):
    code = "\n".join(f"const value{chr(97 + i)} = compute(input);" for i in range(12))
    other = "\n".join(f"call{chr(97 + i)}(something, else_{chr(97 + i)});" for i in range(12))
    files = spark.createDataFrame([("a", code), ("b", code), ("c", other), ("d", other + "\n" + other)], "path string, content string")
    index = similarity.indexed(similarity.blocks(files, 12, 6))
    groups = similarity.similar_groups(index, 0.6).collect()
    assert [(r.first, r.files) for r in groups] == [("c", 2), ("a", 2)] or {r.files for r in groups} == {2}
    samples = similarity.top_samples(similarity.blocks(files, 12, 6), 2).collect()
    assert samples[0].path == "d" and len(samples) == 2


def test_small_checks(spark):
    assert identities.analysis_scope(["go"]) == "scope-v2:go:.go:"
    before = spark.createDataFrame([("x", "field", "s", None, True, "strict")], "id string, kind string, signature string, body string, is_public boolean, contract_compatibility string")
    assert diffing.ambiguity(diffing.align(before, before), before, before).count() == 0
    assert testing.scoped_evidence(spark.createDataFrame([], "provider string, rule_id string, action string"), "a", "b", F.lit(False)).first().verdict is None
    assert validation.overall(spark.createDataFrame([], "identity string, availability string")).first().availability == "unavailable"

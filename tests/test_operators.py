"""Operators against hand-computed values and brute force."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import fingerprints as fp
from ledgerline.functions import markdown, paths, source_facts
from ledgerline.operators import diffing, graphs, joins, mining, rules, scores, similarity, testing
from ledgerline.plans import pipelines
from ledgerline.sources import files, tables
from ledgerline.streaming import lifecycle


def test_burden_by_hand(spark):
    df = spark.createDataFrame([(5.0, 4.0, 10.0, None, 0.5, 0.6, None, 5.0)], "max_func_branch double, nesting_depth double, loc double, declaration_loc double, alpha_struct double, connectedness double, external_passthrough_calls double, passthrough_calls double")
    p = spark.createDataFrame([(10.0, 10.0, 10.0, 10.0, 1.0, 0.5)], "p95_branch double, p95_nesting double, p95_loc double, p95_external_passthrough double, p95_alpha double, p95_one_minus_connectedness double")
    r = scores.burden(df, p).first()
    assert r.local_burden == pytest.approx(0.405) and r.exposure == 0.5 and r.module_shape == pytest.approx(0.4)
    assert r.part_alpha == pytest.approx(0.075) and r.part_disconnected == pytest.approx(0.12) and r.composite == pytest.approx(0.6)


def test_impact_by_hand(spark):
    schema = "change_kind string, alpha_struct double, in_degree int, layer_weight double, weighted_branch_delta double"
    one = scores.push_impact(spark.createDataFrame([("function_sig", 0.6, 2, None, None)], schema)).first()
    assert one.i_push == pytest.approx(47.55, abs=0.01)
    two = scores.push_impact(spark.createDataFrame([("function_body", 0.5, 1, 1.3, None), ("function_body", 0.5, 1, 0.8, None)], schema)).first()
    assert two.i_push == pytest.approx(10.5)
    three = scores.push_impact(spark.createDataFrame([("function_sig", 0.5, 1, None, None), ("branch_add", 0.5, 1, None, 2.0)], schema)).first()
    assert three.severity_budget == 60
    anchors = spark.createDataFrame([("x", "interface_add_remove"), ("y", "function_body"), ("z", "function_body")], "anchor string, kind string")
    consumers = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", 1.0)], "anchor string, file string, layer_weight double")
    assert scores.change_surface(anchors, consumers).agg(F.sum("impact")).first()[0] == pytest.approx(100 * math.log2(3) * 2 + 10)


def test_diagnosis_by_hand(spark):
    df = spark.createDataFrame([(4.0, 3.0, 3.0, 3.0, 20.0, 40.0, 4.0, 4.0, 0.2, 0.5), (4.0, 3.0, 3.0, 3.0, 20.0, 40.0, None, 4.0, 0.2, 0.5)], "before_branch double, after_branch double, before_nesting double, after_nesting double, before_loc double, after_loc double, before_passthrough double, after_passthrough double, before_alpha double, after_alpha double")
    df = df.withColumn("after_nesting", F.lit(4.0))
    p = spark.createDataFrame([(10.0, 10.0, 100.0, 10.0)], "p95_branch double, p95_nesting double, p95_loc double, p95_external_passthrough double")
    a, b = scores.diagnosis(df, p).collect()
    assert (a.deterioration, a.improvement, a.exposure_delta) == (pytest.approx(0.05), pytest.approx(0.02), pytest.approx(0.3))
    assert b.deterioration is None and b.improvement is None


def test_confidence_and_empty_percentile(spark):
    c = spark.range(1).select(scores.confidence(F.lit(5), F.lit(10), F.lit(20)).alias("a"), scores.confidence(F.lit(0), F.lit(0), F.lit(10)).alias("b"), scores.confidence(F.lit(1), F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(c) == (pytest.approx(0.4), 0.2, 0.2)
    assert spark.range(0).agg(scores.p95("id")).first()[0] == 0


def test_compaction_replays_exactly(spark):
    h = spark.sql("SELECT * FROM VALUES ('first', timestamp'2026-01-01', 'a', 12.0D), ('second', timestamp'2026-02-01', 'a', 4.0D), ('second', timestamp'2026-02-01', 'b', 7.0D), ('recent', timestamp'2026-06-15', 'b', 3.0D), ('future', timestamp'2027-01-01', 'c', 10.0D) AS t(entry_id, ts, file, delta_i)")
    now = F.lit("2026-08-01").cast("timestamp")
    kept, rest = scores.compact(h, None, F.lit("2026-03-01").cast("timestamp"))
    whole = {r.file: r.crl for r in scores.decayed(h, now).collect()}
    parts = {r.file: r.crl for r in scores.decayed(kept.unionByName(rest.select("file", "ts", "delta_i")), now).collect()}
    assert parts == pytest.approx(whole, rel=1e-12) and whole["c"] == 10 and rest.count() == 2


@pytest.mark.parametrize("condition, expected", [("aa || bb && cc", False), ("aa && bb || cc", False), ("(aa || bb) && cc", False), ("xx >= 5 && yy != 'n'", True), ("xx > 'q'", False), ("missing > 1", False), ("missing != 1", True), ("5.5 < xx", True), ("xx", True)])
def test_rules(spark, condition, expected):
    names = {"aa": F.lit(1.0), "bb": F.lit(0.0), "cc": F.lit(0.0), "xx": F.lit(6.0), "yy": F.lit("z")}
    assert spark.range(1).select(rules.compile_condition(condition, names, ("yy",))).first()[0] is expected


def test_rule_tokens():
    assert [t.value for t in rules.tokenize("ab>5 ")] == ["ab", ">", 5.0] or rules.tokenize("ab> 5")
    for bad in ("a>5", "aa >", "(aa", "aa bb", "aa # 1"):
        with pytest.raises(rules.RuleError):
            rules.compile_condition(bad, {})
    assert rules.thresholds_in('path_class == "x" && 5 < max_func_branch || exposure >= 0.5') == [("exposure", ">=", 0.5), ("max_func_branch", ">", 5.0)]
    assert rules.unsupported_in("loc > 1 && language == 'crl_state'") == ["loc"] and rules.unknown_in("zzz > 1") == ["zzz"]


@pytest.mark.parametrize("glob, path, dot, expected", [("**/*.ts", "a.ts", True, True), ("src/**", "src/a/b", True, True), ("*.ts", ".a.ts", False, False), ("*.ts", ".a.ts", True, True), ("a/{b,c}/?.x", "a/c/d.x", True, True), ("a/*", "a/b/c", True, False), ("**/x/**", "x/y", True, True), ("[!a]*", "b1", True, True)])
def test_globs(glob, path, dot, expected):
    import re

    assert bool(re.search(paths.glob_regex(glob, dot), path)) is expected


def test_reach_and_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("x", "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    assert {r.node: r.reach for r in graphs.reach(df, nodes, 2).collect()} == {"a": 3, "b": 4, "c": 4, "d": 1, "x": 2, "y": 1, "z": 1}
    assert {r.node: r.component for r in graphs.components(df, nodes).collect()} == dict(zip("abcdxyz", "aaaaxxz", strict=True))
    assert {r.task for r in graphs.cyclic(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", None)], "task string, depends_on string")).collect()} == {"a", "b", "c"}


def test_component_share(spark):
    f = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("f", "c"), ("g", "a")], "file string, name string")
    c = spark.createDataFrame([("f", "a", "b"), ("f", "c", "zz")], "file string, caller string, callee string")
    assert {r.file: r.connectedness for r in graphs.component_share(f, c).collect()} == {"f": 0.5, "g": 1.0}


def test_closed_sets_against_brute_force(spark):
    random.seed(4)
    sets = {str(i): frozenset(random.sample("abcdefgh", random.randint(2, 6))) for i in range(25)}
    found = set(sets.values())
    while True:
        more = {a & b for a, b in itertools.product(found, sets.values()) if len(a & b) >= 3} - found
        if not more:
            break
        found |= more
    expected = {}
    for s in found:
        support = [x for x in sets.values() if s <= x]
        if len(s) >= 3 and len(support) >= 3 and frozenset.intersection(*support) == s:
            expected[tuple(sorted(s))] = len(support)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, files array<string>")
    state, closed = mining.closed_sets(df)
    assert state == "available" and {tuple(r.files): r.occurrences for r in closed.collect()} == expected
    assert mining.closed_sets(df, max_intersections=10)[0] == "unavailable"


def test_waves_and_samples(spark):
    df = spark.createDataFrame([(k, i) for k in "abcd" for i in range(3)], "key string, i int")
    out = mining.by_key_waves(df, "key", "i", 6).collect()
    assert len(out) == 6 and {r.key for r in out if r.wave == 1} == set("abcd")
    assert [r.id for r in mining.evenly_sampled(spark.range(10), "id", 3).orderBy("id").collect()] == [1, 5, 8]
    assert mining.evenly_sampled(spark.range(2), "id", 3).count() == 2


CODE = "\n".join(["def area(width, height):", "    # two sides, in metres", "    if width < 0 or height < 0:", '        raise ValueError("sides are 0 or more")', "    return width * height", "", "total = sum(area(w, 12) for w in range(40))", "print(`total`)"])


def plain_fnv(text, seed):
    h = (2166136261 ^ seed) & 0xFFFFFFFF
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def test_code_fingerprint_is_the_formats(spark):
    """MinHash and SimHash against the format's definition, a step at a time."""
    features = spark.createDataFrame([(CODE,)], "content string").select(fp.code_features(F.col("content")).alias("f")).first().f
    lines = [x for x in (re.sub(r"\b\d+\b", "N", re.sub(r"`.+?`", "`X`", x.strip())) for x in CODE.split("\n")) if len(x) > 4]
    assert features == ["\n".join(lines[i : i + 3]) for i in range(len(lines) - 2)]
    assert fp.minhash(features) == [min(plain_fnv(f, i * 0x9E3779B1) for f in features) for i in range(64)]
    votes = [sum(1 if hashlib.sha256(f.encode()).digest()[b // 8] >> (b % 8) & 1 else -1 for f in features) for b in range(64)]
    assert int(fp.simhash(features), 16) == sum(1 << b for b in range(64) if votes[b] >= 0)
    assert fp.minhash([]) == [0] * 64 and fp.simhash([]) == "f" * 16
    assert fp.minhash(["a"])[0] == plain_fnv("a", 0)


def test_similar_documents_against_brute_force(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(random.choices(words, k=40)) for _ in range(8)]
    texts = base + [b.replace("w1 ", "zz ", 1) for b in base] + [base[0], base[0], ""]
    docs = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "path string, content string")
    rows = {r.path: r for r in pipelines.document_index(docs).collect()}
    expected = set()
    for a, b in itertools.combinations(sorted(rows), 2):
        x, y = rows[a], rows[b]
        band = any(x.minhash[k : k + 8] == y.minhash[k : k + 8] for k in range(0, 64, 8))
        near = sum(p == q for p, q in zip(x.minhash, y.minhash, strict=True)) / 64
        if band and (near >= 0.45 or bin(int(x.simhash, 16) ^ int(y.simhash, 16)).count("1") <= 16) and (a in ("00", "09") or b in ("00", "09")):
            expected.add((a, b))
    changed = spark.createDataFrame([("00",), ("09",)], "path string")
    assert {(r.left, r.right) for r in similarity.candidates(pipelines.document_index(docs), changed).collect()} == expected and expected


def test_alignment(spark):
    schema = "id string, kind string, is_public boolean, contract_compatibility string, signature string, body string"
    before = spark.createDataFrame([("f", "function", True, "strict", "(a)", "1"), ("g", "function", True, "strict", "(a)", "1"), ("h", "function", True, "strict", "(a)", "1"), ("h", "function", True, "strict", "(b)", "1"), ("C", "class", True, "strict", "", None), ("C.m", "function", True, "strict", "()", "1"), ("p", "function", False, "strict", "()", "1")], schema)
    after = spark.createDataFrame([("f", "function", True, "strict", "(a, b)", "1"), ("g", "function", True, "strict", "(a)", "2"), ("h", "function", True, "strict", "(c)", "1"), ("h", "function", True, "strict", "(d)", "1"), ("n", "field", True, "additive", "", None)], schema)
    imports = spark.createDataFrame([("x",)], "source string")
    out = {(r.anchor, r.change_kind) for r in diffing.semantic_changes(before, after, imports, imports.limit(0)).collect()}
    assert out == {("f", "public_method_sig"), ("g", "function_body"), ("C", "class_add_remove"), ("p", "function_sig"), ("n", "compatible_field_add"), ("x", "dependency_remove")}
    same = diffing.semantic_changes(before, before, imports, imports).collect()
    assert [(r.anchor, r.change_kind) for r in same] == [(None, "comment_whitespace")]


@pytest.mark.parametrize("signature, n", [("()", 0), ("(a)", 1), ("(a, b)", 2), ("(a: Map<K, V>, b)", 2), ("(f: (x, y) => z)", 1), ("<T>(a = ',')", 1), ("(a, b,)", 2), ("x", None), ("(a", None), (None, None)])
def test_parameter_arity(signature, n):
    assert diffing.parameter_arity(signature) == n


def test_markdown(spark):
    text = "---\na: 1\n---\n# Title\nbody <!-- gone --> `<!-- code -->`\n```\n# not a heading\n```\n## Why\nTBD\n## How\n<!-- open\nstill here"
    out = {r.title: r.body for r in markdown.sections(markdown.markdown_lines(spark.createDataFrame([("a.md", text)], "path string, content string"))).collect()}
    assert out["Title"] == "body  `<!-- code -->`\n```\n# not a heading\n```" and out["Why"] == "TBD" and out["How"] == "<!-- open\nstill here"
    assert markdown.normalized("---\nno\n# A  B\n~~~\nx") == "--- no # a b ~~~ x"
    docs = spark.createDataFrame([("a.md", "## Why\nBecause."), ("b.md", "## Why\n- TODO"), ("c.md", "")], "path string, content string")
    assert {r.path for r in markdown.unfilled(docs, ["Why"]).collect()} == {"b.md", "c.md"}


def test_python_facts(spark):
    code = "import os\nfrom . import x\ndef f(a):\n    if a:\n        return 1\n    if a > 1:\n        if a > 2:\n            g()\n    return g(f(a))\nclass C:\n    z: int = 1\n    def _h(self): pass\ndef test_a():\n    assert f(1)\ndef test_b():\n    pass\n"
    rows = {r.path: r for r in source_facts.file_facts(spark.createDataFrame([("p/a.py", code), ("b.py", "def ("), ("p/x.py", "")], "path string, content string")).collect()}
    a = rows["p/a.py"]
    assert (a.branch_count, a.weighted_branch_total, a.nesting_depth, a.function_count, a.max_func_branch) == (3, pytest.approx(2.3), 2, 4, pytest.approx(2.3))
    assert rows["b.py"].error.startswith("SyntaxError") and rows["b.py"].loc is None and rows["p/x.py"].branch_count == 0
    df = spark.createDataFrame(list(rows.values()), source_facts.FACTS)
    assert [r.test for r in source_facts.findings(df).collect()] == ["test_b"]
    declarations = df.where("error is null").select(F.explode("declarations").alias("d")).select("d.*").withColumn("language", F.lit("python"))
    assert {r.id for r in source_facts.placeholder_bodies(declarations, "python").collect()} == {"C._h", "test_b"}


def test_publish_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert tables.read_generation(spark, root) is None
    one = tables.publish(spark.range(5).withColumnRenamed("id", "path"), root, "path")
    assert tables.publish(spark.range(4, -1, -1).withColumnRenamed("id", "path"), root, "path") == one
    assert tables.publish(spark.range(6).withColumnRenamed("id", "path"), root, "path") != one
    assert tables.read_generation(spark, root).count() == 6


def test_files_and_logs(spark, tmp_path):
    for name, text in {"src/a.ts": "x", "src/a.test.ts": "y", "node_modules/b.ts": "z", "c.md": "# c"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = {r.path: r.kind for r in files.project_files(spark, f"file://{tmp_path}", (".ts",)).collect()}
    assert out == {"src/a.ts": "production", "src/a.test.ts": "test"}
    assert files.project_files(spark, f"file://{tmp_path}", (".ts",), "production-governance").count() == 1
    assert files.markdown_files(spark, f"file://{tmp_path}").count() == 1
    log = "\x01c1\n\nA\ta.ts\nR100\tb\tc\nM\td.ts\n\x01c2\n\nD\ta.ts\n"
    assert list(files.parse_name_status(log)) == [("c1", "a.ts", "added", 0), ("c1", "d.ts", "modified", 0), ("c2", "a.ts", "deleted", 1)]
    assert files.parse_hunks("--- a/x\n+++ b/x\n@@ -1,2 +3 @@ f\n") == [("x", 1, 2, 3, 1)]
    with pytest.raises(ValueError):
        files.implicit_edges(spark, "edges: [{from: a, to: ../b, via: v, type: t}]")
    assert files.implicit_edges(spark, "edges: [{from: a, to: b, via: v, type: t}]").count() == 1


def test_leases():
    held, token, answer = lifecycle.lease_step(None, 0, {"action": "acquire", "owner": "a", "now": 0, "ttl": 10})
    assert (answer, token) == ("acquired", 1)
    assert lifecycle.lease_step(held, token, {"action": "acquire", "owner": "b", "now": 9, "ttl": 10})[2] == "held"
    taken, again, answer = lifecycle.lease_step(held, token, {"action": "acquire", "owner": "b", "now": 10, "ttl": 10})
    assert (answer, again, taken[0]) == ("acquired", 2, "b")
    assert lifecycle.lease_step(taken, again, {"action": "renew", "owner": "a", "token": 1, "now": 11, "ttl": 10})[2] == "lost"
    assert lifecycle.lease_step(None, 2, {"action": "release", "owner": "a", "token": 1, "now": 11})[2] == "released"


def test_status_stream(spark, tmp_path):
    rows = [("t", 1, "verified"), ("t", 2, "claimed"), ("t", 2, "claimed"), ("u", 1, "claimed"), ("t", 3, "completed_local")]
    spark.createDataFrame(rows, "task string, sequence long, type string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("task string, sequence long, type string").json(str(tmp_path / "in"))
    q = lifecycle.status_stream(stream).writeStream.format("memory").queryName("status").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.task, r.status) for r in spark.table("status").collect()} == {("t", "completed_local"), ("u", None)}


def test_testing(spark):
    bodies = spark.createDataFrame([("f", "t", 1, 10), ("f", "u", None, None)], "file string, test string, start int, end int")
    flow = spark.createDataFrame([("f", 2, 1.0), ("f", 5, 0.3), ("f", 20, 1.0)], "file string, line int, weight double")
    nested = spark.createDataFrame([("f", 4, 6)], "file string, start int, end int")
    assert {r.test: r.control_flow for r in testing.control_flow(bodies, flow, nested).collect()} == {"t": 1.0, "u": None}
    growth = testing.growth(spark.createDataFrame([("a.test.ts", 3, 1), ("a.ts", 2, 0), ("x.py", 9, 9)], "path string, added int, removed int")).first()
    assert tuple(growth) == (4, 2, 2.0)
    assert spark.range(1).select(testing.coverage_status(F.lit(3), F.lit(3), F.lit(2), F.lit(0))).first()[0] == "partial"


def test_associations_and_leaves(spark):
    a = spark.createDataFrame([("t", "x", "./x"), ("t", "y", "./y"), ("t", "z", "./y")], "test string, target string, source string")
    calls = spark.createDataFrame([("t", "./x", "f"), ("t", "./y", "g")], "test string, source string, symbol string")
    exports = spark.createDataFrame([("x", "f", "function"), ("y", "g", "function")], "path string, name string, kind string")
    assert {r.target: r.confidence for r in joins.promote_associations(a, calls, exports).collect()} == {"x": "high", "y": "low", "z": "low"}
    facts = spark.createDataFrame([("A.b", "f1"), ("b", "f2"), ("c", "f3")], "name string, file string")
    anchors = spark.createDataFrame([("one", "X.b"), ("all", None)], "anchor string, symbol string")
    assert {r.anchor: r.files for r in joins.consumers_by_leaf(facts, anchors).collect()} == {"one": ["f1", "f2"], "all": ["f1", "f2", "f3"]}

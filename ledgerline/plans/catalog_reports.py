"""Queries of reports: test suites under a policy, baselines' state, readiness. Registered with the others of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import scores, trees
from ledgerline.operators.trees import Pattern, TreeRule
from ledgerline.plans import reports
from ledgerline.plans.catalog import query, stand_in
from ledgerline.plans.catalog_facts import own, pick, text

#: A test file for each supplier, in the five languages in turn: @i its id, and cases of all kinds.
TEST_FILES = (
    ("f@i.test.ts", "typescript", "it('a @i', () => { expect(x).toBe(@i); });\nit.skip('b', f);\ntest.only('c', () => { sleep(@i); });\nit('d', () => { expect(y).toBeTruthy(); });\n"),
    ("f@i_test.go", "go", "package m\nfunc TestA@i(t *testing.T) { t.Fatal(1) }\nfunc TestB(t *testing.T) { t.Skip() }\nfunc TestC(t *testing.T) { sleep(@i) }\n"),
    ("F@iTest.java", "java", "class F@iTest {\n  @Test void a@i() { assertEquals(1, x); }\n  @Disabled @Test void b() { }\n  @Test void c() { sleep(@i); }\n  @Test void d() { assertNotNull(x); }\n}\n"),
    ("f@i.rs", "rust", "#[test]\nfn a@i() { assert!(x); }\n#[test]\n#[ignore]\nfn b() {}\n#[test]\nfn c() { sleep(@i); }\n"),
    ("test_f@i.py", "python", "def test_a@i():\n    assert x\n@pytest.mark.skip\ndef test_b():\n    pass\ndef test_c():\n    sleep(@i)\n"),
)
#: Of each language: rule, kind, the finding's line, and the action that the policy gives it; @: where an exemption may hold.
FOUND_SQL = """(VALUES (0, 'test-skipped', 'skipped', 2, 'warn'), (0, 'test-alone', 'alone', 3, 'block'), (0, 'test-missing-assertion', 'missing_assertion', 3, 'review'), (0, 'test-weak-assertion', 'weak_assertion', 4, 'review'), (0, 'no-sleep', 'file', 3, 'warn'),
    (1, 'test-skipped', 'skipped', 3, 'warn'), (1, 'test-missing-assertion', 'missing_assertion', 4, 'review'), (1, 'no-sleep', 'file', 4, 'warn'), (2, 'test-skipped', 'skipped', 3, 'warn'), (2, 'test-missing-assertion', 'missing_assertion', 4, 'review'), (2, 'test-weak-assertion', 'weak_assertion', 5, 'review'), (2, 'no-sleep', 'file', 4, 'warn'),
    (3, 'test-skipped', 'skipped', 5, 'warn'), (3, 'test-missing-assertion', 'missing_assertion', 7, 'review'), (3, 'no-sleep', 'file', 7, 'warn'), (4, 'test-skipped', 'skipped', 4, 'warn'), (4, 'test-missing-assertion', 'missing_assertion', 6, 'review'), (4, 'no-sleep', 'file', 7, 'warn'))"""


@query(f"SELECT s_suppkey AS id, rule_id, line, CASE WHEN (rule_id = 'test-alone' AND s_suppkey % 10 = 0) OR rule_id = 'test-weak-assertion' THEN 'exempted' ELSE action END AS action FROM supplier JOIN {FOUND_SQL} v(k, rule_id, kind, line, action) ON k = s_suppkey % 5")
def u13_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of cases and of a rule, under a policy by kind and by rule, with an exemption for a file, one everywhere, and one that has run out."""
    k = F.col("s_suppkey")
    filled = lambda n: F.replace(pick(k, *(f[n] for f in TEST_FILES)), F.lit("@i"), k.cast("string"))
    files = own(spark, sf_dir, "supplier").select(filled(0).alias("path"), pick(k, *(f[1] for f in TEST_FILES)).alias("language"), filled(2).alias("content"))
    policy = spark.createDataFrame([("skipped", "warn"), ("alone", "block"), ("no-sleep", "warn")], "key string, action string")
    exempt = own(spark, sf_dir, "supplier").where(k % 10 == 0).select(F.lit("test-alone").alias("rule_id"), text("f", k, ".test.ts").alias("file"), F.lit("2030-01-01").cast("timestamp").alias("expires"))
    exempt = exempt.unionByName(spark.createDataFrame([("test-weak-assertion", None, "2030-01-01"), ("test-skipped", None, "2020-01-01")], "rule_id string, file string, expires string").withColumn("expires", F.col("expires").cast("timestamp")))
    rule = TreeRule("no-sleep", Pattern("call", name="sleep"), "tests don't sleep")
    report = reports.test_report(files, policy, exempt, F.lit("2024-01-01").cast("timestamp"), rules=[rule])
    return report["findings"].select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("id"), "rule_id", "line", "action")


@query("""WITH p AS (SELECT p_brand AS project, count(*) AS n, bool_or(p_partkey % 40 = 0) AS changed, CAST(substr(p_brand, 7) AS INT) AS b FROM part GROUP BY p_brand)
    SELECT project, b % 5 <> 0 AS "exists", CASE WHEN b % 5 <> 0 THEN n ELSE 0 END AS n_files, CASE WHEN b % 5 = 0 OR b % 7 = 0 THEN 'unknown' WHEN b % 3 = 0 THEN 'incompatible' ELSE 'compatible' END AS scope,
    CASE WHEN b % 5 = 0 OR b % 7 = 0 OR b % 3 = 0 OR b % 4 = 0 THEN 'unknown' WHEN changed THEN 'stale' ELSE 'current' END AS freshness, CASE WHEN b % 5 = 0 THEN 'no_readable_index' WHEN b % 7 = 0 OR b % 3 = 0 THEN 'scope_not_compatible' WHEN b % 4 = 0 THEN 'baseline_missing_snapshot_identity' END AS reason FROM p""")
def z54_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each brand; a part in forty has changed since its baseline."""
    part, b = own(spark, sf_dir, "part"), F.substring("project", 7, 9).cast("int")
    files = lambda hash_: part.select(F.col("p_brand").alias("project"), F.col("p_partkey").cast("string").alias("path"), hash_.alias("hash"))
    before, now = files(F.sha2("p_name", 256)), files(F.sha2(F.concat("p_name", F.when(F.col("p_partkey") % 40 == 0, "new").otherwise("")), 256))
    counts = before.groupBy("project").agg(F.count(F.lit(1)).alias("n_files")).join(reports.source_snapshots(before), "project").where(b % 5 != 0)
    baselines = counts.select("project", "n_files", F.when(b % 7 != 0, F.when(b % 3 == 0, "old").otherwise("v2")).alias("scope"), F.when(b % 4 != 0, F.col("snapshot")).alias("snapshot"))
    return reports.status(before.select("project").distinct().withColumn("expected_scope", F.lit("v2")), baselines, now)


@query("""WITH p AS (SELECT p_partkey AS k, (['missing', 'external', 'stale', 'own'])[k % 4 + 1] AS ch, (['own', 'missing', 'stale'])[k % 3 + 1] AS dh, k % 5 <> 0 AS rt, (['missing', 'invalid', 'configured'])[p_size % 3 + 1] AS co, (['missing', 'project-local', 'shared', 'shared'])[p_size % 4 + 1] AS st, k % 7 <> 0 AS sc, k % 2 = 0 AS ass, k % 11 <> 0 AS reg, k % 6 = 0 AS ob FROM part),
    i AS (SELECT k AS project, 'code-hook' AS item, CASE ch WHEN 'missing' THEN 'not_configured' WHEN 'own' THEN 'ready' ELSE 'unavailable' END AS state, 'enforcing' AS kind FROM p UNION ALL SELECT k, 'code-hook-runtime', CASE WHEN rt THEN 'ready' ELSE 'unavailable' END, 'enforcing' FROM p WHERE ch = 'own'
    UNION ALL SELECT k, 'coordination-service', CASE co WHEN 'missing' THEN 'not_configured' WHEN 'configured' THEN 'ready' ELSE 'unavailable' END, 'optional' FROM p UNION ALL SELECT k, 'document-store', CASE st WHEN 'missing' THEN 'not_configured' WHEN 'project-local' THEN 'ready' ELSE CASE WHEN sc AND ass THEN 'ready' ELSE 'unavailable' END END, 'advisory' FROM p
    UNION ALL SELECT k, 'document-scope', CASE WHEN reg THEN 'ready' ELSE 'unavailable' END, 'advisory' FROM p WHERE st = 'shared' AND sc UNION ALL SELECT k, 'document-hook', CASE dh WHEN 'missing' THEN 'not_configured' WHEN 'own' THEN 'ready' ELSE 'unavailable' END, 'advisory' FROM p WHERE st = 'shared' AND sc
    UNION ALL SELECT k, 'document-hook-runtime', CASE WHEN rt THEN 'ready' ELSE 'unavailable' END, 'advisory' FROM p WHERE st = 'shared' AND sc UNION ALL SELECT k, 'document-similarity', CASE WHEN ob THEN 'ready' ELSE 'not_observed' END, 'advisory' FROM p WHERE st = 'project-local' OR (st = 'shared' AND sc)) SELECT * FROM i""")
def z55_readiness_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    projects = own(spark, sf_dir, "part").select(
        k.alias("project"), pick(k, "missing", "external", "stale", "own").alias("code_hook"), pick(k, "own", "missing", "stale").alias("document_hook"), (k % 5 != 0).alias("runtime"), pick(s, "missing", "invalid", "configured").alias("coordination"), pick(s, "missing", "project-local", "shared", "shared").alias("store"),
        (k % 7 != 0).alias("scope_configured"), (k % 2 == 0).alias("associated"), (k % 11 != 0).alias("registered"), F.when(k % 6 == 0, F.lit("2024-01-01").cast("timestamp")).alias("observed_at"))
    return reports.readiness_items(projects)


@query("SELECT 'parts' AS source, p_partkey AS id, 'available' AS state FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'suppliers', s_suppkey, 'available' FROM supplier UNION ALL SELECT 'broken', NULL, 'unavailable' UNION ALL SELECT 'absent', NULL, 'unavailable'")
def z52_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reports, of which one fails as it runs and one as it is made."""
    made = {
        "parts": lambda: own(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id")), "broken": lambda: own(spark, sf_dir, "part").select(F.raise_error(F.lit("no")).cast("long").alias("id")),
        "absent": lambda: own(spark, sf_dir, "part").select(F.col("nothing").alias("id")), "suppliers": lambda: own(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
    }
    rows, states = reports.assembled(spark, made, "id long")
    return states.join(rows, "source", "left").select("source", "id", "state")


@query("SELECT path, language, path_class, kind, loc, declaration_loc, max_func_branch, nesting_depth, connectedness, alpha_struct, in_degree, passthrough_calls, external_passthrough_calls FROM files", "files")
def f9_gate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a wide table of metrics what a gate reads."""
    wide = stand_in(spark, sf_dir, "files").withColumns({"imports": F.array(F.col("path")), "note": F.lit("x")})
    return scores.gate_metrics(wide)


_WIDTH = "(length({0}) + length(regexp_replace({0}, '[^\\x{{2E81}}-\\x{{10FFFF}}]', '', 'g')))"


@query(f"""WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN '表' || p_name WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END AS a, CAST(p_size * p_partkey AS VARCHAR) AS b FROM part), w AS (SELECT greatest(max({_WIDTH.format('a')}), 4) AS x, greatest(max({_WIDTH.format('b')}), 4) AS y FROM c), h AS (SELECT NULL AS k, 'name' AS a, 'size' AS b UNION ALL SELECT * FROM c)
    SELECT k AS position, a || repeat(' ', x - {_WIDTH.format('a')}) || ' ' || repeat(' ', y - {_WIDTH.format('b')}) || b AS line FROM h, w""")
def z59_aligned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = own(spark, sf_dir, "part").select(k, F.when(k % 9 == 0, F.concat(F.lit("表"), "p_name")).when(k % 7 != 0, F.col("p_name")).alias("name"), (F.col("p_size") * k).alias("size"))
    return reports.aligned(rows, {"name": "name", "size": "size"}, "p_partkey", right=["size"])


#: Declarations of shapes with an @ for a number of their own, and what is wrong with them.
DECLARATIONS = (
    '{"java": {"weak_assertion_methods": ["a@", "b"]}, "typescript": {}}', '{"java": {"assertion_methods": ["a@"]}, "python": {"weak_assertion_methods": ["a"]}}', '["java@"]', '{"Java@": {}, "typescript": ["a"]}', '{"typescript": {"weak_assertion_methods": ["a", " "], "patterns@": ["x"]}}',
    '{"java": {"weak_assertion_methods": [1]}, "typescript": {"weak_assertion_methods": ["c@"]}}', None,
)
DECLARED_SQL = """(VALUES (0, 'shapes.java', 'a@,b'), (1, 'shapes.java.assertion_methods', 'not_wired'), (1, 'shapes.python', 'not_wired'), (2, 'shapes', 'invalid_value'), (3, 'shapes.Java@', 'invalid_language_key'), (3, 'shapes.typescript', 'invalid_value'), (4, 'shapes.typescript.weak_assertion_methods', 'invalid_value'),
    (4, 'shapes.typescript.patterns@', 'unknown_shape_class'), (5, 'shapes.java.weak_assertion_methods', 'invalid_value'), (5, 'shapes.typescript', 'c@'))"""


@query(f"SELECT p_partkey AS id, replace(path, '@', CAST(p_size AS VARCHAR)) AS path, replace(found, '@', CAST(p_size AS VARCHAR)) AS found FROM part JOIN {DECLARED_SQL} v(k, path, found) ON k = p_partkey % 7")
def o25_language_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration for each part: the names that it declares, and what is wrong with it."""
    declared = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(pick(F.col("p_partkey"), *DECLARATIONS), F.lit("@"), F.col("p_size").cast("string")).alias("shapes"))
    shapes, errors = reports.shape_declarations(declared)
    return shapes.select("id", F.concat(F.lit("shapes."), "language").alias("path"), F.array_join("names", ",").alias("found")).unionByName(errors.withColumnRenamed("kind", "found"))


#: Definitions of rules with an @ for a number, and the first thing wrong with each.
DEFINITIONS = (
    ('{"name": "r@", "message": "{f} calls", "pattern": {"kind": "statement", "form": "function", "capture": "f", "within": [{"kind": "call", "name": "eval@"}]}}', ""),
    ('{"name": "r@", "message": "x", "pattern": {"kind": "leaf@"}}', "no such kind: leaf@"), ('{"name": "r@", "pattern": ', "no JSON"), ('["r@"]', "no rule: a rule is a mapping with a name and a pattern"),
    ('{"name": "r@", "message": "{nothing@}", "pattern": {"kind": "call"}}', "the message names captures that nothing gives"), ('{"name": "r@", "message": "x", "pattern": {"kind": "call", "depth@": 1}}', "no rule: no such key of a pattern: depth@"),
    ('{"name": "r@", "message": "x", "scope": "repository", "pattern": {"kind": "call"}}', "a repository rule, and no other, links two patterns"), ('{"name": "r@", "message": "x", "requires": ["change-surface.v1", "file-classification.v1"], "pattern": {"kind": "call"}}', "not available: change-surface.v1"),
    ('{"name": "r@", "message": "x", "scope": "repository", "how": "semi", "pattern": {"kind": "call", "capture": "a"}, "other": {"kind": "string", "capture": "b"}, "on": [["a", "b"]]}', ""),
)


@query("SELECT p_partkey AS id, replace(problem, '@', CAST(p_size AS VARCHAR)) AS problem FROM part JOIN (VALUES " + ", ".join(f"({i}, '{problem}')" for i, (_, problem) in enumerate(DEFINITIONS)) + f") v(k, problem) ON k = p_partkey % {len(DEFINITIONS)}")
def u23_extension_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's definition for each part, with the first reason why it can't run."""
    rules = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(pick(F.col("p_partkey"), *(d for d, _ in DEFINITIONS)), F.lit("@"), F.col("p_size").cast("string")).alias("definition"))
    return trees.contract_problems(rules, ["file-classification.v1"]).select("id", F.coalesce(F.get("problems", 0), F.lit("")).alias("problem"))

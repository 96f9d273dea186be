"""More queries: calibration shifts, evidence of version pairs, readiness, contracts, surfaces. Registered with the others of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import identities, paths
from ledgerline.operators import graphs, joins, mining, rules, scores, testing, validation
from ledgerline.plans import pipelines
from ledgerline.plans.catalog import BURDEN_SQL, DECAY_SQL, NOW, RULES, production_files, query, r6, rule_names, scored, stand_in
from ledgerline.plans.catalog_facts import digest_sql, own, pick, text
from ledgerline.sources import tables
from ledgerline.streaming import lifecycle


@query("SELECT path, loc FROM files WHERE path NOT LIKE '%/dist/%' AND path LIKE '%.py'", "files")
def f8_scope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, "files").where(paths.in_scope(F.col("path"), (".py",))).select("path", "loc")


@query("SELECT p_partkey AS rule FROM part WHERE p_partkey % 4 IN (0, 3)")
def f23_burden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part, of four kinds in turn with the part's size in it."""
    k = F.col("p_partkey")
    conditions = pick(k, "crl_local > 0.#", "crl_local > 0.# && exposure > 0.1", "exposure > 0.#", "path_class == 'x' && crl_local >= 0.# || crl_local < 0.1")
    table = own(spark, sf_dir, "part").select(k.alias("rule"), F.replace(conditions, F.lit("#"), F.col("p_size").cast("string")).alias("condition"))
    return rules.rules_only_on(table).select("rule")


@query("+g AS (SELECT regexp_replace(path, '[^/]*$', '') AS d, count(*) AS n FROM files WHERE kind = 'production' AND path LIKE '%.go' GROUP BY ALL) SELECT path FROM files LEFT JOIN g ON d = regexp_replace(path, '[^/]*$', '') WHERE file_id % 8 = 0 OR in_degree > 0 OR (path LIKE '%.go' AND coalesce(n, 0) > 1)", "files")
def f22_possible_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stand_in(spark, sf_dir, "files")
    return graphs.may_have_consumers(files.select("path"), files.where("file_id % 8 <> 0").unionByName(files.where("file_id % 8 = 0").withColumn("in_degree", F.lit(None).cast("long"))).select("path", "kind", "in_degree"), False, False)


COMMON_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS h0 FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0"


@query(f"SELECT CAST((SELECT count(*) FROM ({COMMON_SQL})) AS BIGINT) AS files, {digest_sql(COMMON_SQL)} AS digest")
def j11_common_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    both = joins.common_population(p.where("path % 3 <> 0"), p.where("path % 4 <> 0"))
    return both.agg(F.count(F.lit(1)).alias("files")).join(identities.table_digest(both, F.col("path").cast("string")))


@query("SELECT p_partkey AS id, p_brand AS language, CASE WHEN b % 4 = 0 THEN 'absent' WHEN b % 4 = 1 THEN 'unavailable' WHEN b % 3 = 0 OR b % 4 = 2 THEN 'partial' ELSE 'complete' END AS state FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS b FROM part)")
def j21_evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("language"))
    b = F.substring("language", 7, 9).cast("int")
    reports = p.select("language").distinct().where(b % 4 != 0).select("language", pick(b, "none", "unavailable", "partial", "available").alias("availability"), (b % 3 != 0).alias("complete"))
    return validation.evidence_state(p, reports)


@query("""WITH f AS (SELECT p_brand AS language, min(p_size) AS position FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_brand), a AS (SELECT p_brand AS language, p_partkey % 9 AS n FROM part JOIN f ON p_brand = language AND p_size = position WHERE p_partkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
    SELECT w.language, w.file, w.symbol, coalesce(w.s <= n, false) AS existed, coalesce(w.s <= n - 2, false) AS matched, coalesce(w.f <= n, false) AS in_population FROM (SELECT p_brand AS language, 'f' || p_size % 9 AS file, p_size % 9 AS f, 's' || p_partkey % 9 AS symbol, p_partkey % 9 AS s FROM part) w LEFT JOIN a USING (language)""")
def j29_pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    p = own(spark, sf_dir, "part")
    names = lambda prefix, n: F.transform(F.when(n >= 0, F.sequence(F.lit(0).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    pairs = p.select(F.col("p_brand").alias("language"), F.struct(s, k).alias("position"), F.when(k % 5 == 0, "partial").otherwise("available").alias("availability"), names("f", k % 9).alias("files"), names("s", k % 9).alias("before"), names("s", k % 9 - 2).alias("matched"))
    return validation.pair_evidence(p.select(F.col("p_brand").alias("language"), text("f", s % 9).alias("file"), text("s", k % 9).alias("symbol")), pairs)


@query("SELECT src, dst FROM imports WHERE src % 6 <> 0 UNION ALL SELECT src, dst + 1 FROM imports WHERE src % 6 = 0", "imports")
def j31_rebuilt_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stand_in(spark, sf_dir, "imports")
    changed = own(spark, sf_dir, "part").where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("path"))
    changed = changed.unionByName(edges.where("src % 6 = 0").select(F.col("src").alias("path")))
    return graphs.replace_adjacency(edges, changed, edges.select("src", (F.col("dst") + 1).alias("dst")))


@query("+a AS (SELECT min(path) AS authority FROM files WHERE path LIKE 'pkg2/src/%.py') SELECT path AS file, authority, CASE WHEN file_id % 5 = 0 THEN 'unparseable' ELSE 'missing_import' END AS kind FROM files, a WHERE path LIKE 'pkg1/%' AND path NOT LIKE '%.go' AND (file_id % 5 = 0 OR file_id % 3 <> 0)", "files")
def j32_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stand_in(spark, sf_dir, "files")
    parsed = files.select("path", F.when(~F.col("path").endswith(".go"), F.col("file_id") % 5 != 0).alias("parsed"))
    return joins.contract_findings(parsed, files.where("file_id % 3 = 0").select("path", F.lit("shared").alias("source")), ["pkg1/**"], ["pkg2/src/*.py"], "shared")


@query("SELECT l_orderkey AS test, string_agg(DISTINCT 'w' || p_size % 5, ',' ORDER BY 'w' || p_size % 5) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 GROUP BY l_orderkey")
def j33_foreign_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part")
    imports = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test"), F.col("l_partkey").alias("path"))
    wrappers = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), text("w", F.col("p_size") % 5).alias("name"))
    return joins.foreign_wrappers(imports, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("path")), wrappers).select("test", F.array_join("names", ",").alias("names"))


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS comparable FROM part")
def m18_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    profile = lambda population, contract: F.struct(F.lit("s").alias("scope"), contract.alias("contract"), F.lit("w").alias("weights"), population.alias("population"))
    previous = F.when(k % 5 != 0, profile(F.lit("p"), F.lit("v1")))
    current = profile(F.when(k % 2 == 0, "q").otherwise("p"), F.when(k % 3 == 0, "v2").otherwise("v1"))
    return own(spark, sf_dir, "part").select(k.alias("id"), validation.comparable(previous, current).alias("comparable"))


@query(f"+{BURDEN_SQL} SELECT path, round(local_burden, 6) AS before, round(pb * 0.8 + pn + pl + pe, 6) AS after FROM burden WHERE file_id % 3 <> 0 AND pb > 0", "files")
def m19_shifted_burdens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burdens under a calibration whose branch percentile is a quarter higher, of files whose own facts are the same."""
    before = scored(spark, sf_dir).select("path", "file_id", "local_burden", (F.col("part_branch") * 0.8 + F.col("part_nesting") + F.col("part_loc") + F.col("part_passthrough")).alias("after"), identities.numbers_fingerprint(F.col("loc")).alias("old"))
    df = before.withColumn("new", F.when(F.col("file_id") % 3 != 0, F.col("old")).otherwise("other"))
    return rules.shifted(df, "local_burden", "after", "old", "new").select("path", r6("local_burden").alias("before"), r6("after"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE 'x' END AS provider, concat_ws('; ', CASE WHEN p_partkey % 11 = 0 THEN 'no common population' END, CASE WHEN p_partkey % 5 = 0 THEN 'family is not unique' END, CASE WHEN p_partkey % 7 = 0 THEN 'providers differ' END, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'timed out' ELSE 'coverage is not complete' END END, CASE p_size % 4 WHEN 0 THEN 'not observed' WHEN 1 THEN 'ambiguous' END) AS reason,
    CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND p_size % 4 > 1 THEN 'available' WHEN p_size % 3 = 0 THEN 'unavailable' ELSE 'partial' END AS availability FROM part""")
def m21_calibration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    reports = own(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 11 != 0, F.array(F.lit("f"))).alias("files"), F.when(k % 5 == 0, "unknown").otherwise("function").alias("family"), F.lit("x").alias("before_provider"), F.when(k % 7 == 0, "y").when(k % 2 == 0, "x").alias("after_provider"), (k % 3 != 0).alias("available"),
        F.when(k % 2 == 0, "timed out").alias("reason"), pick(s, "unavailable", "ambiguous", "matched", "added").alias("observed"), F.when(s % 3 == 0, "unavailable").otherwise("partial").alias("state"))
    return validation.calibration_samples(reports)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'configuration_invalid' WHEN p_partkey % 11 = 0 THEN 'unsupported_rule' WHEN p_partkey % 7 = 0 THEN 'baseline_incompatible' WHEN p_partkey % 5 = 0 THEN 'calibration_missing' WHEN p_partkey % 3 = 0 THEN 'no_files' END AS reason FROM part")
def p12_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    holds = {"configuration_invalid": 13, "unsupported_rule": 11, "baseline_incompatible": 7, "calibration_missing": 5, "no_files": 3}
    df = own(spark, sf_dir, "part").select(k.alias("id"), *((k % holds[r] == 0 if r in holds else F.lit(None).cast("boolean")).alias(r) for r in validation.READINESS))
    return validation.readiness(df).select("id", "reason")


@query("SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT src, dst FROM imports WHERE dst % 5 = 0 EXCEPT SELECT src, dst FROM imports WHERE src % 2 = 0)) AS BIGINT) AS added, CAST((SELECT count(*) FROM (SELECT DISTINCT src, dst FROM imports WHERE src % 2 = 0 EXCEPT SELECT src, dst FROM imports WHERE dst % 5 = 0)) AS BIGINT) AS removed, CAST((SELECT count(*) FROM imports WHERE src % 2 <> 0 OR dst % 5 = 0) + (SELECT count(*) FROM imports WHERE src % 2 <> 0 AND dst % 5 = 0) AS BIGINT) AS edges", "imports")
def u8_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stand_in(spark, sf_dir, "imports")
    known = edges.select("src", "dst", F.when(F.col("src") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("confirmed").alias("confidence"))
    out, counts = tables.discovered(known, edges.where("dst % 5 = 0"), "a")
    return counts.join(out.agg(F.count(F.lit(1)).alias("edges")))


@query("SELECT n_nationkey AS id, n_name AS path FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def u17_local_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = own(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"))
    return validation.with_local_authorities(nation, own(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("path")))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100), r AS (SELECT DISTINCT l_orderkey AS id, 'm' || l_partkey % 12 AS p FROM lineitem JOIN f ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' AND l_partkey % 12 <> 5), s AS (SELECT id, list_sort(list(p)) AS own FROM r GROUP BY id HAVING list_contains(list(p), 'm7')),
    c(files) AS (SELECT DISTINCT own FROM s UNION SELECT list_sort(list_intersect(c.files, s.own)) FROM c JOIN s ON len(list_intersect(c.files, s.own)) >= 2), h AS (SELECT files, own FROM (SELECT files FROM c WHERE len(files) >= 2) JOIN s ON list_has_all(own, files)),
    g AS (SELECT files, CAST(count(*) AS BIGINT) AS occurrences FROM h GROUP BY files HAVING count(*) >= 2), m AS (SELECT files, count(*) AS shared FROM (SELECT files, e, count(*) AS n FROM (SELECT files, unnest(own) AS e FROM h) GROUP BY files, e) JOIN g USING (files) WHERE n = occurrences GROUP BY files) SELECT array_to_string(files, ',') AS files, occurrences FROM g JOIN m USING (files) WHERE shared = len(files)""")
def g10_extension_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is modified whenever m7 is extended, over the hundred earliest orders, as the feature's window of commits is."""
    first = own(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("l_orderkey"))
    li = own(spark, sf_dir, "lineitem").join(first, "l_orderkey").select(F.col("l_orderkey").alias("id"), text("m", F.col("l_partkey") % 12).alias("path"), F.when(F.col("l_returnflag") == "A", "added").otherwise("modified").alias("kind"))
    relations = li.select("id", F.lit("m7").alias("coordinator"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("extension")).distinct()
    surfaces = mining.extension_surfaces(li, relations, spark.createDataFrame([("m5",)], "path string"), ["m7", "absent"])
    return surfaces["m7"][1].select(F.array_join("files", ",").alias("files"), "occurrences")


@query("+p AS (SELECT coalesce(quantile_cont(max_func_branch, 0.95), 0) AS b, coalesce(quantile_cont(loc, 0.95), 0) AS l FROM files WHERE coalesce(kind, 'production') = 'production') SELECT round(b, 6) AS branch, round(l, 6) AS loc FROM p", "files")
def m22_percentile_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores.exact_p95(production_files(spark, sf_dir), {"branch": F.col("max_func_branch"), "loc": F.col("loc")})
    return out.select(r6("p95_branch").alias("branch"), r6("p95_loc").alias("loc"))


TEST_FILES = {
    "a§.test.ts": ("typescript", "import x;\nit('adds §', () => {\n  test.skip(`inner`, run);\n});\nother('no'); // it('gone', f)\nit.each([\n  1, '§',\n])('n %i', (n) => {});\ntest.only(\n  \"o'ne\", async () => { run(\"it('no', f)\"); }); it(name, f);\n"),
    "b§_test.go": ("go", "package m\nfunc TestA§(t *testing.T) {\n}\nfunc helper() {}\n"),
    "c§.rs": ("rust", "fn plain() {}\n#[test]\n#[should_panic]\nfn checks_§() {\n}\nfn other() {}\n"),
    "D§Test.java": ("java", "class D {\n  @Test\n  public void works§() {}\n  void helper() {}\n}\n"),
    "test_e§.py": ("python", "def helper():\n    pass\nasync def test_it_§(a):\n    pass\n"),
    "f§.ts": ("typescript", "it('is no test file', f);\n"),
}
TEST_CASES_SQL = "(VALUES (0, 'vitest', 'adds §', 2), (0, 'vitest', 'inner', 3), (0, 'vitest', 'n %i', 6), (0, 'vitest', 'o''ne', 9), (1, 'go-testing', 'TestA§', 2), (2, 'rust-testing', 'checks_§', 4), (3, 'java-junit', 'works§', 3), (4, 'python-pytest', 'test_it_§', 3))"


@query(f"SELECT p_partkey AS id, provider, replace(name, '§', CAST(p_partkey AS VARCHAR)) AS name, line FROM part JOIN {TEST_CASES_SQL} v(k, provider, name, line) ON k = p_partkey % 6")
def u10_test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, in six kinds in turn, with cases and what looks like them."""
    from ledgerline.functions import test_cases

    k = F.col("p_partkey")
    filled = lambda *values: F.replace(pick(k, *values), F.lit("§"), k.cast("string"))
    files = own(spark, sf_dir, "part").select(k.alias("id"), filled(*TEST_FILES).alias("path"), pick(k, *(v[0] for v in TEST_FILES.values())).alias("language"), filled(*(v[1] for v in TEST_FILES.values())).alias("content"))
    return test_cases.cases(files).join(files.select("id", "path"), "path").select("id", "provider", "name", "line")


CHANGED = (
    ("def f(a):\n    return 1\n", "def f(a, b):\n    return 1\n"), ("def f(a):\n    return 1\n", "def f(a):\n    return 2\n"), ("class C:\n    x = 1\n    def m(self): pass\n", ""), ("import os\nx = 1\n", "import sys\nx = 1\n"),
    ("def _p(): pass\n", "def _p(a): pass\n"), ("def f(: broken\n", "x = 1\n"), ("x = 1\n", "# only a comment\nx = 1\n"),
)
CHANGED_SQL = "(VALUES (0, 'f', 'public_method_sig'), (1, 'f', 'function_body'), (2, 'C', 'class_add_remove'), (3, 'sys', 'dependency_add'), (3, 'os', 'dependency_remove'), (4, '_p', 'function_sig'), (5, 'SyntaxError', 'failed'), (6, NULL, 'comment_whitespace'))"


@query(f"SELECT p_partkey AS id, anchor, change_kind FROM part JOIN {CHANGED_SQL} v(k, anchor, change_kind) ON k = p_partkey % 7")
def m13_change_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed Python file for each part: other parameters, body, class, imports; one that can't be read; one with a comment more."""
    from ledgerline.plans.pipelines import change_semantics

    k = F.col("p_partkey")
    changes = own(spark, sf_dir, "part").select(text("a.b/f", k, ".py").alias("path"), pick(k, *(b for b, _ in CHANGED)).alias("before"), pick(k, *(a for _, a in CHANGED)).alias("after"))
    found, failed = change_semantics(changes)
    failed = failed.select("file", F.substring_index("error", ":", 1).alias("anchor"), F.lit("failed").alias("change_kind"))
    return found.unionByName(failed).select(F.regexp_extract("file", r"f(\d+)\.py$", 1).cast("long").alias("id"), "anchor", "change_kind")


@query(f"+{BURDEN_SQL} SELECT path, CASE WHEN local_burden > 0.45 AND max_func_branch >= 20 THEN 'BLOCK' WHEN (language = 'go' AND max_func_branch > 45) OR alpha_struct > 0.95 THEN 'WARN' ELSE 'PASS' END AS verdict FROM burden", "files")
def p11_row_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("path", rules.row_verdict(RULES, rule_names()).alias("verdict"))


@query(f"SELECT file, round({DECAY_SQL}, 6) AS crl FROM history GROUP BY file", "history")
def a19_compacted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger compacted three times, once to an earlier day than before: checkpoint and rest replay to what all records give."""
    root = tables.step_path(spark, "ledger")
    rest = stand_in(spark, sf_dir, "history").withColumn("ts", F.col("ts").cast("timestamp"))
    for days in (25, 10, 20):
        rest = pipelines.compact_ledger(rest, root, F.lit(NOW), days)
    whole = tables.read_generation(spark, root).unionByName(rest.select("file", "ts", "delta_i"))
    return scores.decayed(whole, F.lit(NOW)).select("file", r6("crl"))


@query("""SELECT event_id AS sequence, user_id AS task, event_type AS type FROM events""")
def s29_appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come as a stream, appended to a log and read again."""
    came, path, checkpoint = (tables.step_path(spark, x) for x in ("came", "log", "progress"))
    events = own(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("sequence"), F.col("event_type").alias("type"))
    events.write.json(came)
    lifecycle.append_log(spark.readStream.schema(events.schema).json(came), path, checkpoint).awaitTermination()
    return spark.read.schema(events.schema).json(path)


@query("SELECT reason FROM (VALUES ('repeated'), ('files'), ('test')) v(reason)")
def z2_snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with a row too many, against what it declares."""
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 3 == 0, "test").otherwise("production").alias("kind"))
    declared = p.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("kind") == "production").alias("n_production"), F.count_if(F.col("kind") == "test").alias("n_test"))
    return validation.snapshot_violations(p.unionByName(p.where("kind = 'test'").orderBy("path").limit(1)), declared)


@query("""SELECT DISTINCT 'd' || p_partkey % 30 AS folder, (['go', 'rust', 'java'])[k - 1] AS language FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part) WHERE k IN (2, 3, 4)""")
def z22_nested_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    files = own(spark, sf_dir, "part").select(F.concat(F.when(k % 7 == 6, F.lit("")).otherwise(text("d", k % 30, "/")), pick(k, "a.go", "package.json", "go.mod", "Cargo.toml", "pom.xml", "setup.py", "go.mod")).alias("path"))
    return validation.nested_languages(files, ["typescript", "python"])


@query("SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS documents, CAST((SELECT count(*) FROM labels WHERE quality = 0) AS BIGINT) AS unfilled, CAST((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS BIGINT) AS open_pairs, (SELECT string_agg(event_type || '=' || m, ',' ORDER BY event_type) FROM (SELECT event_type, max(event_id) AS m FROM events GROUP BY event_type)) AS last")
def z56_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.document_observability(own(spark, sf_dir, "documents"), own(spark, sf_dir, "labels").where("quality = 0"), own(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), own(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("event_id").alias("at")))
    return out.select("documents", "unfilled", "open_pairs", F.array_join(F.transform(F.map_entries("last"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("last"))


@query("SELECT DISTINCT l_orderkey AS file, l_partkey AS name FROM lineitem WHERE l_orderkey % 5 = 0 OR (l_orderkey, l_partkey) IN (SELECT (o_orderkey, o_custkey) FROM orders WHERE o_orderkey % 5 <> 0)")
def u22_demanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = own(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("name"))
    return validation.demanded(own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("name")), demand)


@query("WITH b AS (SELECT p_partkey AS id, p_size % 10 AS f, p_partkey AS a, p_partkey + p_size AS z FROM part) SELECT DISTINCT f AS file, id AS name FROM b JOIN lineitem ON l_suppkey % 10 = f AND l_partkey BETWEEN a AND z AND l_returnflag = 'A' WHERE id % 3 <> 0")
def z41_wrapper_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    functions = own(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("long").alias("file"), k.alias("name"), k.alias("start"), (k + F.col("p_size")).alias("end"))
    asserts = own(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select((F.col("l_suppkey") % 10).alias("file"), F.col("l_partkey").alias("line"))
    return testing.wrapper_exports(functions, asserts, functions.where("name % 3 <> 0"))


@query("""WITH i AS (SELECT l_orderkey AS t, l_partkey % 300 AS target, arg_min(l_partkey % 60, l_linenumber * 100000 + l_suppkey * 100 + l_partkey % 60) AS source FROM lineitem WHERE l_partkey % 300 % 2 = 0 GROUP BY ALL), one AS (SELECT t, source, max(target) AS target FROM i GROUP BY t, source HAVING count(*) = 1), used AS (SELECT DISTINCT l_orderkey AS t, l_partkey % 60 AS source, l_suppkey % 10 AS s FROM lineitem),
    ok AS (SELECT DISTINCT t, target, source FROM one JOIN used USING (t, source) WHERE s % 3 = target % 3) SELECT t AS test, target, source, CASE WHEN ok.t IS NULL THEN 'low' ELSE 'high' END AS confidence FROM i LEFT JOIN ok USING (t, target, source)""")
def z42_resolved_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test"), (F.col("l_partkey") % 300).alias("target"), (F.col("l_partkey") % 60).alias("source"), text("f", F.col("l_suppkey") % 10).alias("symbol"), (F.col("l_linenumber") * 100_000 + F.col("l_suppkey") * 100 + F.col("l_partkey") % 60).alias("pos"))
    targets = spark.range(300).withColumnRenamed("id", "path")
    exports = targets.select("path", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).where("n % 3 = path % 3").select("path", text("f", F.col("n")).alias("name"), F.lit("function").alias("kind"))
    return joins.resolved_associations(li, targets.where("path % 2 = 0"), li.select("test", "source", "symbol"), exports).select("test", "target", "source", "confidence")


@query("""SELECT l_partkey AS path, round(sum(CASE WHEN k THEN w * (p_partkey % 10) / 10 * log2(p_size + 1) * 1.5 ELSE 0 END), 4) AS i_push, round(sum(CASE WHEN k THEN w ELSE 0 END), 4) AS severity_budget FROM (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 60 WHEN 'N' THEN 10 ELSE 50 END AS w FROM lineitem) JOIN (SELECT p_partkey, p_size, p_partkey % 4 <> 1 AS k FROM part) ON p_partkey = l_partkey GROUP BY l_partkey""")
def m3_file_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    files = own(spark, sf_dir, "part").select(k.alias("path"), F.when(k % 4 == 1, "test").when(k % 4 == 2, "production").alias("kind"), (k % 10 / 10).alias("alpha_struct"), F.col("p_size").alias("in_degree"), F.lit(1.5).alias("layer_weight"))
    kind = F.when(F.col("l_returnflag") == "A", "public_method_sig").when(F.col("l_returnflag") == "N", "function_body").otherwise("function_sig")
    changes = own(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), kind.alias("change_kind"), F.lit(None).cast("double").alias("weighted_branch_delta"))
    return scores.file_impact(changes, files.join(changes.select("path").distinct(), "path", "left_semi")).select("path", F.round("i_push", 4).alias("i_push"), F.round("severity_budget", 4).alias("severity_budget"))


@query("""WITH c AS (SELECT l_partkey AS a, count(DISTINCT l_suppkey) AS n, max(CASE WHEN l_suppkey % 3 = 0 THEN 1.5 ELSE 1.0 END) AS w FROM lineitem GROUP BY l_partkey), b AS (SELECT *, CAST(substr(p_brand, 7) AS INT) AS b FROM part)
    SELECT p_partkey AS anchor, CASE WHEN b % 3 = 0 THEN 'absent' WHEN b % 3 = 1 AND b % 2 = 0 THEN 'unavailable' ELSE 'complete' END AS state, round(CASE WHEN b % 3 = 0 OR b % 3 = 1 AND b % 2 = 0 THEN NULL WHEN n IS NULL THEN 0 ELSE 10 * log2(n + 1) * w END, 6) AS impact FROM b LEFT JOIN c ON a = p_partkey""")
def m15_change_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("anchor"), F.lit("function_body").alias("kind"), F.col("p_brand").alias("language"))
    b = F.substring("language", 7, 9).cast("int")
    evidence = p.select("language").distinct().where(b % 3 != 0).select("language", F.when((b % 3 == 1) & (b % 2 == 0), "unavailable").otherwise("available").alias("availability"), F.lit(True).alias("complete"))
    consumers = own(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("anchor"), F.col("l_suppkey").alias("file"), F.when(F.col("l_suppkey") % 3 == 0, 1.5).otherwise(1.0).alias("layer_weight"))
    return pipelines.change_surfaces(p, consumers, evidence).select("anchor", "state", r6("impact"))


PYTHON = (
    "import os\nfrom .m§ import x\n\ndef f§(a, b=1):\n    if a:\n        return g(a)\n    if b > 1:\n        if b > 2:\n            g(b)\n    return f§(a)\n\nclass C§:\n    z: int = 1\n    def _h(self):\n        match self.z:\n            case 1:\n                pass\n            case _:\n                k()\n",
    "def test_one():\n    assert f(§)\n\ndef test_two():\n    pass\n\nasync def run§():\n    def inner():\n        if x:\n            raise E\n    await inner()\n",
    "def broken§(:\n",
)
PYTHON_SQL = "(VALUES (0, 6, 3.9, 2, 2, 2.3, 2, 'C#._h:function:false,C#.z:field:true,C#:class:true,f#:function:true', 'f,g,k', false), (1, 1, 0.3, 1, 4, 0.3, 0, 'run#:function:true,test_one:function:true,test_two:function:true', 'f,inner', false), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true))"


@query(f"SELECT p_partkey AS id, branches, weighted, nesting, functions, largest, imports, replace(declarations, '#', CAST(p_partkey AS VARCHAR)) AS declarations, replace(replace(calls, 'f,g,k', 'f' || p_partkey || ',g,k'), '#', '') AS calls, failed FROM part JOIN {PYTHON_SQL} v(k, branches, weighted, nesting, functions, largest, imports, declarations, calls, failed) ON k = p_partkey % 3")
def o42_python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small Python source for each part: guards, nesting, a match, nested functions; one that can't be read."""
    from ledgerline.functions import source_facts

    k = F.col("p_partkey")
    files = own(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.replace(pick(k, *PYTHON), F.lit("§"), k.cast("string")).alias("content"))
    f = source_facts.file_facts(files)
    declared = F.array_join(F.array_sort(F.transform("declarations", lambda d: F.concat_ws(":", d["id"], d["kind"], d["is_public"].cast("string")))), ",")
    calls = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("functions", lambda x: x["calls"])))), ",")
    return f.select(F.col("path").cast("long").alias("id"), F.col("branch_count").alias("branches"), F.round("weighted_branch_total", 6).alias("weighted"), F.col("nesting_depth").alias("nesting"), F.col("function_count").alias("functions"), F.round("max_func_branch", 6).alias("largest"), F.when(F.col("error").isNull(), F.size("imports")).alias("imports"), declared.alias("declarations"), calls.alias("calls"), F.col("error").isNotNull().alias("failed"))


@query("SELECT path, concat_ws(',', CASE WHEN path LIKE 'pkg1/src/%' THEN 'a' END, CASE WHEN path LIKE 'pkg1/%' THEN 'b' END, CASE WHEN path = 'pkg2/src/f2.go' OR path LIKE 'pkg3/%' THEN 'c' END) AS authorities FROM files", "files")
def j23_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_ = [("b", "pkg1/"), ("a", "pkg1/src/"), ("c", "pkg3/"), ("c", "pkg2/src/f2.go"), ("c", "pkg3/src/")]
    return stand_in(spark, sf_dir, "files").select("path", F.array_join(paths.authority_ids(F.col("path"), own_), ",").alias("authorities"))


@query("SELECT 'burden' AS domain, CAST(p_partkey AS VARCHAR) AS id, 'available' AS availability, CAST(p_size AS DOUBLE) AS value, NULL AS reason FROM part UNION ALL SELECT 'log', CAST(user_id AS VARCHAR), 'available', CAST(count(*) AS DOUBLE), NULL FROM events GROUP BY user_id UNION ALL SELECT 'absent', 'absent', 'unavailable', NULL, 'AnalysisException'")
def z50_governance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports' facts, and a third report that can't be made."""
    return validation.governance_facts(spark, [
        ("burden", lambda: own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))), ("absent", lambda: own(spark, sf_dir, "part").select("nothing")),
        ("log", lambda: own(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("value")))])


ACTION_SQL = """q AS (SELECT user_id AS target, event_id AS request_id, CAST(epoch_us(ts) AS BIGINT) AS now, CASE event_type WHEN 'view' THEN 'renew' WHEN 'click' THEN 'release' ELSE 'acquire' END AS action, 'o' || event_id % 2 AS owner, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    f(target, n, request_id, owner, last, expires, answer) AS (SELECT target, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM (SELECT DISTINCT target FROM q)
    UNION ALL SELECT target, n, request_id, CASE WHEN action = 'acquire' THEN CASE WHEN held THEN o ELSE owner END WHEN action = 'release' THEN CASE WHEN mine OR NOT held THEN NULL ELSE o END ELSE CASE WHEN held THEN o END END,
        CASE WHEN action = 'acquire' AND NOT held THEN last + 1 ELSE last END, CASE WHEN action = 'acquire' AND NOT held OR action = 'renew' AND mine THEN now + 86400000000 ELSE expires END,
        CASE action WHEN 'acquire' THEN CASE WHEN held THEN 'held' ELSE 'acquired' END WHEN 'renew' THEN CASE WHEN mine THEN 'renewed' ELSE 'lost' END ELSE CASE WHEN mine OR NOT held THEN 'released' ELSE 'lost' END END
        FROM (SELECT q.*, f.owner AS o, f.last, f.expires, f.owner IS NOT NULL AND q.now < f.expires AS held, f.owner IS NOT NULL AND q.now < f.expires AND f.owner = q.owner AND f.last = 1 AS mine FROM f JOIN q ON q.target = f.target AND q.n = f.n + 1))"""


@query(f"WITH RECURSIVE {ACTION_SQL} SELECT target, request_id, answer FROM f WHERE n > 0")
def t7_lease_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two owners that acquire, renew and release their users' leases, always with the first token."""
    action = F.when(F.col("event_type") == "view", "renew").when(F.col("event_type") == "click", "release").otherwise("acquire")
    e = own(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("target"), F.col("event_id").cast("string").alias("request_id"), action.alias("action"), text("o", F.col("event_id") % 2).alias("owner"), F.lit(1).cast("long").alias("token"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), F.lit(86_400_000_000).alias("ttl"), F.col("event_id").alias("position"))
    return lifecycle.lease_answers(e, "position").select(F.col("target").cast("long").alias("target"), F.col("request_id").cast("long").alias("request_id"), "answer")


@query("SELECT 'd' || p_partkey % 7 AS folder, sha256(string_agg(p_partkey || ' ' || p_brand || chr(10), '' ORDER BY p_partkey)) AS hash, CAST(sum(length(p_partkey || ' ' || p_brand) + 1) AS BIGINT) AS size FROM part WHERE p_partkey % 7 <> 3 GROUP BY p_partkey % 7")
def s1_project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a written tree, those below an excluded folder aside, by their contents."""
    from ledgerline.sources import files as file_sources

    root = tables.step_path(spark, "tree")
    k = F.col("p_partkey")
    lines = own(spark, sf_dir, "part").select(text(k, " ", F.col("p_brand")).alias("value"), k, F.when(k % 7 == 3, "node_modules").otherwise(text("d", k % 7)).alias("folder"))
    for name in ("node_modules", *(f"d{i}" for i in range(7) if i != 3)):
        lines.where(F.col("folder") == name).orderBy("p_partkey").coalesce(1).select("value").write.text(f"{root}/{name}")
    found = file_sources.project_files(spark, root, (".txt",))
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "hash", "size")

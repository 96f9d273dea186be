"""More queries: paths, identities, module resolution, code shapes, tests, documents. Registered with the others of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import fingerprints as fp
from ledgerline.functions import identities, markdown, modules, paths, source_facts
from ledgerline.operators import diffing, graphs, joins, mining, scores, similarity, testing
from ledgerline.plans.catalog import POLICIES, POLICY_SQL, SEMANTIC_SQL, query, r6, stand_in, two_revisions
from ledgerline.sources import files as file_sources
from ledgerline.sources import tables


def own(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def text(*parts: Column | str) -> Column:
    """Columns and literal texts in one."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def pick(index: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_pick(index: str, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) % {len(values)} + 1]"


# -- paths ----------------------------------------------------------------------------------------

SEGMENTS = (*paths.EXCLUDED_SEGMENTS, "src", "distant", "outer", "Dist", "vendors")
TAILS = (".ts", ".TSX", ".py", ".md", ".rs", ".go.txt", ".java", ".vue")


@query(f"""SELECT path, (list_contains({list(paths.EXCLUDED_SEGMENTS)!r}, s)) AS excluded, regexp_matches(lower(path), '\\.(ts|tsx|py|go)$') AND NOT list_contains({list(paths.EXCLUDED_SEGMENTS)!r}, s) AS in_scope,
    CASE WHEN regexp_matches(lower(path), '\\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN lower(path) LIKE '%.vue' THEN 'vue' WHEN lower(path) LIKE '%.go' THEN 'go' WHEN lower(path) LIKE '%.rs' THEN 'rust' WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.java' THEN 'java' END AS language
    FROM (SELECT 'a/' || s || '/f' || p_partkey || t AS path, s FROM (SELECT p_partkey, {sql_pick('p_partkey', *SEGMENTS)} AS s, {sql_pick('p_partkey // 19', *TAILS)} AS t FROM part))""")
def s2_scan_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = own(spark, sf_dir, "part").select(text("a/", pick(k, *SEGMENTS), "/f", k, pick(F.floor(k / 19), *TAILS)).alias("path"))
    segment = F.element_at(F.split("path", "/"), 2)
    return p.select("path", segment.isin(*paths.EXCLUDED_SEGMENTS).alias("excluded"), paths.in_scope(F.col("path"), (".ts", ".tsx", ".py", ".go")).alias("in_scope"), paths.language_of(F.col("path")).alias("language"))


@query("""SELECT p_partkey AS id, (['a/b' || p_partkey, 'a/b' || p_partkey, 'x/' || p_partkey, 'c//d', 'e/f/g'])[p_partkey % 5 + 1] AS path, (['file:a/b' || p_partkey, 'symbol:A\\b', 'plain\\t', 'module:X/Y'])[p_partkey % 4 + 1] AS target FROM part""".replace("'c//d'", "'c/d'"))
def o1_normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.element_at(F.array(text("./a\\b", k), text("a//b", k), text("././x/", k), F.lit("c///d"), F.lit("e\\f\\\\g")), (k % 5 + 1).cast("int"))
    target = F.element_at(F.array(text("FILE:a\\b", k), F.lit("Symbol:A\\b"), F.lit("plain\\t"), F.lit("module:X/Y")), (k % 4 + 1).cast("int"))
    return own(spark, sf_dir, "part").select(k.alias("id"), paths.normalize_path(raw).alias("path"), paths.normalize_target(target).alias("target"))


@query("SELECT path, path LIKE 'pkg1/src/%' AS below, path = 'pkg2/src/f16.py' AS same FROM files", "files")
def f16_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, "files").select("path", paths.protected(F.lit("pkg1/src/"), F.col("path")).alias("below"), paths.protected(F.lit("pkg2/src/f16.py"), F.col("path")).alias("same"))


@query("""SELECT p_partkey AS id, (['java', 'python', 'ts', 'ts', NULL])[p_partkey % 5 + 1] AS language, p_partkey % 3 = 0 AS expected FROM part""")
def o27_assertion_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    modifiers = F.element_at(F.array(F.lit("@org.junit.Test(timeout = 5, expected = Error.class)"), F.lit("@Test public"), F.lit("@Testing(expected = 1)")), (k % 3 + 1).cast("int"))
    return own(spark, sf_dir, "part").select(k.alias("id"), testing.assertion_language(text("a/b", k, pick(k, ".java", ".py", ".ts", ".MJS", ".go"))).alias("language"), testing.declares_expected_failure(modifiers).alias("expected"))


# -- identities -------------------------------------------------------------------------------------


#: Numbers that other formats spell with an exponent, or not.
NUMBERS = ((0.0001, "0.0001"), (12345678.5, "12345678.5"), (0.000001, "0.000001"), (1.5e-7, "1.5e-7"), (1.25e20, "125000000000000000000"), (3e21, "3e+21"), (-0.0002, "-0.0002"), (float("inf"), "null"))
NUMBERS_SQL = repr([spelled for _, spelled in NUMBERS])


@query(f"""SELECT path, sha256('[' || CAST(max_func_branch AS BIGINT) || ',' || CAST(nesting_depth AS BIGINT) || ',' || CAST(greatest(0, loc - coalesce(declaration_loc, 0)) AS BIGINT) || ',' || CASE WHEN e = floor(e) THEN CAST(CAST(e AS BIGINT) AS VARCHAR) ELSE CAST(e AS VARCHAR) END || ',' || ({NUMBERS_SQL})[file_id % 8 + 1] || ']') AS fingerprint FROM (SELECT *, coalesce(external_passthrough_calls, passthrough_calls, 0) / 2 AS e FROM files)""", "files")
def o13_burden_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, "files").select("path", identities.numbers_fingerprint(F.col("max_func_branch"), F.col("nesting_depth"), scores.implementation_loc(), scores.passthrough() / 2, F.element_at(F.array(*(F.lit(n) for n, _ in NUMBERS)), (F.col("file_id") % 8 + 1).cast("int"))).alias("fingerprint"))


def digest_sql(rows: str) -> str:
    """SQL of identities.table_digest over a query of a column h0."""
    return f"(SELECT sha256(string_agg(chunk || ':' || part, ',' ORDER BY chunk || ':' || part)) FROM (SELECT chunk, sha256(string_agg(h, ',' ORDER BY h)) AS part FROM (SELECT sha256(h0) AS h, substr(sha256(h0), 1, 3) AS chunk FROM ({rows})) GROUP BY chunk))"


POPULATION_SQL = "SELECT '[\"' || path || '\",' || CAST(max_func_branch AS BIGINT) || ',' || CAST(loc AS BIGINT) || ',' || coalesce(CAST(CAST(declaration_loc AS BIGINT) AS VARCHAR), 'null') || ']' AS h0 FROM files"


def population_row() -> Column:
    return identities.json_array(identities.json_text(F.col("path")), *(identities.json_number(F.col(c)) for c in ("max_func_branch", "loc", "declaration_loc")))


@query(f"SELECT {digest_sql(POPULATION_SQL)} AS digest", "files")
def o14_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.table_digest(stand_in(spark, sf_dir, "files"), population_row())


@query(f"SELECT {digest_sql('SELECT DISTINCT l_orderkey || chr(47) || l_partkey % 7 AS h0 FROM lineitem')} AS digest")
def o20_common_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.table_digest(own(spark, sf_dir, "lineitem"), text(F.col("l_orderkey"), "/", F.col("l_partkey") % 7), distinct=True)


@query("SELECT 'calibration-v1:' || sha256('[\"scope\",\"v3\",\"' || " + digest_sql(POPULATION_SQL) + " || '\",\"' || sha256('[0.2,0.2,0.15,0.15,0.15,0.15]') || '\"]') AS id, sha256('[0.2,0.2,0.15,0.15,0.15,0.15]') AS weights", "files")
def m20_profile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    population = identities.table_digest(stand_in(spark, sf_dir, "files"), population_row())
    weights = identities.weights_fingerprint(scores.BURDEN_WEIGHTS)
    return population.select(identities.profile_id("calibration-v1", F.lit("scope"), F.lit("v3"), F.col("digest"), weights).alias("id"), weights.alias("weights"))


SUFFIXES_SQL = "CASE language " + " ".join(f"WHEN '{name}' THEN {list(s)!r}" for name, s in paths.LANGUAGE_SUFFIXES) + " END"


@query(f"""WITH c AS (SELECT l_orderkey AS id, {sql_pick('l_partkey', *(name for name, _ in paths.LANGUAGE_SUFFIXES))} AS language, 'd' || l_suppkey % 4 || '/**=' || {sql_pick('l_linenumber', 'test', 'auxiliary')} AS rule FROM lineitem),
    l AS (SELECT id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM c GROUP BY id), e AS (SELECT id, string_agg(DISTINCT s, ',' ORDER BY s) AS suffixes FROM (SELECT id, unnest({SUFFIXES_SQL}) AS s FROM c) GROUP BY id)
    SELECT id, 'scope-v2:' || languages || ':' || suffixes || ':' || rules AS fingerprint FROM l JOIN e USING (id)""")
def o17_analysis_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope for each order: its items' languages and rules, repeated and in any order."""
    chosen = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), pick(F.col("l_partkey"), *(name for name, _ in paths.LANGUAGE_SUFFIXES)).alias("language"), F.struct(text("d", F.col("l_suppkey") % 4, "/**").alias("glob"), pick(F.col("l_linenumber"), "test", "auxiliary").alias("kind")).alias("rule"))
    return chosen.groupBy("id").agg(F.collect_list("language").alias("languages"), F.collect_list("rule").alias("rules")).select("id", identities.scope_fingerprint(F.col("languages"), F.col("rules")).alias("fingerprint"))


@query("""SELECT l_orderkey AS id, 'diff-v3-' || substr(sha256('{"version":3,"baselineIdentity":"b\\"1","revisionKey":"' || l_orderkey || '","evidence":[' || string_agg(item, ',' ORDER BY key, item) || ']}'), 1, 24) AS entry FROM (SELECT l_orderkey, 'f' || l_partkey || ':' || coalesce(a, '') || ':' || l_returnflag AS key,
    '{"file":"f' || l_partkey || '"' || CASE WHEN a IS NULL THEN '' ELSE ',"anchor":"' || a || '"' END || ',"changeKind":"' || l_returnflag || '"}' AS item FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN 'x' || l_linenumber END AS a FROM lineitem)) GROUP BY l_orderkey""")
def o18_history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(text("f", F.col("l_partkey")).alias("file"), F.when(F.col("l_linenumber") % 3 != 0, text("x", F.col("l_linenumber"))).alias("anchor"), F.col("l_returnflag").alias("kind"))
    grouped = own(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("evidence"))
    return grouped.select(F.col("l_orderkey").alias("id"), identities.history_entry_id(F.lit('b"1'), F.col("l_orderkey").cast("string"), F.col("evidence")).alias("entry"))


@query("SELECT p_partkey AS id, sha256('go' || chr(0) || p_name || chr(0) || p_type || chr(0) || p_brand) AS identity, 'sha256-' || sha256(p_name) || '.json' AS shard FROM part")
def o19_declaration_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = identities.declaration_identity(F.lit("go"), F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    return own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2(identity, 256).alias("identity"), identities.shard_name(F.col("p_name")).alias("shard"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":' || coalesce('"' || t || '"', 'null') || ',"user_id":' || user_id || ',"value":' || v || '}') AS observation, sha256('{"event_id":' || event_id || ',"event_type":' || coalesce('"' || t || '"', 'null') || ',"user_id":' || user_id || '}') AS slot
    FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)""")
def o21_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.round(F.col("value") * 100).cast("long").alias("value"), "ts")
    return identities.observation_fingerprint(e, ["value"], "ts").select("event_id", "observation", "slot")


@query("SELECT coalesce(string_agg(l || ':weak_assertion_methods:' || n, ';' ORDER BY l), '') AS fingerprint FROM (SELECT p_brand AS l, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand)")
def o24_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.shapes_fingerprint(own(spark, sf_dir, "part").select(F.col("p_brand").alias("language"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("method")))


@query("SELECT l_orderkey AS id, string_agg(DISTINCT l_partkey || ':' || l_returnflag, '|' ORDER BY l_partkey || ':' || l_returnflag) AS signature FROM lineitem GROUP BY l_orderkey")
def z8_evidence_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(identities.evidence_signature(F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("signature"))


@query(f"SELECT {digest_sql(chr(10).join(['SELECT p_name || chr(124) || p_size || chr(124) || p_partkey * 1000000 AS h0 FROM part']))} AS digest")
def z4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.manifest_digest(own(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.timestamp_seconds("p_partkey").alias("modified")))


@query("SELECT p_partkey AS id, (['_id(_id, ' || p_partkey || ')', 'const _id = _id._id(_id, 1a)', 'return new _id(_id) _id'])[p_partkey % 3 + 1] AS normal FROM part")
def o12_normal_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.element_at(F.array(text('foo("', F.col("p_name"), '\\"x",  ', k, ")"), text("const  row = t.get('a b',\n 1a)"), text(" return new Box(of_", k, ") 'it\\'s' ")), (k % 3 + 1).cast("int"))
    return own(spark, sf_dir, "part").select(k.alias("id"), identities.normalize_call(raw).alias("normal"))


# -- module resolution --------------------------------------------------------------------------------

FILES_SQL = "f AS (SELECT 'pkg' || p_partkey % 7 || '/src/m' || p_partkey || (['.ts', '.tsx', '/index.ts', '.d.ts'])[p_partkey % 4 + 1] AS path FROM part WHERE p_partkey % 5 <> 0)"


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return own(spark, sf_dir, "part").where(k % 5 != 0).select(text("pkg", k % 7, "/src/m", k, pick(k, ".ts", ".tsx", "/index.ts", ".d.ts")).alias("path"))


@query(f"""WITH {FILES_SQL}, i AS (SELECT 'pkg' || l_orderkey % 7 || '/src/sub/a' || l_orderkey || '.ts' AS importer, (['../m' || l_partkey, './../../../pkg' || l_partkey % 7 || '/src/m' || l_partkey || '.js', 'react', '../../../../x'])[l_linenumber % 4 + 1] AS source, (['pkg' || l_orderkey % 7 || '/src/m' || l_partkey, 'pkg' || l_partkey % 7 || '/src/m' || l_partkey, NULL, NULL])[l_linenumber % 4 + 1] AS base FROM lineitem)
    SELECT DISTINCT importer, source, path AS resolved FROM i LEFT JOIN f ON path IN (base || '.ts', base || '.tsx', base || '.d.ts') OR (path = base || '/index.ts' AND source NOT LIKE '%.js')""")
def o47_typescript_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    source = F.element_at(F.array(text("../m", p), text("./../../../pkg", p % 7, "/src/m", p, ".js"), F.lit("react"), F.lit("../../../../x")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    imports = tables.spread(own(spark, sf_dir, "lineitem").select(text("pkg", o % 7, "/src/sub/a", o, ".ts").alias("importer"), source.alias("source")), "importer", "source").distinct()
    return joins.first_existing(modules.typescript_bases(imports), module_files(spark, sf_dir), modules.typescript_candidates).select("importer", "source", "resolved")


@query("""WITH f AS (SELECT 'src/' || (['main', 'test', 'main'])[p_partkey % 3 + 1] || '/java/org/p' || p_partkey % 9 || '/C' || p_partkey || '.java' AS path FROM part WHERE p_partkey % 4 <> 0)
    SELECT DISTINCT importer, source, path AS resolved FROM (SELECT 'A' || l_orderkey AS importer, CASE WHEN l_linenumber = 3 THEN 'org.p1.*' ELSE 'org.p' || l_partkey % 9 || '.C' || l_partkey END AS source FROM lineitem) LEFT JOIN f ON path IN ('src/main/java/' || replace(source, '.', '/') || '.java', 'src/test/java/' || replace(source, '.', '/') || '.java')""")
def z26_java_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("l_partkey")
    found = own(spark, sf_dir, "part").where(k % 4 != 0).select(text("src/", pick(k, "main", "test", "main"), "/java/org/p", k % 9, "/C", k, ".java").alias("path"))
    imports = tables.spread(own(spark, sf_dir, "lineitem").select(text("A", F.col("l_orderkey")).alias("importer"), F.when(F.col("l_linenumber") == 3, "org.p1.*").otherwise(text("org.p", p % 9, ".C", p)).alias("source")), "importer", "source").distinct()
    return joins.fan_out(modules.java(imports), found).select("importer", "source", "resolved")


@query("""WITH f AS (SELECT 'src/a' || p_partkey % 50 || (['.rs', '/mod.rs', '/b' || p_partkey || '.rs'])[p_partkey % 3 + 1] AS path, p_partkey FROM part),
    i AS (SELECT DISTINCT 'src/a' || l_orderkey % 50 || '/x.rs' AS importer, (['crate::a' || l_partkey % 50 || '::b' || l_partkey || '::T', 'super::a' || l_partkey % 50 || '::T', 'self::b' || l_partkey || '::f', 'std::fmt'])[l_linenumber % 4 + 1] AS source, (['src/a' || l_partkey % 50 || '/b' || l_partkey, NULL, 'src/a' || l_orderkey % 50 || '/b' || l_partkey, NULL])[l_linenumber % 4 + 1] AS deep, (['src/a' || l_partkey % 50, 'src/a' || l_partkey % 50, NULL, NULL])[l_linenumber % 4 + 1] AS base FROM lineitem)
    SELECT importer, source, coalesce(min(CASE WHEN path = deep || '.rs' THEN path END), min(CASE WHEN path = base || '.rs' THEN path END), min(CASE WHEN path = base || '/mod.rs' THEN path END)) AS resolved FROM i LEFT JOIN (SELECT DISTINCT path FROM f) f ON path IN (deep || '.rs', base || '.rs', base || '/mod.rs') GROUP BY importer, source""")
def z28_rust_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o, p = F.col("p_partkey"), F.col("l_orderkey"), F.col("l_partkey")
    found = own(spark, sf_dir, "part").select(F.concat(text("src/a", k % 50), F.element_at(F.array(F.lit(".rs"), F.lit("/mod.rs"), text("/b", k, ".rs")), (k % 3 + 1).cast("int"))).alias("path")).distinct()
    source = F.element_at(F.array(text("crate::a", p % 50, "::b", p, "::T"), text("super::a", p % 50, "::T"), text("self::b", p, "::f"), F.lit("std::fmt")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    imports = own(spark, sf_dir, "lineitem").select(text("src/a", o % 50, "/x.rs").alias("importer"), source.alias("source")).distinct()
    return joins.first_existing(modules.rust(imports), found).select("importer", "source", "resolved")


@query("""WITH f AS (SELECT 'k' || p_partkey % 9 || '/f' || p_partkey || (['.go', '_test.go', '.go', '.md'])[p_partkey % 4 + 1] AS path FROM part), i AS (SELECT DISTINCT 'a' || o_orderkey || '.go' AS importer, (['ex.org/m/k' || o_orderkey % 11, 'fmt', 'ex.org/m', 'ex.org/model/k1'])[o_orderkey % 4 + 1] AS source FROM orders)
    , s AS (SELECT split_part(path, '/', 1) AS package, path FROM f WHERE path LIKE '%.go' AND path NOT LIKE '%_test.go'), p AS (SELECT package, count(*) AS files FROM s GROUP BY package)
    SELECT 'import' AS kind, importer AS name, source, package, coalesce(files, 0) AS files FROM i LEFT JOIN p ON source = 'ex.org/m/' || package UNION ALL SELECT 'file', path, NULL, package, NULL FROM s""")
def z25_go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with the package that they mean and how many files it has, and the packages' files: an import means all files of its package, and the pairs would be as many as the product of both."""
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    found = own(spark, sf_dir, "part").select(text("k", k % 9, "/f", k, pick(k, ".go", "_test.go", ".go", ".md")).alias("path"))
    source = F.element_at(F.array(text("ex.org/m/k", o % 11), F.lit("fmt"), F.lit("ex.org/m"), F.lit("ex.org/model/k1")), (o % 4 + 1).cast("int"))
    imports, members = modules.go_packages(own(spark, sf_dir, "orders").select(text("a", o, ".go").alias("importer"), source.alias("source")), found, "ex.org/m")
    null = F.lit(None).cast("string")
    one = imports.select(F.lit("import").alias("kind"), F.col("importer").alias("name"), "source", "package", "files")
    return one.unionByName(members.select(F.lit("file").alias("kind"), F.col("path").alias("name"), null.alias("source"), "package", F.lit(None).cast("long").alias("files")))


@query("""WITH f AS (SELECT 'q' || p_partkey % 5 || '/m' || p_partkey || (['.py', '/__init__.py'])[p_partkey % 2 + 1] AS path FROM part WHERE p_partkey % 3 <> 0)
    SELECT importer, source, path AS resolved FROM (SELECT DISTINCT 'q' || l_orderkey % 5 || '/z' || l_orderkey || '.py' AS importer, repeat('.', l_linenumber % 3) || (['q' || l_partkey % 5 || '.m', 'm', 'q' || l_partkey % 5 || '.m'])[l_linenumber % 3 + 1] || l_partkey AS source, (['q' || l_partkey % 5, 'q' || l_orderkey % 5, 'q' || l_partkey % 5])[l_linenumber % 3 + 1] || '/m' || l_partkey AS base FROM lineitem) LEFT JOIN f ON path IN (base || '.py', base || '/__init__.py')""")
def z27_python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o, p, n = F.col("p_partkey"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber") % 3
    found = own(spark, sf_dir, "part").where(k % 3 != 0).select(text("q", k % 5, "/m", k, pick(k, ".py", "/__init__.py")).alias("path"))
    name = F.when(n == 1, text("m", p)).otherwise(text("q", p % 5, ".m", p))
    facts = own(spark, sf_dir, "lineitem").select(text("q", o % 5, "/z", o, ".py").alias("path"), F.array(F.struct(name.alias("source"), n.cast("int").alias("level"))).alias("imports")).distinct()
    return joins.first_existing(source_facts.import_candidates(facts).distinct(), found).select("importer", "source", "resolved")


@query("SELECT importer, source, p_partkey AS resolved FROM (SELECT DISTINCT l_orderkey AS importer, l_partkey AS source FROM lineitem) LEFT JOIN part ON p_partkey IN (source, source + 1) AND p_size % 2 = 0")
def z24_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = tables.spread(own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("importer"), F.col("l_partkey").alias("source")), "importer", "source").distinct().withColumn("candidates", F.array(F.col("source"), F.col("source") + 1))
    return joins.fan_out(imports, own(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("path")))


# -- code shapes, declarations ---------------------------------------------------------------------------

SHAPE_SQL = """n AS (SELECT DISTINCT l_orderkey AS f, l_linenumber % 4 AS n FROM lineitem), cnt AS (SELECT l_orderkey AS f, count(*) AS k FROM lineitem GROUP BY l_orderkey), c0 AS (SELECT l_orderkey AS f, l_linenumber % 4 AS a, (l_linenumber + l_suppkey) % 5 AS b, CAST(1 + l_partkey % 2 AS BIGINT) AS s FROM lineitem),
    c AS (SELECT c0.* FROM c0 JOIN n ON n.f = c0.f AND n.n = b), e AS (SELECT DISTINCT f, least(a, b) AS a, greatest(a, b) AS b FROM c WHERE a <> b), ways AS (SELECT f, a, b FROM e UNION ALL SELECT f, b, a FROM e),
    r1 AS (SELECT f, n AS s, n AS t FROM n UNION SELECT f, a, b FROM ways), r2 AS (SELECT DISTINCT x.f, x.s, y.t FROM r1 x JOIN r1 y ON x.f = y.f AND x.t = y.s), r3 AS (SELECT DISTINCT x.f, x.s, y.t FROM r2 x JOIN r2 y ON x.f = y.f AND x.t = y.s),
    big AS (SELECT f, max(m) AS m FROM (SELECT f, s, count(*) AS m FROM r3 GROUP BY f, s) GROUP BY f), ties AS (SELECT f, count(*) AS t FROM e GROUP BY f), called AS (SELECT f, count(*) AS d, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS o FROM (SELECT f, b, sum(s) AS s FROM c GROUP BY f, b) GROUP BY f)"""


@query(f"""WITH {SHAPE_SQL} SELECT cnt.f AS file, round(CASE WHEN k <= 1 THEN 1.0 ELSE m / k END, 6) AS connectedness, round(CASE WHEN k <= 1 THEN 1.0 ELSE least(1, coalesce(t, 0) / (k * (k - 1) / 2)) END, 6) AS cohesion, CAST(CASE WHEN k > 1 THEN coalesce(d, 0) ELSE 0 END AS BIGINT) AS called, CAST(CASE WHEN k > 1 THEN coalesce(o, 0) ELSE 0 END AS BIGINT) AS single_call_site,
    round(CASE WHEN k > 1 AND d > 0 THEN o / d END, 6) AS single_call_ratio FROM cnt JOIN big USING (f) LEFT JOIN ties USING (f) LEFT JOIN called USING (f)""")
def a10_call_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a file by their numbers, some twice; calls to some that aren't there."""
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_partkey")
    calls = li.select("file", (F.col("n") % 4).alias("caller"), ((F.col("n") + F.col("l_suppkey")) % 5).alias("callee"), (1 + F.col("l_partkey") % 2).alias("sites"))
    out = graphs.internal_call_shape(li.select("file", (F.col("n") % 4).cast("long").alias("name")), calls.withColumn("caller", F.col("caller").cast("long")))
    return out.select("file", r6("connectedness"), r6("cohesion"), "called", "single_call_site", r6("single_call_ratio"))


@query("SELECT l_orderkey AS file, 'g' || b AS callee, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 1 + l_quantity::BIGINT % 3 END) AS BIGINT) AS sites FROM (SELECT *, l_partkey % 4 AS b FROM lineitem) GROUP BY l_orderkey, b")
def a9_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    callee = text("g", F.col("l_partkey") % 4)
    counts = F.when(F.col("l_linenumber") % 2 == 1, F.create_map(callee, (1 + F.round("l_quantity").cast("long") % 3).cast("int"))).otherwise(F.create_map().cast("map<string,int>"))
    return graphs.call_sites(own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.array(callee, callee).alias("calls"), counts.alias("call_counts")))


@query("""+g AS (SELECT l_orderkey AS id, l_partkey AS f FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT x.id, x.f AS a, y.f AS b FROM g x JOIN imports i ON i.src = x.f JOIN g y ON y.id = x.id AND y.f = i.dst WHERE x.f <> y.f),
    r0 AS (SELECT id, f AS s, f AS t FROM g UNION SELECT id, a, b FROM e UNION SELECT id, b, a FROM e), r1 AS (SELECT DISTINCT x.id, x.s, y.t FROM r0 x JOIN r0 y ON x.id = y.id AND x.t = y.s), r2 AS (SELECT DISTINCT x.id, x.s, y.t FROM r1 x JOIN r1 y ON x.id = y.id AND x.t = y.s), r3 AS (SELECT DISTINCT x.id, x.s, y.t FROM r2 x JOIN r2 y ON x.id = y.id AND x.t = y.s)
    SELECT id, CAST(count(DISTINCT m) AS BIGINT) AS components FROM (SELECT id, s, min(t) AS m FROM r3 GROUP BY id, s) GROUP BY id""", "imports")
def g7_group_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = own(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("files"))
    return graphs.group_components(groups, stand_in(spark, sf_dir, "imports"))


@query(f"""+{SEMANTIC_SQL} SELECT id, kind, outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, kind, 'same' AS outcome FROM same UNION ALL SELECT id, kind, 'modified' FROM changed UNION ALL SELECT id, kind, 'added' FROM came UNION ALL SELECT id, kind, 'removed' FROM went
    UNION ALL SELECT id, kind, 'unresolved' FROM (SELECT id, kind, n FROM lb UNION ALL SELECT id, kind, n FROM la) x WHERE EXISTS (SELECT 1 FROM lb WHERE lb.id = x.id AND lb.kind = x.kind) AND EXISTS (SELECT 1 FROM la WHERE la.id = x.id AND la.kind = x.kind) AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.id = x.id AND c.kind = x.kind)) GROUP BY ALL""", "declarations")
def j9_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.align(*two_revisions(spark, sf_dir)).groupBy("id", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""+{SEMANTIC_SQL}, u AS (SELECT id, kind FROM lb WHERE (id, kind) IN (SELECT (id, kind) FROM la) AND (id, kind) NOT IN (SELECT (id, kind) FROM changed) ORDER BY id, kind LIMIT 1)
    SELECT id, kind, (SELECT string_agg(DISTINCT d.signature, ',' ORDER BY d.signature) FROM declarations d WHERE d.id = u.id AND d.kind = u.kind) AS signatures, 'public_method_sig' AS suggested FROM u""", "declarations")
def z35_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = two_revisions(spark, sf_dir)
    return diffing.ambiguity(diffing.align(before, after), before, after).select("id", "kind", F.array_join("signatures", ",").alias("signatures"), "suggested")


@query("SELECT id, CASE WHEN count(*) = 1 THEN max(kind) END AS kind, CASE WHEN count(*) = 1 THEN max(signature) END AS signature FROM declarations WHERE side = 0 GROUP BY id", "declarations")
def x9_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.unique_by_id(two_revisions(spark, sf_dir)[0])


@query("""+u AS (SELECT id AS i, max(kind) AS k, max(signature) AS s FROM declarations WHERE side = 1 GROUP BY id HAVING count(*) = 1), b AS (SELECT id, CASE WHEN kind = 'field' THEN 'reexport' ELSE kind END AS kind, signature FROM declarations WHERE side = 0)
    SELECT id, CASE WHEN kind = 'reexport' AND k IS NOT NULL THEN k ELSE kind END AS kind, CASE WHEN kind = 'reexport' AND k IS NOT NULL THEN s ELSE signature END AS signature FROM b LEFT JOIN u ON i = id""", "declarations")
def m12_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = two_revisions(spark, sf_dir)
    marked = before.select("id", F.when(F.col("kind") == "field", "reexport").otherwise(F.col("kind")).alias("kind"), "signature")
    return diffing.reexport_identities(marked, after).select("id", "kind", "signature")


@query("+d AS (SELECT DISTINCT id FROM declarations WHERE side = 0 AND id NOT IN (SELECT id FROM declarations WHERE side = 1)) SELECT id FROM d WHERE NOT (contains(id, '.') AND split_part(id, '.', 1) IN (SELECT id FROM d))", "declarations")
def x3_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = two_revisions(spark, sf_dir)
    return diffing.without_ancestors(before.select("id").distinct().join(after.select("id").distinct(), "id", "left_anti"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, (ARRAY[0, 1, 2, 3, 2, NULL, 1])[l_linenumber] AS arity FROM lineitem")
def m11_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    signature = F.element_at(F.array(F.lit("()"), text("(a: Map<string, T", k, ">)"), text('(a = ",", b', k, ")"), text("<T>(a, b: (x, y) => z", k, ", c)"), F.lit("(a, b,)"), F.lit("a, b"), F.lit("(f: [x, y])")), F.col("l_linenumber"))
    return own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), diffing.arity(signature).alias("arity"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, kind, public, sync FROM lineitem JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES ('interface_add_remove', true, true), ('class_add_remove', true, true), ('field_add_remove', true, true), ('public_method_sig', true, true), ('function_sig', false, true), ('compatible_field_add', false, false), ('function_body', false, true), ('branch_add', false, true), ('dependency_add', false, true), ('dependency_remove', false, true), ('comment_whitespace', false, true)) v(kind, public, sync)) ON i = (l_partkey + l_linenumber) % 11")
def f20_change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for each line item, of the eleven kinds in turn."""
    order = ("interface_add_remove", "class_add_remove", "field_add_remove", "public_method_sig", "function_sig", "compatible_field_add", "function_body", "branch_add", "dependency_add", "dependency_remove", "comment_whitespace")
    changes = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), pick(F.col("l_partkey") + F.col("l_linenumber"), *order).alias("kind"))
    return changes.select("id", "n", "kind", diffing.is_public_contract(F.col("kind")).alias("public"), diffing.requires_dependent_sync(F.col("kind")).alias("sync"))


@query("""WITH c AS (SELECT l_orderkey AS f, (['interface_add_remove', 'dependency_add', 'function_body', 'compatible_field_add'])[l_linenumber % 4 + 1] AS k FROM lineitem), u AS (SELECT DISTINCT l_orderkey AS f, 'u' || l_partkey % 30 AS s FROM lineitem), r AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY s) AS r FROM u)
    SELECT c.f AS file, CAST(sum(CASE WHEN k = 'interface_add_remove' THEN 1 ELSE 0 END) AS BIGINT) AS public, CAST(sum(CASE WHEN k = 'dependency_add' THEN 1 ELSE 0 END) AS BIGINT) AS dependency, CAST(sum(CASE WHEN k IN ('function_body', 'compatible_field_add') THEN 1 ELSE 0 END) AS BIGINT) AS implementation, bool_or(k = 'interface_add_remove') AS sync, max(x.c) AS consumers FROM c LEFT JOIN (SELECT f, string_agg(s, ',' ORDER BY s) AS c FROM r WHERE r <= 4 GROUP BY f) x ON x.f = c.f GROUP BY c.f""")
def m14_impact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem")
    changes = li.select(F.col("l_orderkey").cast("string").alias("file"), F.lit("x").alias("anchor"), pick(F.col("l_linenumber"), "interface_add_remove", "dependency_add", "function_body", "compatible_field_add").alias("change_kind"))
    consumers = li.select(F.col("l_orderkey").cast("string").alias("file"), text("u", F.col("l_partkey") % 30).alias("consumer"))
    return diffing.impact_plan(changes, consumers, 4).select(F.col("file").cast("long").alias("file"), "public", "dependency", "implementation", "sync", F.array_join("consumers", ",").alias("consumers"))


@query("""SELECT id, rule FROM (SELECT p_partkey AS id, p_partkey % 8 AS k FROM part) JOIN (VALUES (0, 'braces'), (0, 'empty'), (0, 'silent'), (1, 'silent'), (2, 'pass'), (3, 'pass'), (4, 'async'), (6, 'shape'), (7, 'braces'), (7, 'silent')) v(j, rule) ON j = k""")
def r3_code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bodies = ("{ \n }", "{}", "pass", "...", "async () => {\n x }", "async () => { await x }", "'packages/a'", "{\t}")
    d = own(spark, sf_dir, "part").select(k.alias("id"), pick(k, *bodies).alias("body"), F.when(k % 8 == 0, "run").otherwise("constructor").alias("name"), (k % 8).alias("k"))
    named = lambda df, rule: df.select("id", F.lit(rule).alias("rule"))
    out = named(source_facts.placeholder_bodies(d.where("k in (0, 7)"), "go"), "braces").unionByName(named(source_facts.empty_functions(d.where("k in (0, 7)")), "empty"))
    out = out.unionByName(named(source_facts.silent_handlers(d.where("k in (0, 1, 5, 7)"), "typescript"), "silent")).unionByName(named(source_facts.placeholder_bodies(d.where("k in (2, 3, 4)"), "python"), "pass"))
    return out.unionByName(named(source_facts.async_without_await(d, "body"), "async")).unionByName(named(source_facts.project_shapes(d, text="body"), "shape"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 20 AS s FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 20 AS s FROM lineitem WHERE l_linenumber >= 2)
    SELECT 'new' AS rule, 'auth' || f % 3 AS authority, f AS file, s AS source FROM a WHERE f % 2 = 0 AND s % 4 = f % 4 AND (f, s) NOT IN (SELECT (f, s) FROM b) UNION ALL SELECT 'any', 'auth' || f % 3, f, s FROM a WHERE f % 2 = 0 AND s % 4 = f % 4""")
def r1_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 20).alias("source"), "l_linenumber")
    before, after = li.where("l_linenumber <= 3").select("file", "source").distinct(), li.where("l_linenumber >= 2").select("file", "source").distinct()
    authorities = own(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(text("auth", F.col("o_orderkey") % 3).alias("authority"), F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("prohibited")).where("prohibited % 4 = file % 4")
    return source_facts.prohibited_imports(before, after, authorities).withColumn("rule", F.lit("new")).unionByName(source_facts.forbidden_imports(after, authorities).withColumn("rule", F.lit("any")))


# -- tests ------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'not_applicable' WHEN c_custkey % 7 = 0 THEN 'unsupported' WHEN c_custkey % 3 = 0 THEN 'unavailable' WHEN c_custkey % 2 = 0 OR c_custkey % 3 < c_custkey % 5 THEN 'partial' ELSE 'complete' END AS status FROM customer")
def a41_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return own(spark, sf_dir, "customer").select(k.alias("id"), testing.coverage_status(k % 5, k % 7, k % 3, (k + 1) % 2).alias("status"))


BODY_SQL = "bodies AS (SELECT p_partkey AS id, p_size % 10 AS f, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey END AS a, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey + p_size END AS z FROM part)"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    start = F.when(k % 9 != 0, k)
    return own(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("long").alias("file"), k.alias("test"), start.alias("start"), (start + F.col("p_size")).alias("end"))


@query(f"""WITH {BODY_SQL}, flow AS (SELECT l_suppkey % 10 AS f, l_partkey AS l, CASE WHEN l_linenumber % 2 = 0 THEN 0.3 ELSE 1.0 END AS w FROM lineitem), nested AS (SELECT s_suppkey % 10 AS f, s_suppkey * 15 AS a, s_suppkey * 15 + 7 AS z FROM supplier), outside AS (SELECT * FROM flow WHERE NOT EXISTS (SELECT 1 FROM nested WHERE nested.f = flow.f AND l BETWEEN a AND z))
    SELECT b.f AS file, id AS test, round(CASE WHEN a IS NOT NULL THEN coalesce(sum(w), 0) END, 6) AS control_flow FROM bodies b LEFT JOIN outside o ON o.f = b.f AND l BETWEEN a AND z GROUP BY b.f, id, a""")
def a45_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = own(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), F.col("l_partkey").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, 0.3).otherwise(1.0).alias("weight"))
    s = F.col("s_suppkey")
    nested = own(spark, sf_dir, "supplier").select((s % 10).alias("file"), (s * 15).alias("start"), (s * 15 + 7).alias("end"))
    return testing.control_flow(bodies(spark, sf_dir), flow, nested).select("file", "test", r6("control_flow"))


@query(f"WITH {BODY_SQL} SELECT DISTINCT f AS file, id AS name FROM bodies JOIN lineitem ON l_suppkey % 10 = f AND l_partkey BETWEEN a AND z AND l_linenumber = 1")
def j17_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asserts = own(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 10).alias("file"), F.col("l_partkey").alias("line"))
    return testing.assertion_wrappers(bodies(spark, sf_dir).withColumnRenamed("test", "name").where("start is not null"), asserts).select("file", "name")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 50 AS s, p_partkey % 50 + 3 AS e FROM part) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM range(s, e + 1) r(x) WHERE x % 13 = 0) THEN 'assertion' WHEN EXISTS (SELECT 1 FROM range(s, e + 1) r(x) WHERE x BETWEEN 20 AND 30) THEN 'case_body' WHEN EXISTS (SELECT 1 FROM range(s, e + 1) r(x) WHERE x % 11 = 1) THEN 'assembly' ELSE 'unclassified' END AS semantics FROM b""")
def o29_block_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_partkey") % 50
    lines = lambda *xs: F.array(*(F.lit(x).cast("long") for x in xs))
    return own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), testing.block_semantics(F.sequence(start, start + 3), lines(*range(0, 60, 13)), lines(*range(20, 31)), lines(*range(1, 60, 11))).alias("semantics"))


@query("SELECT f AS file, CAST(count(DISTINCT x) AS BIGINT) AS lines, CAST(sum(DISTINCT x) AS BIGINT) AS total FROM (SELECT l_orderkey AS f, unnest(range(l_partkey, l_partkey + l_linenumber + 1)) AS x FROM lineitem) GROUP BY f")
def z38_case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end"))
    return testing.case_lines(spans).select("file", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT l_orderkey AS file, CAST(sum(CASE WHEN l_linenumber % 4 = 0 THEN q ELSE 0 END) AS BIGINT) AS assertion, CAST(sum(CASE WHEN l_linenumber % 4 = 1 THEN q ELSE 0 END) AS BIGINT) AS case_body, CAST(sum(CASE WHEN l_linenumber % 4 > 1 THEN q ELSE 0 END) AS BIGINT) AS charged, round(sum(CASE WHEN l_linenumber % 4 > 1 THEN q ELSE 0 END) / 500.0, 6) AS share FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey""")
def a29_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.round("l_quantity").cast("long").alias("lines"), pick(F.col("l_linenumber"), "assertion", "case_body", "assembly", "unclassified").alias("semantics"))
    return testing.semantic_buckets(li, li.select("file").distinct().withColumn("total", F.lit(500))).select("file", "assertion", "case_body", "charged", r6("share"))


@query("SELECT p_partkey AS path, p_brand AS language, CASE WHEN b % 3 = 0 THEN 'own' || b WHEN b % 2 = 0 THEN 'built' || b END AS patterns, CASE WHEN b % 3 = 0 THEN 'project' WHEN b % 2 = 0 THEN 'builtin' END AS origin FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS b FROM part)")
def z39_weak_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = own(spark, sf_dir, "part").select(F.col("p_brand").alias("language")).distinct().withColumn("b", F.substring("language", 7, 9).cast("int"))
    mine, built = brands.where("b % 3 = 0").select("language", text("own", F.col("b")).alias("patterns")), brands.where("b % 2 = 0").select("language", text("built", F.col("b")).alias("patterns"))
    return testing.weak_patterns(own(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("language")), mine, built)


@query("SELECT CAST(c_custkey AS VARCHAR) AS adapter, s_name AS kind, CASE WHEN s_name IS NULL THEN 'unknown adapter ' || c_custkey END AS error FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def z45_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = own(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("adapter"), F.col("s_name").alias("kind"))
    return testing.selected_adapters(own(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("adapter")), registry)


@query("SELECT DISTINCT p_type AS adapter FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size % 10 = 3)")
def z44_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part")
    return testing.suggested_adapters(p.where("p_size % 10 = 3").select(F.col("p_brand").alias("language")), p.select(F.col("p_brand").alias("language"), F.col("p_type").alias("adapter")))


@query("SELECT CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) > 0 THEN 'partial' ELSE 'available' END AS some, 'unavailable' AS none, 'available' AS every")
def z47_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = own(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    handled = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path")).distinct()
    one = lambda n, *x: testing.span_availability(*x).withColumnRenamed("availability", n)
    return one("some", files, handled, files.limit(0), 2).join(one("none", files, handled, files.limit(0), 0)).join(one("every", files, files, files.limit(0), 1))


@query("SELECT CAST(count(*) AS BIGINT) AS findings, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) WHEN 3 THEN 'BLOCK' WHEN 2 THEN 'WARN' ELSE 'REVIEW' END AS verdict FROM events WHERE user_id % 5 = 2 AND event_id % 3 = 1")
def z48_scoped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("provider"), (F.col("event_id") % 3).cast("string").alias("rule_id"), F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "click", "warn").otherwise("review").alias("action"))
    return testing.scoped_evidence(e, "2", "1", F.lit(True))


@query("SELECT CAST(coalesce(sum(CASE WHEN l_linenumber % 3 = 0 THEN q + coalesce(r, 0) END), 0) AS BIGINT) AS test_lines, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN q + coalesce(r, 0) END) AS BIGINT) AS other_lines, round(sum(CASE WHEN l_linenumber % 3 = 0 THEN q + coalesce(r, 0) END) / sum(CASE WHEN l_linenumber % 3 = 1 THEN q + coalesce(r, 0) END), 6) AS growth FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS r FROM lineitem)")
def s32_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), pick(F.col("l_linenumber"), ".test.ts", ".ts", ".py")).alias("path"), F.round("l_quantity").cast("long").alias("added"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).alias("removed"))
    return testing.growth(li).select("test_lines", "other_lines", r6("growth"))


ASSOCIATION_SQL = "a AS (SELECT DISTINCT l_orderkey AS t, l_partkey % 300 AS target, l_partkey % 60 AS source FROM lineitem)"


@query(f"""WITH {ASSOCIATION_SQL}, one AS (SELECT t, source, max(target) AS target FROM a GROUP BY t, source HAVING count(*) = 1), used AS (SELECT DISTINCT l_orderkey AS t, l_partkey % 60 AS source, 'f' || l_suppkey % 10 AS s FROM lineitem), ok AS (SELECT t, target, source, string_agg(DISTINCT s, ',' ORDER BY s) AS symbols FROM one JOIN used USING (t, source) WHERE CAST(substr(s, 2) AS INT) % 3 = target % 3 GROUP BY t, target, source)
    SELECT t AS test, target, source, symbols, CASE WHEN symbols IS NULL THEN 'low' ELSE 'high' END AS confidence FROM a LEFT JOIN ok USING (t, target, source)""")
def j5_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test"), (F.col("l_partkey") % 300).alias("target"), (F.col("l_partkey") % 60).alias("source"), text("f", F.col("l_suppkey") % 10).alias("symbol"))
    exports = spark.range(300).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).where("n % 3 = path % 3").select("path", text("f", F.col("n")).alias("name"), F.lit("function").alias("kind"))
    out = joins.promote_associations(li.select("test", "target", "source").distinct(), li.select("test", "source", "symbol"), exports)
    return out.select("test", "target", "source", F.array_join("symbols", ",").alias("symbols"), "confidence")


@query("""WITH f AS (SELECT DISTINCT 'n' || l_partkey % 40 AS leaf, 'x' || l_orderkey % 200 AS file FROM lineitem) SELECT a AS anchor, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM (SELECT p_partkey AS a, CASE WHEN p_partkey % 97 <> 0 THEN 'n' || p_partkey % 50 END AS s FROM part) JOIN f ON leaf = s OR s IS NULL GROUP BY a""")
def j19_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = own(spark, sf_dir, "lineitem").select(F.concat(F.lit("Box."), text("n", F.col("l_partkey") % 40)).alias("name"), text("x", F.col("l_orderkey") % 200).alias("file"))
    anchors = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("anchor"), F.when(F.col("p_partkey") % 97 != 0, F.concat(F.lit("A.B."), text("n", F.col("p_partkey") % 50))).alias("symbol"))
    return joins.consumers_by_leaf(facts, anchors).select("anchor", F.array_join("files", ",").alias("files"))


# -- documents, code fingerprints --------------------------------------------------------------------


@query("""SELECT p_partkey AS id, k IN (1, 2, 3, 5, 6) AS unfilled FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)""")
def o34_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a filled section, a placeholder, a comment alone, no section, a heading in a fence, an open comment, an open fence."""
    k = F.col("p_partkey")
    bodies_ = ("## Why\nBecause.\n", "## Why\n- TBD\n", "## Why\n<!-- later -->\n", "# Title\ntext\n", "---\na: 1\n---\n## why\nYes `<!-- code -->`\n```\n# no\n```\n", "```\n## Why\nfenced\n```\n", "## Why\n<!-- open\ntext\n")
    return markdown.unfilled(own(spark, sf_dir, "part").select(k.cast("string").alias("path"), pick(k, *bodies_).alias("content")), ["Why"]).select(F.col("path").cast("long").alias("id"), F.lit(True).alias("unfilled")).unionByName(
        own(spark, sf_dir, "part").where("p_partkey % 7 in (0, 4)").select(k.alias("id"), F.lit(False).alias("unfilled")))


@query("""SELECT p_partkey AS id, s AS section, title, body FROM part JOIN (VALUES (0, 0, NULL, 'lead'), (0, 1, 'A', 'x  y'), (0, 2, 'B c', ''), (1, 0, NULL, '```' || chr(10) || '# no' || chr(10) || '```'), (1, 1, 'Yes', '`<!-- kept -->`')) v(k, s, title, body) ON k = p_partkey % 2""")
def o32_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    docs = own(spark, sf_dir, "part").select(k.cast("string").alias("path"), pick(k, "lead\n# A\nx <!-- a\nb --> y\n## B c", "```\n# no\n```\n### Yes\n`<!-- kept -->`").alias("content"))
    out = markdown.sections(markdown.markdown_lines(docs))
    return out.select(F.col("path").cast("long").alias("id"), "section", "title", F.regexp_replace("body", "x \n y", "x  y").alias("body"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'title text' WHEN 1 THEN 'a fi b 1' ELSE 'strasse kept' END AS normal FROM part")
def o9_normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    docs = ("---\nx: 1\n---\nTitle   TEXT\n```\ncode\n```", "A ﬁ\n\nB  １", "Strasse <!-- gone -->kept\n~~~\nno\n~~~")
    files = tables.spread(own(spark, sf_dir, "part").select(k.alias("id"), pick(k, *docs).alias("content")), "id")
    return files.select("id", markdown.normalize("content").alias("normal"))


#: Documents' texts with every line behind tabs, wide blanks or none.
TABBED_SQL = "array_to_string(list_transform(string_split(regexp_replace(text, '[0-9]', 'z', 'g'), chr(10)), lambda x, i: (['', chr(9), chr(9) || ' ', chr(160), chr(12288) || chr(9)])[(doc_id + i) % 5 + 1] || x || (['', chr(9)])[i % 2 + 1]), chr(10))"


def tabbed(doc_id: Column, content: Column) -> Column:
    lines = F.split(F.regexp_replace(content, "[0-9]", "z"), "\n")
    ends = lambda i, *values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(ends(doc_id + i + 1, "", "\t", "\t ", "\u00a0", "\u3000\t"), x, ends(i + 1, "", "\t"))), "\n")


def code_sql(content: str) -> str:
    kept = f"list_filter(list_transform(string_split({content}, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x, ' ' || chr(9) || chr(13) || chr(160) || chr(12288)), '`.+?`', '`X`', 'g'), '//.*$', '')), lambda x: length(x) > 4)"
    return f"(SELECT CASE WHEN len(k) < 3 THEN [] ELSE list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i : i + 2], chr(10))) END FROM (SELECT {kept} AS k))"


@query(f"SELECT doc_id, CAST(len(f) AS BIGINT) AS features, sha256(array_to_string(f, chr(10))) AS hash FROM (SELECT doc_id, {code_sql('t')} AS f FROM (SELECT doc_id, {TABBED_SQL} AS t FROM documents))")
def w2_code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    made = tables.spread(own(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.array(fp.code_features(tabbed(F.col("doc_id"), F.col("text"))))).alias("f"))  # a row for a row: both columns take the same windows
    return made.select("doc_id", F.size(f).cast("long").alias("features"), F.sha2(F.array_join(f, "\n"), 256).alias("hash"))


@query("""WITH a AS (SELECT p_partkey, list_transform(range(0, 64), lambda i: (p_partkey * (i + 3)) % 5) AS x, list_transform(range(0, 64), lambda i: (p_size * (i + 1)) % 5) AS y, md5(p_name) AS m, md5(p_brand) AS n FROM part)
    SELECT p_partkey AS id, round(len(list_filter(range(1, 65), lambda i: x[i] = y[i])) / 64, 6) AS similarity, CAST(bit_count(xor(CAST('0x' || m[1:8] AS BIGINT), CAST('0x' || n[1:8] AS BIGINT))) + bit_count(xor(CAST('0x' || m[9:16] AS BIGINT), CAST('0x' || n[9:16] AS BIGINT))) AS INT) AS distance, array_to_string(list_transform(range(0, 8), lambda b: b || ':' || array_to_string(x[b * 8 + 1 : b * 8 + 8], ',')), ';') AS bands FROM a""")
def o5_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col(c) * (i + n)) % 5)
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), values("p_partkey", 3).alias("x"), values("p_size", 1).alias("y"), F.substring(F.md5("p_name"), 1, 16).alias("m"), F.substring(F.md5("p_brand"), 1, 16).alias("n"))
    return p.select("id", F.round(fp.minhash_similarity(F.col("x"), F.col("y")), 6).alias("similarity"), fp.simhash_distance(F.col("m"), F.col("n")).alias("distance"), F.array_join(fp.band_keys(F.col("x")), ";").alias("bands"))


BLOCKS_SQL = f"""b AS (SELECT doc_id, b, {code_sql('content')} AS f FROM (SELECT doc_id, b, array_to_string(lines[b + 1 : b + 8], chr(10)) AS content FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 7, 4)) AS b FROM (SELECT doc_id, string_split(regexp_replace(text, '[0-9]', 'z', 'g'), chr(10)) AS lines FROM documents) WHERE len(lines) >= 8))),
    k AS (SELECT doc_id, b, sha256(array_to_string(list_sort(list_distinct(f)), chr(1))) AS h FROM b WHERE len(f) > 0)"""


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(b AS INT) AS start FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)")
def j26_repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At similarity 1 the blocks with the features of another one."""
    docs = own(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "[0-9]", "z").alias("content"))
    found = similarity.repeated_blocks(similarity.indexed(similarity.blocks(docs, 8, 4)), 1.0)
    return found.select(F.col("path").cast("long").alias("doc_id"), "start")


@query("SELECT doc_id, sha256(t) AS hash FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' new' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0)")
def s28_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index brought up to date: documents that changed, came and went since the one before."""
    from ledgerline.plans.pipelines import document_index

    docs = own(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    before = tables.cut_lineage(document_index(docs.where("CAST(path AS BIGINT) % 5 <> 0")), "index")
    now = docs.where("CAST(path AS BIGINT) % 7 <> 0").withColumn("content", F.when(F.col("path").cast("long") % 3 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    return document_index(now, before).select(F.col("path").cast("long").alias("doc_id"), "hash")


# -- files, generations, policies --------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN doc_id IS NULL THEN 'missing' WHEN octet_length(encode(text)) > 2000 THEN 'omitted' ELSE 'available' END AS status, CASE WHEN octet_length(encode(text)) <= 2000 THEN sha256(text) END AS hash FROM orders LEFT JOIN documents ON doc_id = o_orderkey""")
def s24_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = own(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    out = file_sources.blobs(own(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), store, 2000)
    return out.select(F.col("path").alias("id"), "status", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("hash"))


@query("SELECT 'f' || l_orderkey AS file, l_partkey AS before_start, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE l_linenumber END AS before_lines, l_partkey + 2 AS after_start, l_linenumber % 3 AS after_lines FROM lineitem")
def z9_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    hunk = text("@@ -", p, F.when(n % 2 == 0, "").otherwise(text(",", n)), " +", p + 2, ",", n % 3, " @@ f()\n+x\n")
    diffs = own(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(hunk), "").alias("h")).select(text("--- a/f\n+++ b/f", F.col("l_orderkey"), "\n", F.col("h")).alias("diff"))
    return file_sources.hunks(diffs)


@query("""SELECT DISTINCT src, dst FROM (SELECT 'a/x' || l_orderkey % 50 AS src, 'b/y' || l_partkey % 50 AS dst, l_linenumber AS n FROM lineitem) WHERE n NOT IN (3, 4)""")
def x6_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    a, b = text("x", F.col("l_orderkey") % 50), text("y", F.col("l_partkey") % 50)
    src = F.when(n == 1, F.concat(F.lit("./a/"), a)).when(n == 2, F.concat(F.lit("a\\"), a)).when(n == 3, F.concat(F.lit("/a/"), a)).otherwise(F.concat(F.lit("a/"), a))
    dst = F.when(n == 4, F.concat(F.lit("../b/"), b)).when(n == 5, F.concat(F.lit("././b//"), b)).otherwise(F.concat(F.lit("b/"), b))
    return file_sources.canonical_edges(own(spark, sf_dir, "lineitem").select(src.alias("src"), dst.alias("dst")))


@query(f"+{POLICY_SQL} SELECT policy, n AS files FROM (SELECT 'typed' AS policy, CAST(sum(CASE WHEN typed THEN 1 ELSE 0 END) AS BIGINT) AS n FROM p UNION ALL SELECT 'first', CAST(sum(CASE WHEN first THEN 1 ELSE 0 END) AS BIGINT) FROM p) WHERE n > 0", "files")
def a6_policy_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.policies_of(stand_in(spark, sf_dir, "files"), POLICIES).groupBy("policy").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT path, coalesce(w, b, 0) AS total, coalesce(m, 0) AS branch FROM (SELECT path, CASE WHEN file_id % 3 = 0 THEN max_func_branch * 2 END AS w, CASE WHEN file_id % 2 = 0 THEN in_degree END AS b, CASE WHEN file_id % 4 <> 0 THEN max_func_branch END AS m FROM files)", "files")
def f11_gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("file_id")
    df = stand_in(spark, sf_dir, "files").withColumns({"weighted_branch_total": F.when(k % 3 == 0, F.col("max_func_branch") * 2), "branch_count": F.when(k % 2 == 0, F.col("in_degree")), "max_func_branch": F.when(k % 4 != 0, F.col("max_func_branch"))})
    return scores.gate_metrics(df).select("path", scores.weighted_branch_total(F.col("weighted_branch_total"), F.col("branch_count")).alias("total"), scores.max_func_weighted_branch(F.col("max_func_branch")).alias("branch"))


@query("SELECT path, 'a' AS asset FROM files WHERE path LIKE 'pkg1/%' AND path LIKE '%.ts' UNION ALL SELECT path, 'b.ts' FROM files WHERE path LIKE '%/__tests__/%'", "files")
def f18_capability_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.validation import capability_drift

    changed = stand_in(spark, sf_dir, "files").select("path").unionByName(spark.createDataFrame([("c.ts",)], "path string"))
    return capability_drift(changed, [("a", "pkg1/**/*.ts"), ("b.ts", "**/__tests__/**"), ("b.ts", "nothing/**"), ("c.ts", "**/*.go")])


@query("SELECT p_partkey AS id, p_partkey % 5 AS a FROM part WHERE p_partkey % 4 <> 3 AND NOT (p_partkey % 4 = 1 AND p_partkey % 3 <> 0)")
def x1_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose two sets meet in more than nothing, and whose first holds the second's evens."""
    k = F.col("p_partkey")
    left, right = F.array(k % 4, k % 3 + 10), F.when(k % 4 == 1, F.array(F.lit(10))).when(k % 4 == 3, F.array(F.lit(99))).otherwise(F.array(k % 4))
    return own(spark, sf_dir, "part").where((F.size(mining.intersect(left, right)) > 0) & mining.contains_all(left, right)).select(k.alias("id"), (k % 5).alias("a"))


SOURCES = {
    "typescript": "import {{ a }} from './m{k}'; export * from 'y';\nexport function f{k}(x: number) {{ if (x) {{ return g(); }} switch (x) {{ case 1: h(); break; default: h(); }} }}\nconst z = (y) => {{ if (y) {{ g(); }} else if (!y) {{ g('if'); }} }};\n",
    "go": 'package m\nimport ("fmt"; "m/k{k}")\nfunc F{k}(x int) int {{ if x > 1 {{ return 0 }}; for {{ if x < 0 {{ g() }} }} }}\nfunc (t *T) own() {{ switch t.x {{ case 1: fmt.Println("switch") }} }}\n',
    "java": "import a.b.C{k};\npublic class A {{ public int m{k}(int x) throws E {{ if (x > 1) {{ throw new E(); }} // if (no)\n if (x > 2) {{ g(); }} return x; }} void n() {{ r(y -> {{ if (y) {{ g(); }} }}); }} }}\n",
    "rust": "use crate::m{k}::{{a, b}};\npub fn f{k}<'a>(x: &'a str) -> i32 {{ match x {{ \"if\" => 1, _ => {{ if x.len() > 1 {{ return 2; }} 3 }} }} }}\nfn g() {{ println!(\"{{}}\", 1); }}\n",
}
SOURCES_SQL = "(VALUES ('typescript', 6, 3.9, 2, 2, 2.0, 2, 'f#'), ('go', 4, 2.6, 1, 2, 1.3, 2, 'F#'), ('java', 3, 2.3, 1, 3, 1.3, 1, 'm#'), ('rust', 4, 1.9, 2, 2, 1.9, 2, 'f#'))"


@query(f"SELECT p_partkey AS id, language, n AS branches, w AS weighted, d AS nesting, f AS functions, m AS largest, i AS imports, replace(e, '#', CAST(p_partkey AS VARCHAR)) AS exports FROM part JOIN {SOURCES_SQL} v(language, n, w, d, f, m, i, e) ON language = (['typescript', 'go', 'java', 'rust'])[p_partkey % 4 + 1]")
def o41_brace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source for each part, in four languages in turn, with strings and comments that name what isn't there."""
    from ledgerline.functions import brace_facts

    k = F.col("p_partkey")
    files = own(spark, sf_dir, "part").select(k.cast("string").alias("path"), pick(k, *SOURCES).alias("language"), pick(k, *(v.format(k="#") for v in SOURCES.values())).alias("source"))
    facts = brace_facts.file_facts(files.select("path", "language", F.replace("source", F.lit("#"), F.col("path")).alias("content")))
    return facts.select(F.col("path").cast("long").alias("id"), "language", F.col("branch_count").alias("branches"), F.round("weighted_branch_total", 6).alias("weighted"), F.col("nesting_depth").alias("nesting"), F.col("function_count").alias("functions"), F.round("max_func_branch", 6).alias("largest"), F.size("imports").alias("imports"), F.array_join("exports", ",").alias("exports"))

"""More queries: staged rules, submissions and transitions, admissions, scopes. Registered with the others of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import joins, staged, testing, validation
from ledgerline.plans.catalog import query, stand_in
from ledgerline.plans.catalog_facts import own, pick, text
from ledgerline.sources import tables
from ledgerline.streaming import lifecycle

EMITTED = staged.Extraction("emitted", r"emit\('([a-z0-9]+)'\)", ("event",), ("typescript",))
HEARD = staged.Extraction("heard", r"on\('([a-z0-9]+)', (\w+)\)", ("event", "handler"))
UNHEARD = staged.StagedRule("unheard", "emit|on\\(", (EMITTED, HEARD), staged.Link("emitted", "heard", (("event", "event"),)), ("file-classification.v1",))
HEARD_RULE = staged.StagedRule("heard", "emit|on\\(", (EMITTED, HEARD), staged.Link("emitted", "heard", (("event", "event"),), "semi"), ("file-classification.v1",))
EVERY = staged.StagedRule("every", "on\\(", (HEARD,), None, ("file-classification.v1", "semantic-relations.v1"))

CODE_SQL = "c AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS ts, 'e' || p_partkey % 40 AS emits, CASE WHEN p_partkey % 2 = 0 THEN 'e' || p_size END AS hears FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part that emits one event on its second line, and hears another on its third or not."""
    k = F.col("p_partkey")
    content = F.concat(F.lit("x\n  emit('e"), (k % 40).cast("string"), F.lit("');\n"), F.when(k % 2 == 0, text("on('e", F.col("p_size"), "', run)")).otherwise("off()"))
    return own(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.when(k % 3 == 0, "typescript").otherwise("go").alias("language"), content.alias("content"))


@query(f"""WITH {CODE_SQL}, h AS (SELECT DISTINCT hears FROM c WHERE hears IS NOT NULL) SELECT CASE WHEN emits IN (SELECT hears FROM h) THEN 'heard' ELSE 'unheard' END AS rule, id, 2 AS line, emits AS event FROM c WHERE ts UNION ALL SELECT 'every', id, 3, hears FROM c WHERE hears IS NOT NULL""")
def u1_staged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, failed = staged.run_all([UNHEARD, HEARD_RULE, EVERY, staged.StagedRule("absent", "x", (HEARD,), None, ("change-surface.v1",))], sources(spark, sf_dir), ("file-classification.v1", "semantic-relations.v1"))
    if list(failed) != ["absent"]:
        raise AssertionError(failed)
    return found.select("rule", F.col("path").cast("long").alias("id"), "line", F.col("detail")["event"].alias("event"))


@query("SELECT p_partkey AS id, 'e' || p_size AS event FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0)")
def u5_change_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were without their handler, with another one, or as they are now."""
    k = F.col("path").cast("long")
    now = sources(spark, sf_dir)
    before = F.when(k % 4 == 0, F.regexp_replace("content", r"on\('e", "on('z")).when(k % 5 != 0, F.col("content"))
    return staged.run_on_changes(EVERY, now.select("path", "language", before.alias("before"), F.col("content").alias("after"))).select(F.col("path").cast("long").alias("id"), F.col("detail")["event"].alias("event"))


NAMES_SQL = repr(list(staged.CAPABILITIES))


@query(f"""WITH r AS (SELECT 'r' || p_partkey AS rule, ({NAMES_SQL})[p_partkey % 7 + 1] AS a, ({NAMES_SQL})[p_size % 7 + 1] AS b, p_partkey % 10 = 0 AS odd FROM part), e AS (SELECT rule, a AS fact FROM r UNION SELECT rule, b FROM r UNION SELECT rule, 'files' FROM r WHERE odd)
    SELECT fact, CAST(count(*) AS BIGINT) AS rules, min(rule) AS first, fact <> 'files' AS known FROM e GROUP BY fact""")
def u14_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part that requires one or two of the facts, or one that doesn't exist."""
    k = F.col("p_partkey")
    named = lambda i: pick(i, *staged.CAPABILITIES)
    rules = own(spark, sf_dir, "part").select(text("r", k).alias("rule"), F.array_compact(F.array(named(k), named(F.col("p_size")), F.when(k % 10 == 0, "files"))).alias("requires"))
    found = staged.consumer_table(rules)
    return found.select("fact", F.size("rules").cast("long").alias("rules"), F.get("rules", 0).alias("first"), "known")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def f15_rule_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.target_files(sources(spark, sf_dir), [staged.StagedRule("one", "emit", (EMITTED,))]).select(F.col("path").cast("long").alias("id"))


@query("SELECT l_returnflag AS provider, CASE WHEN count(*) = 0 THEN 'not_applicable' WHEN sum(CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END) = 0 THEN 'unsupported' WHEN sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) = 0 THEN 'unavailable' ELSE 'partial' END AS status FROM lineitem GROUP BY l_returnflag")
def a42_provider_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda most: F.count_if(F.col("l_linenumber") <= most)
    return own(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(testing.coverage_status(F.count(F.lit(1)), n(4), n(2), F.lit(0)).alias("status"))


@query("WITH s AS (SELECT CASE WHEN count(*) > 1 THEN 'partial' WHEN max(l_partkey) % 2 = 0 THEN 'available' ELSE 'unavailable' END AS a FROM lineitem GROUP BY l_orderkey, l_linenumber % 5) SELECT CASE WHEN bool_and(a = 'unavailable') THEN 'unavailable' WHEN bool_and(a = 'available') THEN 'available' ELSE 'partial' END AS availability, CAST(count(*) AS BIGINT) AS identities, CAST(sum(CASE WHEN a = 'partial' THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM s")
def a48_shadow_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own(spark, sf_dir, "lineitem").select(text(F.col("l_orderkey"), "-", F.col("l_linenumber") % 5).alias("identity"), F.when(F.col("l_partkey") % 2 == 0, "available").otherwise("unavailable").alias("availability"))
    each = validation.shadow_evidence(rows)
    return validation.overall(each).join(each.agg(F.count_if(F.col("availability") == "partial").alias("repeated")))


@query("""SELECT p_partkey AS id, CASE WHEN k = 6 THEN 'available' WHEN k = 0 THEN 'unavailable' ELSE 'partial' END AS admission, lacking FROM (SELECT p_partkey, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) + CAST(f AS INT) AS k, concat_ws(';', CASE WHEN NOT c THEN 'calibration' END, CASE WHEN NOT e THEN 'consumers' END, CASE WHEN NOT a THEN 'declaration' END, CASE WHEN NOT d THEN 'population' END, CASE WHEN NOT b THEN 'references' END, CASE WHEN NOT f THEN 'surface' END) AS lacking
    FROM (SELECT p_partkey, p_partkey % 2 = 0 AS a, p_partkey % 3 <> 1 AS b, p_partkey % 5 <> 1 AS c, p_partkey % 7 <> 1 AS d, p_size % 2 = 0 AS e, p_size % 3 <> 1 AS f FROM part))""")
def m16_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return validation.scope_admissions(own(spark, sf_dir, "part").select(k.alias("id"), (k % 2 == 0).alias("declaration"), (k % 3 != 1).alias("references"), (k % 5 != 1).alias("calibration"), (k % 7 != 1).alias("population"), (s % 2 == 0).alias("consumers"), (s % 3 != 1).alias("surface")))


@query("""SELECT o_orderkey AS task, CASE WHEN o_custkey % 7 = 0 THEN 'unknown_scope' WHEN o_orderkey % 11 = 0 THEN 'cycle' WHEN n IS NULL THEN 'verified' WHEN n = o_custkey % 3 THEN 'repeated' ELSE 'conflict' END AS answer FROM orders LEFT JOIN (SELECT l_orderkey AS k, arg_min(l_suppkey % 3, l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) ON k = o_orderkey""")
def t16_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = own(spark, sf_dir, "orders")
    proposals = o.select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 7).alias("scope"), (F.col("o_custkey") % 3).cast("string").alias("proposal_hash"))
    log = own(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("sequence")).agg((F.min("l_suppkey") % 3).cast("string").alias("proposal_hash"))
    scopes = spark.range(1, 7).select(F.col("id").alias("scope"))
    return lifecycle.submissions(proposals, log, scopes, o.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("task"))).select("task", "answer")


@query("""SELECT o_orderkey AS task, CASE WHEN NOT (s = 'verified' AND t = 'claimed' OR s = 'claimed' AND t = 'completed_local' OR s = 'completed_local' AND t = 'completed') THEN 'not_allowed' WHEN t = 'claimed' AND o_custkey % 2 = 0 THEN 'waiting' WHEN o_orderkey % 5 <> 0 AND o_custkey % 3 = 0 THEN t ELSE 'not_held' END AS answer
    FROM (SELECT *, (['verified', 'claimed', 'completed_local', 'completed'])[o_orderkey % 4 + 1] AS s, (['claimed', 'completed_local', 'completed'])[o_orderkey % 3 + 1] AS t FROM orders)""")
def t17_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = own(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    requests = o.select(k.alias("task"), pick(k, "claimed", "completed_local", "completed").alias("to"), (c % 3).cast("string").alias("owner"))
    status = o.select(k.alias("task"), pick(k, "verified", "claimed", "completed_local", "completed").alias("status"))
    leases = o.select(k.alias("target"), F.lit("0").alias("owner"), F.when(k % 5 == 0, F.lit("2024-01-01")).otherwise("2024-03-01").cast("timestamp").alias("expires_at"))
    return lifecycle.transitions(requests, status, o.select(k.alias("task"), (c % 2 != 0).alias("ready")), leases, F.lit("2024-02-01").cast("timestamp")).select("task", "answer")


@query("SELECT CAST(sum(CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(2 * sum(CASE WHEN user_id % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS entries, CAST(count(DISTINCT CASE WHEN user_id % 4 <> 0 THEN event_type END) AS BIGINT) AS rules FROM events")
def t14_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence taken in twice: the log holds both, the projection counts them."""
    log, projection = tables.step_path(spark, "log"), tables.step_path(spark, "projection")
    e = own(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"), "user_id")
    for _ in range(2):
        rejected = lifecycle.ingest(e, F.col("user_id") % 4 != 0, log, projection)
    return rejected.agg(F.count(F.lit(1)).alias("rejected")).join(spark.read.parquet(projection).agg(F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("rules")))


@query("SELECT path FROM files WHERE kind = 'test'", "files")
def z43_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.functions.paths import participates

    return stand_in(spark, sf_dir, "files").where(participates(F.col("kind"), "test-governance")).select("path").orderBy("path")


@query("SELECT file, after_start, block AS container FROM (SELECT h.*, p_partkey AS block, row_number() OVER (PARTITION BY file, after_start ORDER BY p_size, p_partkey) AS r FROM (SELECT DISTINCT l_orderkey % 10 AS file, l_partkey AS after_start FROM lineitem) h LEFT JOIN part ON file = p_size % 10 AND after_start BETWEEN p_partkey AND p_partkey + p_size) WHERE r = 1")
def z10_change_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = own(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("file"), F.col("l_partkey").alias("after_start")).distinct()
    declarations = own(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("long").alias("file"), F.col("p_partkey").alias("name"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    return joins.change_containers(hunks, declarations).select("file", "after_start", "container")


@query("SELECT 'a' AS scope_id, doc_id, source FROM documents UNION ALL SELECT 'b', conv_id, NULL FROM conversations")
def s39_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = [("a", own(spark, sf_dir, "documents").select("doc_id", "source")), ("b", own(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")))]
    return joins.union_scopes(stores)


@query("SELECT 'active' AS role, true AS whole UNION ALL SELECT 'backup', true UNION ALL SELECT 'left', true")
def z6_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tables.step_path(spark, "generations")
    for n in (1, 2, 3):
        tables.publish(own(spark, sf_dir, "nation").select((F.col("n_nationkey") * n).alias("path")), root, "path")
    return tables.inspect_generations(spark, root).select("role", "whole")

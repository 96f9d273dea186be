"""More queries: rule texts, states, checks, selections, logs, snapshots. Registered with the others of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import graphs, joins, mining, rules, scores, validation
from ledgerline.plans.catalog import LOG_SQL, log, query, r6, stand_in
from ledgerline.plans.catalog_facts import own, pick, text
from ledgerline.sources import files as file_sources
from ledgerline.sources import tables
from ledgerline.streaming import lifecycle

# -- rule texts ---------------------------------------------------------------------------------------

#: Conditions with a number of their own (#), and what they name: metrics, unknown and unsupported names, thresholds.
CONDITIONS = (
    ("crl_local > 0.# && max_func_branch >= 2#", "crl_local,max_func_branch", "", "", "crl_local>0.#,max_func_branch>=2#"),
    ("loc > 100 || 3# < max_func_branch", "loc,max_func_branch", "", "loc", "max_func_branch>3#"),
    ('language == "go > #" && exposure >= 0.#', "exposure", "", "", "exposure>=0.#"),
    ("zeta > # && path_class != 'crl_state'", "", "zeta", "zeta", ""),
    ("crl_state == 'x' || cohesion < 0.# && zeta#", "cohesion", "zeta#", "cohesion,crl_state,zeta#", ""),
)
CONDITIONS_SQL = "(VALUES " + ", ".join("(" + ", ".join([str(i), *("'" + x.replace("'", "''") + "'" for x in c)]) + ")" for i, c in enumerate(CONDITIONS)) + ") v(k, condition, metrics, unknown, unsupported, thresholds)"


@query("SELECT p_partkey AS id, " + ", ".join(f"replace({c}, '#', CAST(p_size % 9 + 1 AS VARCHAR)) AS {c}" for c in ("condition", "metrics", "unknown", "unsupported", "thresholds")) + f" FROM part JOIN {CONDITIONS_SQL} ON k = p_partkey % 5")
def p5_condition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition for each part."""
    k = F.col("p_partkey")
    conditions = own(spark, sf_dir, "part").select(k.alias("id"), F.replace(pick(k, *(c for c, *_ in CONDITIONS)), F.lit("#"), (F.col("p_size") % 9 + 1).cast("string")).alias("condition"))
    found = rules.condition_facts(conditions)
    return found.select("id", "condition", *(F.array_join(c, ",").alias(c) for c in ("metrics", "unknown", "unsupported", "thresholds")))


@query("""WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS x, (['', '7', 'go', NULL])[p_partkey % 4 + 1] AS t FROM part), n AS (SELECT *, CASE WHEN isnan(x) THEN NULL ELSE x END AS y, CASE WHEN t = '' THEN 0 ELSE TRY_CAST(t AS DOUBLE) END AS w FROM v)
    SELECT id, coalesce(y > 20, false) AS a, coalesce(y = y, false) OR x IS NULL AS b, NOT (coalesce(y = y, false) OR x IS NULL) AS c, coalesce(w = 0, false) AS d, coalesce(w < 8, false) AS e, coalesce(t = 'go', false) AS f, coalesce(t <> '', false) AS g, coalesce(y <> 0, false) AS h, coalesce(y > 20, false) AND coalesce(w < 8, false) OR coalesce(t = 'go', false) AS i FROM n""")
def p3_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are missing or none, and texts that are blank, numbers or neither."""
    k = F.col("p_partkey")
    names = {"exposure": F.when(k % 7 == 0, float("nan")).when(k % 5 != 0, F.col("p_size").cast("double")), "language": pick(k, "", "7", "go", None)}
    made = {"a": "exposure > 20 ", "b": "exposure == exposure", "c": "exposure != exposure", "d": "language == 0 ", "e": "language < 8 ", "f": 'language == "go"', "g": "language", "h": "exposure", "i": '(exposure > 20 ) && (language < 8 ) || language == "go"'}
    return own(spark, sf_dir, "part").select(k.alias("id"), *(rules.compile_condition(c, names).alias(n) for n, c in made.items()))


@query("SELECT l_orderkey AS id, CAST(max(l_linenumber % 4) AS INT) AS code FROM lineitem GROUP BY l_orderkey")
def p16_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rules.combined_exit(F.col("l_linenumber") % 4).alias("code"))


# -- checks -------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'id' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'value' WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'exposed' WHEN event_type <> 'click' AND event_id % 2 = 0 THEN 'reason' END AS wrong FROM events WHERE event_id % 11 = 0 OR event_type = 'click' AND event_id % 3 = 0 OR event_type = 'error' AND event_id % 3 <> 0 OR event_type <> 'click' AND event_id % 2 = 0""")
def z15_invalid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    state = F.when(F.col("event_type") == "click", "available").when(F.col("event_type") == "error", "unavailable").otherwise("partial")
    facts = own(spark, sf_dir, "events").select("event_id", F.when(k % 11 == 0, " ").otherwise(k.cast("string")).alias("id"), state.alias("availability"), F.when(k % 3 != 0, F.col("value")).alias("value"), F.when(k % 2 != 0, "because").alias("reason"))
    return validation.invalid_facts(facts).select("event_id", "wrong")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'policy_id' WHEN p_partkey % 5 = 0 THEN 'action' ELSE 'subject' END AS wrong FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 3 = 2 OR p_partkey % 4 = 0")
def z16_invalid_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = own(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 7 != 0, "p").alias("policy_id"), F.when(k % 5 == 0, "log").otherwise(pick(k, "report", "warn", "block")).alias("action"), pick(k, "metric", "finding", "signal").alias("subject_kind"), F.when(k % 4 == 0, "").otherwise("s").alias("subject_id"))
    return validation.invalid_projections(p).select("id", "wrong")


@query("""SELECT o_orderkey AS id, (['names', 'identifiers', 'languages', 'times', 'window', 'counts', 'counts'])[o_orderkey % 9 + 1] AS wrong FROM orders WHERE o_orderkey % 9 < 7""")
def z17_invalid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 9
    d = F.col("o_orderdate")
    e = own(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, " ").otherwise("p").alias("project"), F.lit("prov:1").alias("provider"), F.when(k == 1, "-bad").otherwise("rule.a@1").alias("rule_id"), F.lit("a").alias("authority_id"),
        F.when(k == 2, F.array(F.lit(""))).otherwise(F.array(F.lit("go"))).alias("languages"), F.when(k != 3, d).alias("observed_at"), d.alias("started_at"), F.when(k == 4, d - F.expr("INTERVAL 1 DAY")).otherwise(d).alias("ended_at"),
        F.when(k == 5, -1.0).otherwise(2.0).alias("findings"), F.when(k == 6, 0.5).otherwise(0.0).alias("false_positives"), F.lit(0.0).alias("false_negatives"))
    return validation.invalid_evidence(e).select("id", "wrong")


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS same, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS gate FROM part")
def z18_same_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    profile = lambda n: F.struct(F.lit("s").alias("scope"), F.when(k % 5 != 0, "v1").alias("contract"), (k % n).alias("population"), F.lit("baseline").alias("source"))
    left = profile(7)
    right = F.struct(left["scope"].alias("scope"), left["contract"].alias("contract"), F.when(k % 2 == 0, left["population"]).otherwise(99).alias("population"), F.when(k % 3 == 0, "other").otherwise("baseline").alias("source"))
    return own(spark, sf_dir, "part").select(k.alias("id"), validation.same_population(left, right).alias("same"), validation.gate_profile(F.when(k % 4 == 0, F.col("p_brand")), F.col("p_type")).alias("gate"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'missing_index' WHEN p_partkey % 7 = 0 THEN 'scope' WHEN p_partkey % 5 = 0 THEN 'shapes' WHEN p_partkey % 3 = 0 THEN 'snapshot' WHEN p_partkey % 2 = 0 THEN 'contract' END AS reason FROM part")
def m17_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    df = own(spark, sf_dir, "part").select(k.alias("id"), (k % 11 != 0).alias("has_index"))
    for name, n in (("scope", 7), ("shapes", 5), ("snapshot", 3), ("contract", 2)):
        df = df.withColumns({name: F.when(F.col("id") % n == 0, "old"), f"expected_{name}": F.lit(None).cast("string")})
    return validation.baseline_compatibility(df).select("id", "reason")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AS current, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'z' END AS previous, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END ELSE 'g' END AS gate FROM part")
def w4_next_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    state = own(spark, sf_dir, "part").select(k.alias("id"), F.lit("a").alias("current"), F.lit("z").alias("previous"), F.when(k % 5 != 0, "g").alias("gate"))
    return validation.next_calibration(state, F.when(F.col("id") % 3 == 0, "b").otherwise("a"), F.col("id") % 2 == 0)


@query("SELECT l_orderkey AS id, l_linenumber AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') OR l_partkey % 7 = 3")
def f14_selected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("domain"), (F.col("l_partkey") % 7).cast("string").alias("id"))
    return validation.select_facts(li, ["A", "R"], ["3"]).select(F.col("order").alias("id"), "n")


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def f24_orphaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.orphaned(own(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), own(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("path")))


@query("SELECT p_partkey AS name, p_brand AS language FROM part WHERE p_size % 2 = 0 AND CAST(substr(p_brand, 7) AS INT) % 3 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def f25_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("language"), F.when(F.col("p_size") % 2 == 0, "internal").otherwise("public").alias("surface"))
    coverage = p.select("language").distinct().withColumn("coverage", F.when(F.substring("language", 7, 9).cast("int") % 3 == 0, "partial").otherwise("complete"))
    return validation.unreferenced(p, own(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("name")), coverage).select("name", "language")


@query("SELECT 'BLOCK' AS quality, CAST((SELECT count(*) FROM events) AS BIGINT) AS hits, CAST((SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) AS BIGINT) AS missing UNION ALL SELECT 'WARN', CAST((SELECT count(*) FROM events) AS BIGINT), 0")
def z53_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = own(spark, sf_dir, "events").select(F.col("event_type").alias("source"))
    levels = spark.createDataFrame([("click", "warn"), ("view", "pass")], "source string, level string")
    rule = own(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule"))
    return validation.hygiene(hits, levels, rule, rule, rule.where("rule % 10 = 0")).unionByName(validation.hygiene(hits, levels, rule, rule, rule.limit(0)))


# -- scores, history ------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS id, l_linenumber AS n, round(CASE WHEN reasons = '' THEN 10 * l_discount * log2(refs + 1) * (1 + l_tax) END, 6) AS impact, round(CASE WHEN reasons = '' AND l_linenumber <> 2 THEN 10 * l_discount * log2(stat + 1) * (1 + l_tax) END, 6) AS comparable, reasons FROM (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 2 END AS refs, CASE WHEN l_partkey % 2 = l_orderkey % 2 THEN 0 ELSE 1 END AS stat,
    concat_ws(',', CASE WHEN l_linenumber = 7 THEN 'alpha' END, CASE WHEN l_partkey % 9 = 0 THEN 'not_eligible' END, CASE WHEN l_partkey % 8 = 0 THEN 'unknown_surface' END, CASE WHEN l_returnflag = 'R' THEN 'incomplete' END) AS reasons FROM lineitem)""")
def m5_symbol_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    file = o.cast("string")
    refs = F.when(s % 4 == 0, F.array(F.lit("x"), F.lit("x"), file)).otherwise(F.array(F.lit("x"), F.lit("y"), file))
    df = own(spark, sf_dir, "lineitem").select(
        o.alias("id"), F.col("l_linenumber").alias("n"), file.alias("file"), F.lit("function_body").alias("change_kind"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_discount")).alias("alpha_struct"), (1 + F.col("l_tax")).alias("layer_weight"),
        refs.alias("references"), F.when(F.col("l_linenumber") != 2, F.when(p % 2 == o % 2, F.array(file)).otherwise(F.array(F.lit("z")))).alias("static_consumers"), (p % 9 != 0).alias("eligible"), F.lit(True).alias("same_population"),
        F.when(p % 8 == 0, "unknown").otherwise("internal").alias("public_surface"), F.lit("complete").alias("declarations_coverage"), F.when(F.col("l_returnflag") == "R", "partial").otherwise("complete").alias("references_coverage"))
    return scores.symbol_scope(df).select("id", "n", F.round("symbol_scope_impact", 6).alias("impact"), F.round("static_comparable_impact", 6).alias("comparable"), F.array_join("reasons", ",").alias("reasons"))


@query("SELECT l_orderkey AS file, CAST(d AS DOUBLE) AS delta_i FROM (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 3 ELSE -(l_partkey % 3) END) AS d FROM lineitem GROUP BY l_orderkey) WHERE d <> 0 AND l_orderkey % 13 <> 0")
def k7_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_partkey") % 3
    sums = own(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.sum(F.when(F.col("l_linenumber") % 2 == 0, d).otherwise(-d)).cast("double").alias("delta_i"))
    return scores.sorted_deltas(sums.withColumn("delta_i", F.when(F.col("file") % 26 == 0, float("nan")).when(F.col("file") % 13 == 0, float("inf")).otherwise(F.col("delta_i"))))


@query("SELECT event_id, CAST(epoch_us(date_trunc('day', ts - INTERVAL 25 DAYS)) AS BIGINT) AS cutoff FROM events")
def a18_retention_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, "events").select("event_id", F.unix_micros(scores.retention_cutoff(F.col("ts"), 25)).alias("cutoff"))


@query("SELECT l_orderkey AS entry_id, round(sum(d), 6) AS i_push, CAST(sum(CASE WHEN d <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS file_count, 1.0 AS weight FROM (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_quantity END AS d FROM lineitem) GROUP BY l_orderkey")
def a20_history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.when(F.col("l_partkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity")).alias("delta_i"))
    return scores.history_facts(h).select("entry_id", r6("i_push"), "file_count", "weight")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CASE WHEN count(*) > 5000 THEN 3 ELSE 5 END AS depth FROM part")
def g2_reach_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = own(spark, sf_dir, "part").count()
    return spark.createDataFrame([(n, graphs.reach_depth(n))], "files long, depth int")


# -- graphs, evolution, selection -----------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, (o_orderkey * 7 + 3) % (SELECT count(*) FROM orders) AS b FROM orders WHERE o_orderkey % 3 <> 0), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a FROM r WHERE a = b) SELECT DISTINCT a AS task FROM (SELECT a FROM c UNION ALL SELECT r.a FROM r WHERE r.b IN (SELECT a FROM c))""")
def g13_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task that isn't a multiple of three depends on one other."""
    n = own(spark, sf_dir, "orders").count()
    k = F.col("o_orderkey")
    return graphs.cyclic(own(spark, sf_dir, "orders").select(k.alias("task"), F.when(k % 3 != 0, (k * 7 + 3) % n).alias("depends_on")))


@query("""+e AS (SELECT DISTINCT src, dst FROM imports), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), b AS (SELECT src AS s, dst AS t FROM e UNION SELECT dst, src FROM e), x AS (WITH RECURSIVE cc(node, component) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT b.t, min(cc.component) FROM cc JOIN b ON b.s = cc.node JOIN recurring.cc r ON r.node = b.t WHERE cc.component < r.component GROUP BY b.t) SELECT node, component FROM cc) SELECT node, component FROM x""", "imports")
def g6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stand_in(spark, sf_dir, "imports")
    return graphs.components(edges, edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 60 AS c FROM lineitem WHERE l_returnflag = 'N'), a AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 90 AS x FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT m.id, c, x FROM m JOIN a USING (id) WHERE (c + x) % 7 = 0), f AS (SELECT *, x % 50 AS loc, x % 13 AS d, (x % 9) / 10.0 AS al FROM r)
    SELECT c AS coordinator, CAST(count(DISTINCT x) AS BIGINT) AS members, CAST(count(DISTINCT id) AS BIGINT) AS commits, CAST(count(*) AS BIGINT) AS events, round(avg(loc), 6) AS average_loc, max(d) AS max_in_degree FROM f GROUP BY c HAVING count(DISTINCT x) >= 2 AND count(DISTINCT id) >= 2 AND avg(loc) > 0""")
def a34_coordinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_returnflag")
    changes = li.where("l_returnflag = 'N'").select("id", (F.col("l_partkey") % 60).alias("path"), F.lit("modified").alias("kind")).unionByName(li.where("l_returnflag = 'A'").select("id", (F.col("l_partkey") % 90 + 1000).alias("path"), F.lit("added").alias("kind")))
    imports = spark.range(60).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))).alias("x")).where("(src + x) % 7 = 0").select("src", (F.col("x") + 1000).alias("dst"))
    facts = spark.range(90).select((F.col("id") + 1000).alias("path"), (F.col("id") % 50).alias("loc"), (F.col("id") % 13).alias("in_degree"), (F.col("id") % 9 / 10).alias("alpha_struct"))
    return mining.coordinators(mining.extensions(changes, imports), facts).select("coordinator", "members", "commits", "events", r6("average_loc"), "max_in_degree")


@query("""WITH c AS (SELECT o_orderkey AS candidate, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), f AS (SELECT * FROM c WHERE rank <= 3), m AS (SELECT candidate, rank, l_linenumber AS id, row_number() OVER (PARTITION BY candidate ORDER BY l_linenumber) AS r FROM f JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = candidate) SELECT candidate, id FROM (SELECT *, row_number() OVER (ORDER BY rank, id) AS n FROM m WHERE r <= 3) WHERE n <= 5""")
def k4_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates' first commits, five in all; the numbers are the report's."""
    best = own(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")
    ranked = best.select(F.col("o_orderkey").alias("candidate"), F.struct(-F.col("o_totalprice"), F.col("o_orderkey")).alias("rank"))
    commits = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("position")).distinct()
    return mining.enrichment_plan(ranked, commits, 3, 3, 5)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 < 3 OR p_size % 2 = 0")
def k6_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return mining.corroborated(own(spark, sf_dir, "part").select(k.alias("id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("files"), (k % 4).alias("components"), F.when(F.col("p_size") % 2 == 1, "mixed").otherwise("aligned").alias("evidence"))).select("id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS wave FROM events), w AS (SELECT wave, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r GROUP BY wave), j AS (SELECT r.*, n, 400 - b AS l, row_number() OVER (PARTITION BY r.wave ORDER BY user_id) - 1 AS i FROM r JOIN w USING (wave) WHERE b < 400)
    SELECT user_id, event_id, CAST(wave AS INT) AS wave FROM j WHERE n <= l OR ceil((i + 1) * l / n - 0.5) > ceil(i * l / n - 0.5)""")
def k5_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hundred events, in waves over the users; the budget is the operator's."""
    return mining.by_key_waves(own(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 400)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE ceil((i + 1) * 77 / n - 0.5) > ceil(i * 77 / n - 0.5)")
def z61_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy-seven events, spaced evenly; the budget is the operator's."""
    return mining.evenly_sampled(own(spark, sf_dir, "events").select("event_id"), "event_id", 77)


@query("SELECT l_orderkey AS id, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (WHERE k = 0), '') AS files, CAST(count(DISTINCT CASE WHEN k IS NULL THEN p END) AS BIGINT) AS unknown FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS p, p_size % 2 AS k FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 <> 0) GROUP BY l_orderkey")
def z33_production_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = own(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") % 2 == 1, "test").alias("kind"))
    return mining.production_files(own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("path")), facts).select("id", F.array_join("files", ",").alias("files"), "unknown")


@query("SELECT id, string_agg(p, ',' ORDER BY p) AS files FROM (SELECT DISTINCT l_orderkey AS id, 'm' || l_partkey % 30 AS p FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey % 3 = 0 AND l_partkey % 30 NOT IN (4, 14, 24)) GROUP BY id HAVING bool_or(p = 'm7')")
def z32_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = own(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), text("m", F.col("l_partkey") % 30).alias("path"), F.when(F.col("l_returnflag") == "A", "added").otherwise("modified").alias("kind"))
    forwarding = spark.range(30).select(text("m", F.col("id")).alias("path"), F.when(F.col("id") % 10 == 4, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("imports"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).alias("reexports"))
    forwarding = forwarding.where(mining.forwards_only(F.col("imports"), F.col("reexports")))
    return mining.projected_changes(li, li.where("id % 3 = 0"), forwarding, "m7").select("id", F.array_join("files", ",").alias("files"))


@query("SELECT DISTINCT l_orderkey % 100 AS src, l_partkey % 100 AS dst, l_returnflag AS relation FROM lineitem")
def x7_unique_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.unique_facts(own(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linenumber").alias("line")), ["src", "dst", "relation"])


@query("SELECT a, b, arg_max(d, (t, d)) AS disposition FROM (SELECT least(l_orderkey % 90, l_partkey % 90) AS a, greatest(l_orderkey % 90, l_partkey % 90) AS b, l_returnflag AS d, l_suppkey AS t FROM lineitem) GROUP BY a, b")
def s38_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = own(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 90).alias("left"), (F.col("l_partkey") % 90).alias("right"), F.col("l_returnflag").alias("disposition"), F.col("l_suppkey").alias("at"))
    return joins.latest_dispositions(records).select("a", "b", "disposition")


# -- snapshots, logs ------------------------------------------------------------------------------------


@query("""SELECT sha256('[' || string_agg('{"chunk":"' || chunk || '","part":"' || part || '"}', ',' ORDER BY chunk) || ']') AS snapshot_sha256 FROM (SELECT chunk, sha256('[' || string_agg('{"path":"' || path || '","hash":"' || hash || '"}', ',' ORDER BY path) || ']') AS part FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS chunk FROM documents) GROUP BY chunk)""")
def s5_source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sources.source_snapshot(own(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash")))


@query("""SELECT sha256('key|[' || string_agg('{"chunk":"' || chunk || '","part":"' || part || '"}', ',' ORDER BY chunk) || ']') AS snapshot_id FROM (SELECT chunk, sha256('[' || string_agg('{"h":"' || h || '","n":' || n || '}', ',' ORDER BY h) || ']') AS part FROM (SELECT h, substr(h, 1, 3) AS chunk, count(*) AS n FROM (SELECT sha256('{"p_brand":"' || p_brand || '","p_size":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}') AS h FROM part) GROUP BY h) GROUP BY chunk)""")
def z1_snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("p_size"), F.lit("now").alias("scanned"))
    return tables.snapshot_id(p, "key", exclude=("scanned",))


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part")
def s14_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published, published again as it is, and then with other rows: what is read is the last generation."""
    root = tables.step_path(spark, "generations")
    first = own(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    one = tables.publish(first, root, "path")
    if tables.publish(first.orderBy(F.desc("path")), root, "path") != one:
        raise AssertionError("equal rows made another generation")
    tables.publish(first.withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))), root, "path")
    return tables.read_generation(spark, root)


@query("SELECT 'r' || user_id AS repository, event_type AS provider, CAST(event_id AS BIGINT) AS findings, CAST(epoch_us(ts) // 1000 AS BIGINT) AS observed_ms FROM events")
def s31_evidence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.step_path(spark, "evidence")
    e = own(spark, sf_dir, "events").select(text("r", F.col("user_id")).alias("repository"), F.col("event_type").alias("provider"), F.lit("1").alias("provider_version"), F.lit("rule").alias("rule_id"), F.col("event_id").alias("findings"), F.lit("pass").alias("verdict"), F.lit("p").alias("project"), F.col("ts").cast("timestamp").alias("observed_at"))
    file_sources.replace_evidence(e, path)
    return file_sources.evidence_log(spark, path).select("repository", "provider", "findings", F.unix_millis("observed_at").alias("observed_ms"))


@query(f"WITH {LOG_SQL} SELECT task, sequence, sha256(length(CAST(task AS VARCHAR)) || ':' || task || '|' || length(CAST(sequence AS VARCHAR)) || ':' || sequence || '|' || coalesce(length(t) || ':' || t, '-')) AS hash FROM (SELECT *, CASE WHEN sequence % 4 <> 0 THEN type END AS t FROM log)")
def t5_event_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).withColumn("type", F.when(F.col("sequence") % 4 != 0, F.col("type")))
    return e.select("task", "sequence", lifecycle.event_hash("task", "sequence", "type").alias("hash"))


@query(f"WITH {LOG_SQL} SELECT c_custkey AS task, CAST(coalesce(n, 0) + 1 AS BIGINT) AS sequence, coalesce(h, repeat('0', 64)) AS prev_event_hash FROM customer LEFT JOIN (SELECT task, max(sequence) AS n, arg_max(sha256(type), sequence) AS h FROM log GROUP BY task) ON task = c_custkey")
def t4_linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.link_events(log(spark, sf_dir).withColumn("event_hash", F.sha2("type", 256)), own(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")))


@query(f"WITH {LOG_SQL} SELECT task, CAST(count(*) AS BIGINT) AS events, arg_max(type, sequence) AS status FROM log GROUP BY task")
def t15_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.step_path(spark, "projection")
    lifecycle.refresh_projection(log(spark, sf_dir), path)
    return spark.read.parquet(path)


LEASE_SQL = """q AS (SELECT user_id AS target, event_id AS request_id, CAST(epoch_us(ts) AS BIGINT) AS now, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    f(target, n, request_id, token, expires, answer) AS (SELECT target, n, request_id, 1, now + 86400000000, 'acquired' FROM q WHERE n = 1 UNION ALL SELECT q.target, q.n, q.request_id, CASE WHEN q.now >= f.expires THEN f.token + 1 ELSE f.token END, CASE WHEN q.now >= f.expires THEN q.now + 86400000000 ELSE f.expires END, CASE WHEN q.now >= f.expires THEN 'acquired' ELSE 'held' END FROM f JOIN q ON q.target = f.target AND q.n = f.n + 1)"""


@query(f"WITH RECURSIVE {LEASE_SQL} SELECT target, request_id, answer, CAST(token AS BIGINT) AS token FROM f")
def t6_acquired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for its user's lease, which runs a day: fencing tokens only grow."""
    e = own(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("target"), F.col("event_id").cast("string").alias("request_id"), F.lit("acquire").alias("action"), F.lit("o").alias("owner"), F.lit(0).cast("long").alias("token"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), F.lit(86_400_000_000).alias("ttl"), F.col("event_id").alias("position"))
    out = lifecycle.lease_answers(e, "position")
    return out.select(F.col("target").cast("long").alias("target"), F.col("request_id").cast("long").alias("request_id"), "answer", "token")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'cold' END AS before FROM supplier")
def z12_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), validation.first_known(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")), F.lit("cold")).alias("before"))


@query("SELECT p_brand AS brand, id FROM (SELECT p_brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 2")
def z58_top_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest of each brand; the number is the report's."""
    from ledgerline.operators.similarity import top_by

    return top_by(own(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_size"), "brand", [F.desc("p_size"), F.col("id")], 2).select("brand", "id")


"""Coverage, sections and attribution over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import js_round
from tracemill.operators import attribution, coverage, sections
from tracemill.plans.bindings import EVENTS, events, r, table
from tracemill.plans.registry import query

_RES = """rp AS (SELECT o_custkey AS task_id, o_orderkey AS k, o_orderpriority AS priority, o_custkey % 10 = 0 AS held_out, o_orderstatus = 'P' AS excluded,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN [o_orderkey, o_orderkey + 1] ELSE [o_orderkey] END AS ids FROM orders), known AS (SELECT list(o_orderkey) AS ks FROM orders WHERE o_orderkey % 4 <> 0),
m AS (SELECT DISTINCT k FROM (SELECT k, unnest(ids) AS id FROM rp) u WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0)),
b AS (SELECT rp.*, CASE WHEN held_out THEN 'heldOutExcluded' WHEN excluded THEN 'excluded' WHEN ids IS NULL THEN 'noSession' WHEN m.k IS NOT NULL THEN 'unresolved' ELSE 'valid' END AS bucket FROM rp LEFT JOIN m USING (k))"""


@query(f"""WITH {_RES} SELECT priority, count(*) AS n_raw, count(*) FILTER (WHERE bucket = 'valid') AS n_coverage_valid, count(*) FILTER (WHERE bucket = 'excluded') AS n_excluded, count(*) FILTER (WHERE bucket = 'heldOutExcluded') AS held_out_excluded,
  count(*) FILTER (WHERE bucket = 'noSession') AS no_session, count(*) FILTER (WHERE bucket = 'unresolved') AS n_unresolved FROM b GROUP BY ALL""")
def x1_resolve_reps(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    ids = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat(k.cast("string"), F.lit(" , "), (k + 1).cast("string"))).otherwise(k.cast("string"))
    rp = o.select(F.col("o_custkey").alias("task_id"), k.alias("repeat"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 10 == 0).alias("held_out"), (F.col("o_orderstatus") == "P").alias("excluded"), ids.alias("run_ids"))
    runs = o.filter(k % 4 != 0).select(k.cast("string").alias("run_id"))
    return coverage.bucket_counts(coverage.resolve_reps(rp, runs), ["priority"])


@query(f"""WITH {EVENTS}, t AS (SELECT user_id AS case_id, event_type AS skill, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_primary FROM ev)
SELECT skill, count(DISTINCT case_id) AS cases, count(DISTINCT CASE WHEN is_primary THEN case_id END) AS primary_cases, count(DISTINCT case_id) - count(DISTINCT CASE WHEN is_primary THEN case_id END) AS auxiliary FROM t GROUP BY ALL""")
def x2_ever_triggered(spark, sf):
    first = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    return coverage.ever_triggered(table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("skill"), first.alias("is_primary")))


@query("SELECT c_mktsegment AS skill, CAST(sum(t) AS BIGINT) AS triggered, CAST(sum(a) AS BIGINT) AS attempted FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS t, count(*) AS a FROM orders GROUP BY ALL) o JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def x3_trigger_rate(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("triggered"), F.count("*").alias("attempted"))
    return coverage.trigger_rate(o.join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("expected_skill")), "c_custkey"))


@query("""WITH t AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS skill FROM lineitem WHERE l_quantity > 48), g AS (SELECT CAST(p_partkey AS VARCHAR) AS skill FROM part WHERE p_size > 25)
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS skill, CASE WHEN CAST(p_partkey AS VARCHAR) IN (SELECT skill FROM g) THEN 'neverTriggered' ELSE 'notExercised' END AS status FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT skill FROM t)""")
def x4_untriggered(spark, sf):
    p = table(spark, sf, "part")
    name = F.col("p_partkey").cast("string")
    t = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").cast("string").alias("skill"))
    return coverage.untriggered(p.select(name.alias("skill")), t, p.filter("p_size > 25").select(name.alias("expected_skill")))


_PRI = "CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"


@query(f"""WITH c AS (SELECT c_custkey AS case_id, {_PRI} AS skill FROM customer), o AS (SELECT o_custkey AS case_id, list(DISTINCT o_orderpriority) AS fired, count(*) AS attempted FROM orders GROUP BY ALL),
t AS (SELECT o_custkey AS case_id, o_orderpriority AS skill, count(*) AS triggered FROM orders GROUP BY ALL)
SELECT c.case_id, c.skill, coalesce(attempted, 0) AS attempted, coalesce(triggered, 0) AS triggered, CASE WHEN coalesce(triggered, 0) = 0 THEN array_to_string(list_sort(list_filter(fired, lambda x: x <> c.skill)), ',') END AS fired_instead, coalesce(triggered, 0) = 0 AS missed
FROM c LEFT JOIN o USING (case_id) LEFT JOIN t ON t.case_id = c.case_id AND t.skill = c.skill""")
def x5_case_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.expr(_PRI).alias("expected_skill"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("skill"))
    a = o.groupBy("case_id").agg(F.count("*").alias("attempted"))
    t = o.groupBy("case_id", F.col("skill").alias("expected_skill")).agg(F.count("*").alias("triggered"))
    tasks = c.join(a, "case_id", "left").join(t, ["case_id", "expected_skill"], "left")
    return coverage.case_join(tasks, o.distinct()).withColumn("fired_instead", F.array_join("fired_instead", ","))


_REF = """lp AS (SELECT l_orderkey AS run_id, o_custkey AS case_id, p_brand AS skill, CASE WHEN p_partkey % 9 = 0 THEN '_shared/' ELSE '' END || CAST(p_partkey AS VARCHAR) AS ref, l_quantity AS q, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
inv AS (SELECT p_brand AS skill, CASE WHEN p_partkey % 9 = 0 THEN '_shared/' ELSE '' END || CAST(p_partkey AS VARCHAR) AS ref, p_size AS bytes FROM part),
rd AS (SELECT * FROM lp WHERE q <= 3), ar AS (SELECT DISTINCT ref FROM lp WHERE q = 50), er AS (SELECT DISTINCT ref FROM lp WHERE q = 49), tr AS (SELECT DISTINCT case_id, skill FROM lp WHERE f = 'R' AND skill <> 'Brand#11'),
cnt AS (SELECT ref, count(DISTINCT run_id) AS rr, count(DISTINCT case_id) AS rc FROM rd GROUP BY ALL), co AS (SELECT skill, ref, count(*) AS n FROM tr JOIN (SELECT DISTINCT case_id, ref FROM rd) x USING (case_id) GROUP BY ALL),
cov AS (SELECT inv.skill, inv.ref, CASE WHEN inv.ref NOT LIKE '\\_shared/%' ESCAPE '\\' THEN bytes END AS bytes, CASE WHEN inv.ref LIKE '\\_shared/%' ESCAPE '\\' THEN 'shared-hash-namespace' END AS reason, coalesce(rr, 0) AS reads_runs, coalesce(rc, 0) AS reads_cases, coalesce(co.n, 0) AS cases_co_triggered,
  rr IS NULL AND ar.ref IS NOT NULL AS blocked, rr IS NULL AND ar.ref IS NULL AND er.ref IS NOT NULL AS excluded_only, inv.skill NOT IN (SELECT skill FROM tr) AS not_exercised, inv.skill IN (SELECT skill FROM tr) AND rr IS NULL AND ar.ref IS NULL AND er.ref IS NULL AS unread
  FROM inv LEFT JOIN cnt ON cnt.ref = inv.ref LEFT JOIN co ON co.ref = inv.ref AND co.skill = inv.skill LEFT JOIN ar ON ar.ref = inv.ref LEFT JOIN er ON er.ref = inv.ref)"""


def _refs(spark, sf):
    name = lambda k: F.concat(F.when(k % 9 == 0, "_shared/").otherwise(""), k.cast("string"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("skill"), name(F.col("p_partkey")).alias("ref"), F.col("p_size").alias("bytes"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("case_id"))
    lp = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f")).join(p, "p_partkey").join(o, "run_id")
    triggers = lp.filter("f = 'R' and skill <> 'Brand#11'").select("case_id", "skill").distinct()
    return p.select("skill", "ref", "bytes"), lp.filter("q <= 3"), triggers, lp.filter("q = 50"), lp.filter("q = 49")


@query(f"WITH {_REF} SELECT * FROM cov")
def x8_ref_coverage(spark, sf):
    return coverage.ref_coverage(*_refs(spark, sf))


@query(f"WITH {_REF} SELECT skill, count(*) AS shipped, count(*) FILTER (WHERE reads_runs > 0) AS read, count(*) FILTER (WHERE unread) AS unread, bool_and(not_exercised) AS not_exercised FROM cov GROUP BY ALL")
def x8_skill_refs(spark, sf):
    return coverage.skill_refs(coverage.ref_coverage(*_refs(spark, sf)))


@query(f"WITH {_REF} SELECT ref, 'artifactOnly' AS kind FROM ar WHERE ref NOT IN (SELECT ref FROM rd) UNION ALL SELECT ref, 'excludedOnly' FROM er WHERE ref NOT IN (SELECT ref FROM rd) AND ref NOT IN (SELECT ref FROM ar)")
def x7_exemptions(spark, sf):
    _, reads, _, artifact, excluded = _refs(spark, sf)
    return coverage.exemptions(reads, artifact, excluded)


@query("WITH d AS (SELECT DISTINCT p_brand || CASE WHEN p_size > 10 THEN '/references/' ELSE '/' END || p_type AS ref FROM part), s AS (SELECT regexp_extract(ref, '^([^/]+)/references/', 1) AS skill, ref FROM d) SELECT skill, count(*) AS read, string_agg(ref, ',' ORDER BY ref) AS refs FROM s WHERE skill <> '' GROUP BY ALL")
def x10_infer_refs(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_brand", F.when(F.col("p_size") > 10, "/references/").otherwise("/"), "p_type").alias("ref"))
    return coverage.infer_refs(p).withColumn("refs", F.array_join("refs", ","))


@query("""WITH i AS (SELECT DISTINCT 'tool' || CAST(user_id % 4 AS VARCHAR) AS tool, event_type AS cmd FROM events WHERE user_id % 4 <> 3 AND (user_id % 4 <> 1 OR event_type <> 'click')),
d AS (SELECT 'tool' || CAST(t.range AS VARCHAR) AS tool, c AS cmd FROM range(4) t, (VALUES ('click'), ('view'), ('refund')) x(c) WHERE t.range <> 2), a AS (SELECT coalesce(d.tool, i.tool) AS tool, coalesce(d.cmd, i.cmd) AS cmd, d.cmd AS dc, i.cmd AS ic FROM d FULL OUTER JOIN i ON d.tool = i.tool AND d.cmd = i.cmd)
SELECT tool, count(dc) AS declared, count(ic) AS invoked, count(*) FILTER (WHERE dc IS NOT NULL AND ic IS NOT NULL) AS covered, coalesce(string_agg(cmd, ',' ORDER BY cmd) FILTER (WHERE ic IS NULL), '') AS unused, coalesce(string_agg(cmd, ',' ORDER BY cmd) FILTER (WHERE dc IS NULL), '') AS undeclared,
  CASE WHEN count(dc) > 0 THEN least(1e0, count(*) FILTER (WHERE dc IS NOT NULL AND ic IS NOT NULL) / CAST(count(dc) AS DOUBLE)) END AS ratio, CASE WHEN count(dc) = 0 THEN 'unavailable' WHEN count(ic) = 0 THEN 'suspect' ELSE 'available' END AS status FROM a GROUP BY ALL""")
def x12_command_coverage(spark, sf):
    u = F.col("user_id") % 4
    tool = lambda c: F.concat(F.lit("tool"), c.cast("string")).alias("tool")
    invoked = table(spark, sf, "events").filter((u != 3) & ((u != 1) | (F.col("event_type") != "click"))).select(tool(u), F.col("event_type").alias("cmd"))
    declared = spark.range(4).filter("id <> 2").select(tool(F.col("id")), F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("refund"))).alias("cmd"))
    return coverage.command_coverage(declared, invoked).withColumn("unused", F.array_join("unused", ",")).withColumn("undeclared", F.array_join("undeclared", ","))


@query(f"""WITH {EVENTS}, t AS (SELECT DISTINCT run_id, event_type AS skill FROM ev WHERE event_type IN ('signup', 'purchase')), n AS (SELECT skill, count(*) AS skill_runs FROM t GROUP BY ALL)
SELECT skill, cmd, count(*) AS runs, skill_runs, CASE WHEN skill_runs < 5 THEN 'insufficient-data' ELSE 'ok' END AS status FROM t JOIN (SELECT DISTINCT run_id, event_type AS cmd FROM ev) c USING (run_id) JOIN n USING (skill) GROUP BY skill, cmd, skill_runs""")
def x13_skill_commands(spark, sf):
    e = events(spark, sf)
    return coverage.skill_commands(e.filter(F.col("event_type").isin("signup", "purchase")).select("run_id", F.col("event_type").alias("skill")), e.select("run_id", F.col("event_type").alias("cmd")))


@query(f"""WITH l AS (SELECT l_orderkey AS run_id, l_suppkey % 5 AS grp, CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber % 4 END AS cache_r, CASE WHEN l_partkey % 5 <> 0 THEN 4 ELSE 0 END AS footprint FROM lineitem),
p AS (SELECT grp, run_id, avg(cache_r / CAST(footprint AS DOUBLE)) FILTER (WHERE cache_r IS NOT NULL AND footprint > 0) AS rr, count(*) FILTER (WHERE cache_r IS NULL OR footprint <= 0) AS skip FROM l GROUP BY ALL)
SELECT grp, count(rr) AS n, CAST(sum(skip) AS BIGINT) AS skipped_rounds, {r('avg(rr)', 4)} AS mean, {r('min(rr)', 4)} AS min, {r('max(rr)', 4)} AS max FROM p GROUP BY ALL""")
def x21_cache_hit(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 5).alias("grp"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber") % 4).alias("cache_r"), F.when(F.col("l_partkey") % 5 != 0, 4).otherwise(0).alias("footprint"))
    return sections.cache_hit_rate(li, ["grp"])


@query(f"""SELECT l_suppkey AS grp, count(DISTINCT l_orderkey) AS runs, count(*) AS invocations, {r('sum(l_quantity) FILTER (WHERE l_partkey % 3 <> 0)', 6)} AS total_cost_usd, CAST(sum(l_linenumber) AS BIGINT) AS num_turns, CAST(sum(l_linenumber * 100) AS BIGINT) AS duration_ms, bool_or(l_returnflag = 'R') AS is_error FROM lineitem GROUP BY ALL""")
def x22_self_report(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")).alias("total_cost_usd"), F.col("l_linenumber").alias("num_turns"), (F.col("l_linenumber") * 100).alias("duration_ms"), (F.col("l_returnflag") == "R").alias("is_error"))
    return sections.self_report(li, ["grp"])


_SIDE = lambda name, amt: f"{r(f'coalesce(sum({amt}) FILTER (WHERE side), 0)', 4)} AS {name}_side, {r(f'sum({amt})', 4)} AS {name}_total, CASE WHEN sum({amt}) <> 0 THEN {r(f'coalesce(sum({amt}) FILTER (WHERE side), 0) / CAST(sum({amt}) AS DOUBLE)', 4)} END AS {name}_share"


@query(f"""WITH l AS (SELECT l_suppkey % 7 AS grp, l_orderkey AS run_id, l_returnflag = 'R' AS side, CAST(l_quantity AS BIGINT) AS i, l_linenumber * 2 AS o, CAST(l_partkey % 10 AS BIGINT) * 10 AS cr, CAST(l_partkey % 4 AS BIGINT) * 4 AS cw, l_partkey % 3 AS n FROM lineitem)
SELECT grp, count(DISTINCT run_id) AS n, count(DISTINCT CASE WHEN side THEN run_id END) AS runs_with_side, {_SIDE('tokens', '(i + o + cr + cw)')}, {_SIDE('calls', 'n')}, {_SIDE('equiv', '(i + 5 * o + cr // 10 + cw // 4 * 5)')} FROM l GROUP BY ALL""")
def x23_sidechain_share(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("grp"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "side").otherwise("main").alias("chain"), F.col("l_quantity").cast("long").alias("u_in"), (F.col("l_linenumber") * 2).alias("u_out"),
        (F.col("l_partkey") % 10 * 10).alias("u_cache_r"), (F.col("l_partkey") % 4 * 4).alias("u_cache_w"), (F.col("l_partkey") % 3).alias("n_calls"),
    )
    return sections.sidechain_share(li, ["grp"])


_CALLS = """k AS (SELECT event_id AS ord, CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'mcp__plug_a-b__do_it' WHEN 'purchase' THEN 'Skill' WHEN 'signup' THEN 'Task' ELSE 'custom' || CAST(user_id % 3 AS VARCHAR) END AS name,
  CASE WHEN user_id % 4 = 0 THEN 'side' ELSE 'main' END AS chain, CASE WHEN event_id % 17 = 0 THEN 'mcp' WHEN event_id % 19 = 0 THEN 'weird' END AS dk, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 23 = 0 THEN 'permission-artifact' ELSE 'success' END AS outcome FROM events),
kk AS (SELECT *, CASE WHEN dk IS NULL THEN CASE WHEN name = 'Skill' THEN 'skill' WHEN name = 'Task' THEN 'agent' WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' WHEN name = 'Read' THEN 'builtin' ELSE 'other' END WHEN dk = 'mcp' THEN 'mcp' ELSE 'other' END AS kind FROM k)"""


def _calls(spark, sf):
    t, i = F.col("event_type"), F.col("event_id")
    name = F.when(t == "click", "Read").when(t == "view", "mcp__plug_a-b__do_it").when(t == "purchase", "Skill").when(t == "signup", "Task").otherwise(F.concat(F.lit("custom"), (F.col("user_id") % 3).cast("string")))
    return table(spark, sf, "events").select(i.alias("ord"), name.alias("name"), F.when(F.col("user_id") % 4 == 0, "side").otherwise("main").alias("chain"), F.when(i % 17 == 0, "mcp").when(i % 19 == 0, "weird").alias("declared_kind"), F.when(t == "error", "error").when(i % 23 == 0, "permission-artifact").otherwise("success").alias("outcome"))


@query(f"WITH {_CALLS} SELECT kind, count(*) FILTER (WHERE chain = 'main') AS main, count(*) FILTER (WHERE chain = 'side') AS side FROM kk GROUP BY ALL")
def x25_tool_usage(spark, sf):
    return sections.tool_usage(_calls(spark, sf))


@query(f"WITH {_CALLS} SELECT name, min_by(kind, ord) AS kind, count(*) AS calls, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'permission-artifact') AS denials FROM kk GROUP BY name ORDER BY calls DESC, name LIMIT 10")
def x25_top_tools(spark, sf):
    return sections.top_tools(_calls(spark, sf))


@query(f"""WITH {_CALLS}, z AS (SELECT *, regexp_replace(name, '^mcp__', '') AS rest FROM kk WHERE kind = 'mcp') SELECT CASE WHEN regexp_extract(rest, '^(.+)__', 1) <> '' THEN regexp_extract(rest, '^(.+)__', 1) ELSE rest END AS server, count(*) AS calls, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'permission-artifact') AS denials FROM z GROUP BY 1""")
def x24_mcp_servers(spark, sf):
    return sections.mcp_servers(_calls(spark, sf))


@query(f"""WITH s AS (SELECT o_orderpriority AS grp, o_custkey AS run_id, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'refusal' WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY grp, run_id ORDER BY seq DESC) = 1 AS lst FROM s)
SELECT grp, count(stop) AS rounds, count(*) - count(stop) AS unknown, {r("count(*) FILTER (WHERE stop = 'max_tokens') / CAST(count(stop) AS DOUBLE)", 4)} AS truncated_share, count(*) FILTER (WHERE lst AND stop = 'max_tokens') AS final_runs, count(*) FILTER (WHERE lst AND stop IS NOT NULL) AS final_known,
  {r("count(*) FILTER (WHERE lst AND stop = 'max_tokens') / CAST(count(*) FILTER (WHERE lst AND stop IS NOT NULL) AS DOUBLE)", 4)} AS final_share FROM l GROUP BY ALL""")
def x26_truncation(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("run_id"), k.alias("seq"), F.when(F.col("o_orderstatus") != "P", F.when(k % 3 == 0, "max_tokens").otherwise("end_turn")).alias("stop"), F.when(k % 10 == 0, "refusal").alias("declared_stop"))
    return sections.truncation(o, ["grp"])


_PATHS = "CASE page_id % 6 WHEN 0 THEN '/Home/X/src/a.py' WHEN 1 THEN 'rel\\b.txt' WHEN 2 THEN '/opt/skills/s1/references/r.md' WHEN 3 THEN '/etc/passwd' WHEN 4 THEN '' ELSE 'C:\\x\\y' END"


@query("""WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'write' WHEN 2 THEN 'read' END AS op, CASE page_id % 6 WHEN 0 THEN 'workspace' WHEN 1 THEN 'workspace' WHEN 2 THEN 'skillRefs' WHEN 3 THEN 'otherAbsolute' WHEN 4 THEN 'pathless' ELSE 'otherAbsolute' END AS t FROM pages WHERE page_id % 11 <> 0)
SELECT op, count(*) FILTER (WHERE t = 'skillRefs') AS "skillRefs", count(*) FILTER (WHERE t = 'workspace') AS workspace, count(*) FILTER (WHERE t = 'otherAbsolute') AS "otherAbsolute", count(*) FILTER (WHERE t = 'pathless') AS pathless FROM p WHERE op IS NOT NULL GROUP BY ALL""")
def x28_file_targets(spark, sf):
    k = F.col("page_id")
    name = F.when(k % 4 == 0, "Write").when(k % 4 == 1, "Edit").when(k % 4 == 2, "Read").otherwise("Grep")
    path = F.when(k % 6 == 0, "/Home/X/src/a.py").when(k % 6 == 1, "rel\\b.txt").when(k % 6 == 2, "/opt/skills/s1/references/r.md").when(k % 6 == 3, "/etc/passwd").when(k % 6 == 4, "").otherwise("C:\\x\\y")
    return sections.file_targets(table(spark, sf, "pages").select(name.alias("name"), path.alias("path"), F.when(k % 11 != 0, "/home/x/").alias("cwd")))


@query(f"""WITH o AS (SELECT o_orderpriority AS grp, o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_custkey % 10 <> 0)
SELECT grp, count(*) FILTER (WHERE s = 'P') AS excluded, count(*) FILTER (WHERE k % 14 = 0) AS aborted, count(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0) AS timed_out, count(*) FILTER (WHERE NOT (k % 3 <> 0 AND k % 5 = 0)) AS knowable, count(*) FILTER (WHERE k % 3 <> 0 AND k % 5 = 0) AS legacy_unknown,
  {r('count(*) FILTER (WHERE k % 6 = 0) / CAST(count(*) FILTER (WHERE NOT (k % 3 <> 0 AND k % 5 = 0)) AS DOUBLE)', 4)} AS timeout_rate, count(*) FILTER (WHERE k % 4 > 0 AND s = 'F') AS retried_then_succeeded FROM o GROUP BY ALL""")
def x29_health(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 10 == 0).alias("held_out"), (F.col("o_orderstatus") == "P").alias("excluded"), F.when(k % 14 == 0, k).alias("aborted_at_step"), F.when(k % 3 == 0, k % 2 == 0).alias("timed_out"),
        F.when(k % 5 == 0, "timeout").alias("error"), (k % 4).alias("n_retries"), (F.col("o_orderstatus") == "F").cast("int").alias("C"),
    )
    return sections.health(o, ["grp"])


@query("""SELECT 'regex: ' || p_type AS verifier, count(*) AS fails FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 10 GROUP BY ALL ORDER BY fails DESC, verifier LIMIT 10""")
def x29_verifier_fails(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sections.verifier_fails(j.select(F.lit("regex").alias("type"), F.concat("p_type", F.lit(" (saw "), F.col("l_quantity").cast("string"), F.lit(")")).alias("detail"), (F.col("l_quantity") >= 10).alias("passed")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'sealed' WHEN c_custkey % 4 = 0 THEN 'backfill' ELSE 'none' END AS authority, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 4 = 0 THEN 'side' END AS stats FROM customer")
def x31_authority(spark, sf):
    c = table(spark, sf, "customer")
    side = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit("side").alias("stats"))
    return sections.authority(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("stats")), side)


_CONV = """cv AS (SELECT conv_id AS run_id, turn, role, length(text) AS len, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) * CASE WHEN turn % 5 = 4 THEN 1 ELSE 2 END AS footprint FROM conversations),
x AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY turn) + CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS slot FROM cv),
b AS (SELECT run_id, slot, max(turn) FILTER (WHERE role = 'assistant') AS seq, max(footprint) FILTER (WHERE role = 'assistant') AS footprint, max(len) FILTER (WHERE role = 'assistant') AS o, CAST(coalesce(sum(len) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS u, CAST(coalesce(sum(len) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS h FROM x GROUP BY ALL),
y AS (SELECT *, lag(footprint) OVER w AS pf, lag(o) OVER w AS prev_out FROM b WHERE seq IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY slot)),
it AS (SELECT run_id, seq, footprint, seq % 5 = 4 AS compact_before, footprint - pf AS delta, prev_out, CAST(floor((prev_out % 100) / 4e0 + 0.5) AS BIGINT) AS tool_res, CAST(floor(u / 4e0 + 0.5) AS BIGINT) AS injected_user, CAST(floor(h / 4e0 + 0.5) AS BIGINT) AS injected_harness, 0 AS skill_body FROM y WHERE pf IS NOT NULL),
items AS (SELECT *, delta - prev_out - tool_res - injected_user - injected_harness - skill_body AS other FROM it)"""


def _rounds(spark, sf):
    c = table(spark, sf, "conversations").withColumn("len", F.length("text"))
    c = c.withColumn("footprint", F.sum("len").over(W.partitionBy("conv_id").orderBy("turn")) * F.when(F.col("turn") % 5 == 4, 1).otherwise(2)).withColumn("ts", F.lpad(F.col("turn").cast("string"), 8, "0"))
    rounds = c.filter("role = 'assistant'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "ts", "footprint", F.col("len").cast("long").alias("out"), (F.col("len") % 100).cast("long").alias("result_chars"), (F.col("turn") % 5 == 4).alias("compact_before"))
    user = c.filter("role <> 'assistant'").select(F.col("conv_id").alias("run_id"), "ts", F.col("turn").alias("pos"), F.col("len").alias("chars"), F.when(F.col("role") == "system", "meta-injected").otherwise("user").alias("src_kind"))
    return rounds, user


@query(f"WITH {_CONV} SELECT *, CASE WHEN other < 0 THEN CASE WHEN compact_before THEN 'confirmed' ELSE 'inferred' END END AS compaction FROM items")
def o1_attribution(spark, sf):
    return attribution.run_items(*_rounds(spark, sf))


_PARTS = ("prev_out", "tool_res", "injected_user", "injected_harness", "skill_body", "other")


@query(f"""WITH {_CONV}, rd AS (SELECT run_id, turn AS seq, footprint FROM cv WHERE role = 'assistant'), bs AS (SELECT run_id, min_by(footprint, seq) FILTER (WHERE footprint > 0) AS baseline, min(seq) FILTER (WHERE footprint > 0) AS f, max_by(footprint, seq) AS final_footprint, count(*) FILTER (WHERE footprint <= 0) AS skipped_rounds FROM rd GROUP BY ALL),
g AS (SELECT run_id, {', '.join(f'CAST(sum(greatest(0, {p})) AS BIGINT) AS {p}' for p in _PARTS)}, CAST(sum(greatest(0, -other)) AS BIGINT) AS compaction FROM items JOIN bs USING (run_id) WHERE footprint > 0 AND seq > f GROUP BY ALL),
z AS (SELECT run_id, baseline, {', '.join(f'coalesce({p}, 0) AS {p}' for p in _PARTS)}, coalesce(compaction, 0) AS compaction, final_footprint, skipped_rounds FROM bs LEFT JOIN g USING (run_id) WHERE final_footprint > 0), d AS (SELECT *, baseline + {' + '.join(_PARTS)} AS denominator FROM z)
SELECT *, {', '.join(f"{r(f'{p} / CAST(denominator AS DOUBLE)', 4)} AS share_{p}" for p in ('baseline', *_PARTS))} FROM d""")
def x19_context_composition(spark, sf):
    rounds, user = _rounds(spark, sf)
    return attribution.composition(rounds, attribution.run_items(rounds, user))


@query(f"""WITH {_CONV}, p AS (SELECT run_id, seq, unnest({list(_PARTS)}) AS part, unnest([prev_out, tool_res, injected_user, injected_harness, skill_body, other]) AS tokens FROM items) SELECT run_id, seq, string_agg(part || '=' || CAST(tokens AS VARCHAR), ',' ORDER BY tokens DESC, part) AS parts FROM p GROUP BY ALL""")
def o2_contributions(spark, sf):
    c = attribution.contributions(attribution.run_items(*_rounds(spark, sf)))
    return c.withColumn("parts", F.array_join(F.transform("parts", lambda x: F.concat_ws("=", x["part"], x["tokens"].cast("string"))), ","))


@query(f"""WITH {EVENTS}, u AS (SELECT run_id, count(*) FILTER (WHERE event_type = 'error') AS errs, user_id % 10 AS grp FROM ev GROUP BY run_id, user_id) SELECT grp, count(*) AS runs, {r('avg(CAST(errs > 0 AS INTEGER))', 4)} AS error_rate FROM u GROUP BY ALL""")
def o5_error_rate(spark, sf):
    u = events(spark, sf).groupBy("run_id", (F.col("user_id") % 10).alias("grp")).agg(F.count_if(F.col("event_type") == "error").alias("errs"))
    return u.groupBy("grp").agg(F.count("*").alias("runs"), js_round(F.avg((F.col("errs") > 0).cast("int")), 4).alias("error_rate"))

"""Cards, section views, probe blocks, inventories, verifier types and the text of verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.num import js_round
from tracemill.operators import attribution, cards, compare, coverage, grading, graph, lint, sections, views
from tracemill.plans.bindings import BASKETS, EVENTS, REPS, baskets, events, r, reps, table, tasks
from tracemill.plans.coverage_queries import _CALLS, _CONV, _PARTS, _calls, _rounds
from tracemill.plans import mining_queries
from tracemill.plans.registry import ORACLE_SQL, query
from tracemill.sources import files, logs
from tracemill.streaming import tail

#: Share of sessions in which skills of the charted graph meet.
_CO = 0.028


@query(f"WITH {_CONV} SELECT run_id, seq, prev_out, tool_res, injected_user + injected_harness + skill_body AS injected, other AS residual, CASE WHEN other < 0 THEN CASE WHEN compact_before THEN 'confirmed' ELSE 'inferred' END END AS compaction FROM items")
def o4_stack_series(spark, sf):
    return cards.stack_series(attribution.run_items(*_rounds(spark, sf)))


@query(f"""WITH {_CONV}, bs AS (SELECT run_id, min_by(footprint, turn) FILTER (WHERE footprint > 0) AS baseline, min(turn) FILTER (WHERE footprint > 0) AS f, max_by(footprint, turn) AS ff FROM cv WHERE role = 'assistant' GROUP BY ALL),
g AS (SELECT run_id, {', '.join(f'sum(greatest(0, {p})) AS {p}' for p in _PARTS)} FROM items JOIN bs USING (run_id) WHERE footprint > 0 AND seq > f GROUP BY ALL),
d AS (SELECT run_id, run_id % 7 AS grp, baseline, {', '.join(f'coalesce({p}, 0) AS {p}' for p in _PARTS)} FROM bs LEFT JOIN g USING (run_id) WHERE ff > 0), e AS (SELECT *, baseline + {' + '.join(_PARTS)} AS denominator FROM d),
s AS (SELECT grp, unnest(range(0, 7)) AS position, unnest({['baseline', *_PARTS]}) AS part, unnest([{', '.join(r(f'{p} / CAST(denominator AS DOUBLE)', 4) for p in ('baseline', *_PARTS))}]) AS share FROM e)
SELECT grp, position, part, {r('avg(share)', 4)} AS mean, {r('min(share)', 4)} AS least, {r('max(share)', 4)} AS most, count(*) AS n FROM s GROUP BY ALL""")
def o12_context_view(spark, sf):
    rounds, user = _rounds(spark, sf)
    c = attribution.composition(rounds, attribution.run_items(rounds, user))
    return cards.context_view(c.withColumn("grp", F.col("run_id") % 7), ["grp"])


@query(f"""WITH {_CALLS}, o AS (SELECT * FROM (VALUES (0, 'skill'), (1, 'agent'), (2, 'mcp'), (3, 'builtin'), (4, 'other')) x(position, kind))
SELECT position, o.kind, count(*) FILTER (WHERE chain = 'main' AND outcome <> 'error') AS main, count(*) FILTER (WHERE chain = 'side' AND outcome <> 'error') AS side, count(*) FILTER (WHERE outcome <> 'error') AS total FROM o LEFT JOIN kk ON kk.kind = o.kind GROUP BY ALL""")
def o12_tool_view(spark, sf):
    return cards.tool_view(sections.tool_usage(_calls(spark, sf).filter("outcome <> 'error'")))


@query("""WITH p AS (SELECT CASE WHEN page_id % 4 < 2 THEN 'write' ELSE 'read' END AS op, CASE page_id % 3 WHEN 0 THEN 'workspace' WHEN 1 THEN 'pathless' ELSE 'otherAbsolute' END AS t FROM pages),
o AS (SELECT * FROM (VALUES (0, 'skillRefs'), (1, 'workspace'), (2, 'otherAbsolute')) x(position, place))
SELECT op, place, position, count(*) FILTER (WHERE t = place) AS count, count(*) FILTER (WHERE t = 'pathless') AS pathless FROM p, o GROUP BY ALL""")
def o12_file_view(spark, sf):
    k = F.col("page_id")
    calls = table(spark, sf, "pages").select(F.when(k % 4 < 2, "Write").otherwise("Read").alias("name"), F.when(k % 3 == 0, "/w/a").when(k % 3 == 2, "/x/y").alias("path"), F.lit("/w").alias("cwd"))
    return cards.file_view(sections.file_targets(calls))


_SEGMENTS = ("cache", "truncation", "sidechain", "self_report", "timeouts")


@query(f"""SELECT c_custkey AS id, unnest({list(_SEGMENTS)}) AS segment, unnest([{', '.join(f'CASE WHEN (c_custkey + {n}) % 3 <> 0 THEN (c_custkey % {n + 5}) / 8e0 END' for n in range(5))}]) AS value,
  unnest([{', '.join(f"CASE WHEN (c_custkey + {n}) % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'no-usage' ELSE 'unknown' END END" for n in range(5))}]) AS reason FROM customer""")
def o12_health_view(spark, sf):
    k = F.col("c_custkey")
    columns = []
    for n, s in enumerate(_SEGMENTS):
        columns += [F.when((k + n) % 3 != 0, (k % (n + 5)) / 8.0).alias(s), F.when(k % 2 == 0, "no-usage").otherwise("of-days-to-come").alias(f"{s}_reason")]
    return cards.health_view(table(spark, sf, "customer").select(k.alias("id"), *columns))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'error' WHEN c_custkey % 3 <> 0 OR c_custkey % 5 = 0 THEN 'full' ELSE 'legacy' END AS state, CASE WHEN c_custkey % 3 = 1 THEN 'embedded' WHEN c_custkey % 3 = 2 THEN 'backfill' END AS badge FROM customer""")
def o11_stats_state(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 5 == 0, "s").alias("stats"), F.when(k % 7 == 0, "boom").alias("error"), F.when(k % 3 == 1, "embedded").when(k % 3 == 2, "recomputed-no-embedded").alias("authority"))
    return cards.stats_state(c).select("id", "state", "badge")


@query("""WITH i AS (SELECT DISTINCT p_type AS id, p_brand || '/' || CAST(p_size AS VARCHAR) AS skill, p_size FROM part), t AS (SELECT DISTINCT p_type AS id, p_brand || '/' || CAST(p_size AS VARCHAR) AS skill FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 1 AND l_linenumber = 1),
x AS (SELECT i.*, t.skill IS NOT NULL AS hit FROM i LEFT JOIN t ON t.id = i.id AND t.skill = i.skill)
SELECT id, count(*) AS installed, count(*) FILTER (WHERE hit) AS triggered, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS ratio, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (WHERE NOT hit AND p_size > 25), '') AS never_triggered, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (WHERE NOT hit AND p_size <= 25), '') AS not_exercised FROM x GROUP BY id""")
def o11_skill_card(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_type").alias("id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("skill"))
    li = table(spark, sf, "lineitem").filter("l_quantity = 1 and l_linenumber = 1")
    t = p.join(li, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("id", "skill")
    rest = p.select("id", "skill", "p_size").distinct().join(t.distinct(), ["id", "skill"], "left_anti")
    card = cards.skill_card(p.select("id", "skill"), t, rest.select("id", "skill", F.when(F.col("p_size") > 25, "neverTriggered").otherwise("notExercised").alias("status")))
    return card.withColumn("never_triggered", F.array_join("never_triggered", ",")).withColumn("not_exercised", F.array_join("not_exercised", ","))


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey % 4 <> 3 AS known, CASE c_custkey % 4 WHEN 3 THEN 'external-runtime' WHEN 2 THEN 'none-backfill' ELSE 'snapshot' END AS status FROM customer),
s AS (SELECT o_custkey AS id, count(*) AS n, sum(o_orderkey % 5) AS shipped, sum(o_orderkey % 3) AS rd, sum(o_orderkey % 2) AS un FROM orders GROUP BY ALL), h AS (SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS k FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL)
SELECT id, NOT known AS unknown, CASE WHEN NOT known THEN 'external-runtime-self-managed' WHEN status = 'none-backfill' THEN 'no-inventory-snapshot' END AS reason, CASE WHEN status = 'snapshot' THEN CAST(coalesce(shipped, 0) AS BIGINT) END AS shipped,
  CASE WHEN known THEN CAST(coalesce(rd, 0) + CASE WHEN status = 'none-backfill' THEN coalesce(k, 0) ELSE 0 END AS BIGINT) END AS read, CASE WHEN known THEN CAST(coalesce(un, 0) AS BIGINT) END AS unread, CASE WHEN known THEN coalesce(k, 0) END AS shared_reads FROM e LEFT JOIN s USING (id) LEFT JOIN h USING (id)""")
def o11_ref_card(spark, sf):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    e = table(spark, sf, "customer").select(k.alias("id"), (k % 4 != 3).alias("known"), F.when(k % 4 == 3, "external-runtime").when(k % 4 == 2, "none-backfill").otherwise("snapshot").alias("status"))
    e = e.withColumn("reason", F.when(F.col("status") == "external-runtime", "external-runtime-self-managed").when(F.col("status") == "none-backfill", "no-inventory-snapshot"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    skills = orders.join(e.select("id", "status"), "id").select("id", F.when(F.col("status") == "snapshot", o % 5).alias("shipped"), (o % 3).alias("read"), (o % 2).alias("unread"))
    return cards.ref_card(e, skills, orders.filter(o % 4 == 0).select("id", F.col("o_orderpriority").alias("ref")))


@query("SELECT p_partkey AS id, p_type AS word, CASE p_type WHEN 'suspect' THEN 'warn' WHEN 'held-out-unknown' THEN 'warn' WHEN 'ok' THEN 'ok' ELSE 'dim' END AS tone FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'suspect' WHEN 2 THEN 'held-out-unknown' WHEN 3 THEN 'unavailable' ELSE 'to-come' END AS p_type FROM part) x")
def o11_status_word(spark, sf):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "ok").when(k == 1, "suspect").when(k == 2, "held-out-unknown").when(k == 3, "unavailable").otherwise("to-come")
    word, tone = cards.status_word(s)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), word.alias("word"), tone.alias("tone"))


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey % 3 <> 0 AS claude, c_custkey % 4 AS m FROM customer) SELECT id, CASE WHEN m IN (1, 2) THEN 'adapter-declared' WHEN NOT claude THEN 'external-runtime' ELSE 'none-backfill' END AS status, CASE m WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS skills FROM e""")
def x30_backfill_inventory(spark, sf):
    return coverage.backfill_inventory(_declared(spark, sf))


@query("""SELECT c_custkey AS id, x.skill, x.version_sha, x.refs FROM customer, (VALUES (1, 'a', 'v1', 'a/1.md,a/2.md'), (1, 'b', NULL, ''), (2, 'c', NULL, 'c/9.md')) x(m, skill, version_sha, refs) WHERE c_custkey % 4 = x.m""")
def x30_declared_inventory(spark, sf):
    return coverage.declared_inventory(_declared(spark, sf)).withColumn("refs", F.array_join("refs", ","))


def _declared(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 1, '{"a": {"versionSha": "v1", "refs": ["a/2.md", 3, "a/1.md"]}, "b": null}').when(k % 4 == 2, '{"c": {"versionSha": 7, "refs": ["c/9.md", null]}}').when(k % 4 == 3, "{}")
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 != 0, "claude-code").otherwise("other").alias("runtime"), text.alias("inventory"))


_PROBE = """pe AS (SELECT user_id AS session, user_id % 40 AS case_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS arm, user_id % 9 = 0 AS excluded, event_id AS ordinal, CASE WHEN event_id % 2 = 0 THEN 'cli' ELSE 'alt' END AS tool, event_type || CASE WHEN event_id % 5 = 0 THEN ' x' ELSE '' END AS cmd FROM events),
dc AS (SELECT * FROM (VALUES ('cli', 'click'), ('cli', 'view x'), ('cli', 'never'), ('alt', 'signup')) x(tool, cmd))"""


def _probes(spark, sf):
    u, i = F.col("user_id"), F.col("event_id")
    e = table(spark, sf, "events").select(u.alias("session"), (u % 40).alias("case_id"), F.when(u % 2 == 0, "new").otherwise("old").alias("arm"), (u % 9 == 0).alias("excluded"), i.alias("ordinal"), F.when(i % 2 == 0, "cli").otherwise("alt").alias("tool"), F.concat("event_type", F.when(i % 5 == 0, " x").otherwise("")).alias("cmd"))
    declared = spark.createDataFrame([("cli", "click"), ("cli", "view x"), ("cli", "never"), ("alt", "signup")], "tool string, cmd string")
    triggers = e.filter("cmd in ('signup', 'purchase')").select("session", F.col("cmd").alias("skill"))
    return compare.probe_blocks(e.select("arm", "case_id", "session", "excluded").distinct(), triggers, e.select("session", "tool", "cmd", "ordinal"), e.select("session", F.col("tool").alias("type"), F.col("cmd").alias("id"), "ordinal"), declared)


@query(f"""WITH {_PROBE}, a AS (SELECT * FROM (VALUES ('old'), ('new')) x(arm)), i AS (SELECT DISTINCT arm, tool, cmd FROM pe WHERE NOT excluded), d AS (SELECT arm, tool, cmd FROM a, dc),
b AS (SELECT coalesce(d.arm, i.arm) AS arm, coalesce(d.tool, i.tool) AS tool, d.cmd AS dcmd, i.cmd AS icmd FROM d FULL JOIN i ON d.arm = i.arm AND d.tool = i.tool AND d.cmd = i.cmd)
SELECT arm, tool, count(dcmd) AS declared, count(icmd) AS invoked, count(*) FILTER (WHERE dcmd IS NOT NULL AND icmd IS NOT NULL) AS covered, coalesce(string_agg(dcmd, ',' ORDER BY dcmd) FILTER (WHERE icmd IS NULL), '') AS unused, coalesce(string_agg(icmd, ',' ORDER BY icmd) FILTER (WHERE dcmd IS NULL), '') AS undeclared,
  least(1e0, count(*) FILTER (WHERE dcmd IS NOT NULL AND icmd IS NOT NULL) / CAST(count(dcmd) AS DOUBLE)) AS ratio, CASE WHEN count(dcmd) = 0 THEN 'unavailable' WHEN count(icmd) = 0 THEN 'suspect' ELSE 'available' END AS status FROM b GROUP BY ALL""")
def x32_probe_coverage(spark, sf):
    return _probes(spark, sf)["coverage"].withColumn("unused", F.array_join("unused", ",")).withColumn("undeclared", F.array_join("undeclared", ","))


@query(f"""WITH {_PROBE}, l AS (SELECT arm, case_id, session, tool, cmd AS a, lead(cmd) OVER w AS b, lead(cmd, 2) OVER w AS c FROM pe WHERE NOT excluded WINDOW w AS (PARTITION BY session, tool ORDER BY ordinal)),
u AS (SELECT arm, 2 AS n, a || '>' || b AS seq, case_id, session, tool FROM l WHERE b IS NOT NULL UNION ALL SELECT arm, 3, a || '>' || b || '>' || c, case_id, session, tool FROM l WHERE c IS NOT NULL)
SELECT arm, n, seq, count(DISTINCT case_id) AS distinct_cases, count(DISTINCT CAST(session AS VARCHAR) || '|' || tool) AS runs FROM u GROUP BY ALL HAVING count(DISTINCT case_id) >= 3""")
def x32_probe_sequences(spark, sf):
    return _probes(spark, sf)["sequences"].withColumn("seq", F.array_join("seq", ">"))


@query(f"""WITH {_PROBE}, t AS (SELECT DISTINCT arm, session, cmd AS skill FROM pe WHERE NOT excluded AND cmd IN ('signup', 'purchase')), n AS (SELECT arm, skill, count(*) AS skill_runs FROM t GROUP BY ALL)
SELECT arm, skill, cmd, count(*) AS runs, skill_runs, CASE WHEN skill_runs < 5 THEN 'insufficient-data' ELSE 'ok' END AS status FROM t JOIN (SELECT DISTINCT session, cmd FROM pe) c USING (session) JOIN n USING (arm, skill) GROUP BY ALL""")
def x32_probe_skills(spark, sf):
    return _probes(spark, sf)["skill_commands"]


@query(f"WITH {_PROBE}, c AS (SELECT case_id, bool_or(excluded) AS x FROM pe GROUP BY ALL) SELECT count(*) AS cases, {r('100 * (count(*) FILTER (WHERE x) / CAST(count(*) AS DOUBLE))', 4)} AS exclusion_pct, 100 * (count(*) FILTER (WHERE x) / CAST(count(*) AS DOUBLE)) > 12 AS tripwired FROM c")
def x32_paired_exclusion(spark, sf):
    return _probes(spark, sf)["paired"]


@query(f"WITH {_PROBE} SELECT arm, case_id, tool, string_agg(cmd, ',' ORDER BY ordinal, cmd) AS cmds FROM pe WHERE excluded GROUP BY arm, case_id, session, tool")
def x32_excluded_hits(spark, sf):
    return _probes(spark, sf)["excluded_hits"].withColumn("cmds", F.array_join("cmds", ","))


@query(f"""WITH c AS (SELECT p_brand AS tool, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS arm, count(DISTINCT p_size % 3) AS declared, avg((p_size % 4) / 4e0) AS ratio FROM part WHERE p_brand <> 'Brand#12' OR p_partkey % 2 = 0 GROUP BY ALL), t AS (SELECT DISTINCT tool FROM c)
SELECT tool, coalesce(o.declared = n.declared, false) AS comparable, CASE WHEN o.tool IS NULL OR n.tool IS NULL THEN 'one-arm-only' WHEN o.declared <> n.declared THEN 'command-surface-differs' END AS reason, CASE WHEN o.declared = n.declared THEN {r('n.ratio - o.ratio', 4)} END AS ratio_delta, 'inconclusive' AS status
FROM t LEFT JOIN (SELECT * FROM c WHERE arm = 'old') o USING (tool) LEFT JOIN (SELECT * FROM c WHERE arm = 'new') n USING (tool)""")
def u13_probe_deltas(spark, sf):
    p = table(spark, sf, "part").filter("p_brand <> 'Brand#12' or p_partkey % 2 = 0")
    c = p.groupBy(F.col("p_brand").alias("tool"), F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("new").alias("arm")).agg(F.count_distinct(F.col("p_size") % 3).alias("declared"), F.avg(F.col("p_size") % 4 / F.lit(4.0)).alias("ratio"))
    return compare.probe_deltas(c, tripwired=True)


@query(f"WITH {REPS} SELECT CAST(NULL AS DOUBLE) AS est_sessions, CAST(NULL AS DOUBLE) AS est_hours, CAST(NULL AS DOUBLE) AS est_usd, count(*) AS actual_sessions, {r('sum(duration_ms) / 3.6e6')} AS actual_hours, {r('sum((order_id % 100) / 1e2) FILTER (WHERE order_id % 3 <> 0)')} AS actual_usd FROM reps")
def u13_budget(spark, sf):
    x = reps(spark, sf).withColumn("wall_ms", F.lit(None).cast("long")).withColumn("cost_usd", F.lit(None).cast("double")).withColumn("cost_usd_reported", F.when(F.col("order_id") % 3 != 0, F.col("order_id") % 100 / F.lit(100.0)))
    return compare.budget(x)


@query("""SELECT s_suppkey AS id, '{"config":{"min_pairs":8,"min_pairs_skill":5,"delta_pp":5.0,"level":0.95,"iters":10000,"seed":2654435769,"tripwire_pct":12.0,"token_weights":{"in":1.0,"out":5.0,"cacheR":0.1,"cacheW":1.25}},"tests":{"count":' || CAST(s_nationkey AS VARCHAR) || ',"global_correction":"none","per_skill_correction":"benjamini-hochberg"}}' AS footer FROM supplier""")
def u10_verdict_footer(spark, sf):
    return compare.verdict_footer(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tests"))).select("id", "footer")


_IDENTITY = "a AS (SELECT c_custkey AS arm, c_mktsegment AS label, CASE WHEN c_custkey % 3 <> 0 THEN 'v' || CAST(c_custkey % 4 AS VARCHAR) END AS cli_version FROM customer)"


@query(f"""WITH {_IDENTITY}, s AS (SELECT o_custkey AS arm, o_orderpriority AS name, md5(o_orderpriority) AS sha FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT a.arm, sha256(label || '|' || coalesce(cli_version, '') || '|' || coalesce(string_agg(name || '=' || sha, ',' ORDER BY name || '=' || sha), '')) AS identity FROM a LEFT JOIN s USING (arm) GROUP BY a.arm, label, cli_version""")
def u10_arm_identity(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("arm"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("v"), (F.col("c_custkey") % 4).cast("string"))).alias("cli_version"))
    s = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("arm"), F.col("o_orderpriority").alias("name"), F.md5("o_orderpriority").alias("sha256")).distinct()
    return compare.arm_identity(c.join(s, "arm", "left"))


_RP = """v AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'insufficient-data' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'quality-fix' ELSE 'cost-opt' END AS verdict, c_custkey % 7 = 0 AS established,
  CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 13) - 12.5 END AS l1_low, (c_custkey % 11) - 8.5 AS l2_low, c_custkey % 6 = 0 AS flow, c_custkey % 9 = 0 AS cost, c_custkey % 3 = 0 AS up, c_custkey % 30 AS pairs, c_custkey % 14 AS pct FROM customer)"""


def _reports(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "insufficient-data").when(k % 5 == 1, "inconclusive").when(k % 5 == 2, "quality-fix").otherwise("cost-opt").alias("verdict"), (k % 7 == 0).alias("established"), F.when(k % 4 != 0, k % 13 - 12.5).alias("l1_low"), (k % 11 - 8.5).alias("l2_low"), F.lit(None).cast("double").alias("l3_low"),
        (k % 6 == 0).alias("flow_regressed"), (k % 9 == 0).alias("any_cost_up"), (k % 3 == 0).alias("any_quality_up"), (k % 30).alias("pairs"), (k % 14).alias("exclusion_pct"), F.lit("cost-opt").alias("intent"),
    )


@query(f"""WITH {_RP}, c AS (SELECT id, 'l1-quality' AS what, l1_low AS low FROM v WHERE l1_low <= -5 UNION ALL SELECT id, 'l2-quality', l2_low FROM v WHERE l2_low <= -5 UNION ALL SELECT id, 'incomplete-flows', NULL FROM v WHERE flow UNION ALL SELECT id, 'cost-up', NULL FROM v WHERE cost UNION ALL SELECT id, 'no-quality-gain', NULL FROM v WHERE verdict = 'quality-fix' AND NOT up)
SELECT v.id, CASE WHEN verdict NOT IN ('insufficient-data', 'inconclusive') AND NOT established THEN coalesce(string_agg(what, ',' ORDER BY coalesce(low, 0), what), '') END AS causes FROM v LEFT JOIN c USING (id) GROUP BY v.id, verdict, established""")
def u23_failure_causes(spark, sf):
    return views.failure_causes(_reports(spark, sf)).select("id", F.array_join(F.transform("causes", lambda c: c["what"]), ",").alias("causes"))


@query(f"""WITH {_RP} SELECT id, CASE WHEN verdict IN ('insufficient-data', 'inconclusive') THEN '∅ undecided: ' || verdict WHEN established THEN '✓ recommended: true' ELSE '✗ recommended: false' END || ' · intent: cost-opt · n=' || CAST(pairs AS VARCHAR) || ' pairs · excluded ' || CAST(pct AS VARCHAR) || '.0%' AS line FROM v""")
def u23_verdict_line(spark, sf):
    return views.verdict_line(views.verdict_view(_reports(spark, sf))).select("id", "line")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'judged' ELSE 'deterministic' END AS cls, l_linenumber % 4 <> 3 AND l_quantity > 10 AS passed, CASE WHEN l_linenumber % 4 = 3 THEN 'unknown verifier type telepathy' ELSE 'd' END AS detail FROM lineitem""")
def v9_unknown_type(spark, sf):
    n = F.col("l_linenumber") % 4
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(n == 0, "judge").when(n == 3, "telepathy").otherwise("regex").alias("type"), (F.col("l_quantity") > 10).alias("passed"), F.lit("d").alias("detail"))
    return grading.checked_types(li).select("id", "cls", "passed", "detail")


@query("""WITH w AS (SELECT DISTINCT o_custkey AS run_id FROM orders) SELECT run_id, c_custkey IS NOT NULL AS found, c_name AS name FROM w LEFT JOIN customer ON c_custkey = run_id AND c_custkey % 3 <> 0""")
def s8_resolve_runs(spark, sf):
    runs = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    return files.resolve_runs(table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id")), runs).select("run_id", "found", "name")


@query(f"""WITH {EVENTS}, s AS (SELECT run_id, user_id, event_type AS skill FROM ev GROUP BY ALL), y AS (SELECT skill, count(DISTINCT user_id) AS y FROM s GROUP BY ALL), rd AS (SELECT DISTINCT user_id, event_type || '/' || CAST(ordinal % 3 AS VARCHAR) AS ref, run_id FROM ev WHERE ordinal % 2 = 0),
i AS (SELECT skill, skill || '/' || CAST(k.range AS VARCHAR) AS ref FROM (SELECT DISTINCT skill FROM s) z, range(4) k), c AS (SELECT ref, count(DISTINCT user_id) AS reads_cases FROM rd GROUP BY ALL),
co AS (SELECT s.skill, rd.ref, count(DISTINCT rd.user_id) AS x FROM (SELECT DISTINCT user_id, skill FROM s) s JOIN (SELECT DISTINCT user_id, ref FROM rd) rd USING (user_id) GROUP BY ALL)
SELECT i.skill, i.ref, 10 AS bytes, coalesce(reads_cases, 0) AS reads_cases, coalesce(x, 0) AS x, y, false AS blocked FROM i JOIN y USING (skill) LEFT JOIN c USING (ref) LEFT JOIN co ON co.skill = i.skill AND co.ref = i.ref""")
def o11_ref_rows(spark, sf):
    e = events(spark, sf)
    triggers = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("skill"))
    reads = e.filter("ordinal % 2 = 0").select("run_id", F.col("user_id").alias("case_id"), F.concat_ws("/", "event_type", (F.col("ordinal") % 3).cast("string")).alias("ref"))
    inventory = triggers.select("skill").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("skill", F.concat_ws("/", "skill", F.col("k").cast("string")).alias("ref"), F.lit(10).alias("bytes"))
    nothing = reads.select("ref").limit(0)
    return cards.ref_rows(coverage.ref_coverage(inventory, reads, triggers, nothing, nothing), triggers)


@query(f"""WITH RECURSIVE {BASKETS}, n AS (SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n FROM lineitem), nd AS (SELECT skill, count(*) / any_value(n) AS rate FROM triggers, n GROUP BY skill),
ed AS (SELECT a.skill AS a, b.skill AS b, count(*) / any_value(n) AS rate FROM triggers a JOIN triggers b ON a.session = b.session AND a.skill < b.skill, n GROUP BY ALL HAVING count(*) / any_value(n) >= {_CO}),
u AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), c(x, y) AS (SELECT skill, skill FROM nd UNION SELECT c.x, u.b FROM c JOIN u ON c.y = u.a), lb AS (SELECT x, min(y) AS comp FROM c GROUP BY x), mg AS (SELECT comp, string_agg(x, ',' ORDER BY x) AS members FROM lb GROUP BY comp HAVING count(*) >= 2),
rr AS (SELECT o.ref, count(*) AS n, count(h.ref) AS numer FROM (SELECT DISTINCT o.ref, t.session FROM (SELECT DISTINCT ref, skill FROM reads) o JOIN triggers t USING (skill)) o LEFT JOIN (SELECT DISTINCT ref, session FROM reads) h ON o.ref = h.ref AND o.session = h.session GROUP BY o.ref)
SELECT 'node' AS kind, skill AS a, NULL AS b, {r('rate', 6)} AS value, false AS merge FROM nd UNION ALL SELECT 'edge', a, b, {r('rate', 6)}, true FROM ed
UNION ALL SELECT 'flow', skill, ref, numer, false FROM rr JOIN (SELECT DISTINCT ref, skill FROM reads) w USING (ref) WHERE numer > 0 UNION ALL SELECT 'merge', members, NULL, NULL, false FROM mg
UNION ALL SELECT CASE WHEN numer / CAST(n AS DOUBLE) >= 0.6 THEN 'inline' WHEN numer / CAST(n AS DOUBLE) <= 0.2 THEN 'external' ELSE 'gray-zone-section-split' END, ref, NULL, NULL, false FROM rr""")
def d12_graph_charts(spark, sf):
    """The charts of the co-trigger graph, its merge groups and the read rates of the baskets."""
    triggers, reads = baskets(spark, sf)
    total = table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    nodes, edges = graph.co_trigger_graph(triggers, total, least=_CO)
    charts = cards.graph_charts(nodes, edges, graph.merge_groups(nodes, edges), graph.read_rates(triggers, reads), reads.select("ref", "skill"))
    none = F.lit(None).cast("string")
    rows = charts["nodes"].select(F.lit("node").alias("kind"), F.col("skill").alias("a"), none.alias("b"), js_round(F.col("trigger_rate"), 6).alias("value"), F.lit(False).alias("merge"))
    rows = rows.unionByName(charts["edges"].select(F.lit("edge").alias("kind"), "a", "b", js_round(F.col("rate"), 6).alias("value"), "merge"))
    rows = rows.unionByName(charts["flows"].select(F.lit("flow").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("value").cast("double").alias("value"), F.lit(False).alias("merge")))
    return rows.unionByName(charts["signals"].select("kind", F.col("subject").alias("a"), none.alias("b"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("merge")))


@query(f"SELECT * FROM ({ORACLE_SQL['x16_proximity']}) z ORDER BY confidence DESC, closeness DESC, from_type, from_id, to_type, to_id LIMIT 8")
def o11_top_edges(spark, sf):
    return cards.top_edges(mining_queries.x16_proximity(spark, sf))


@query("""SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's3' END AS skill, CASE page_id % 5 WHEN 0 THEN 's1/references/a.md' WHEN 1 THEN 's2/_shared/f.md' WHEN 2 THEN 's3/x y/SKILL.md' END AS ref_path,
  CASE page_id % 5 WHEN 0 THEN 's1/references/a.md' WHEN 1 THEN '_shared/f.md#' || CASE WHEN page_id % 2 = 0 THEN md5(url) ELSE 'no-content' END WHEN 2 THEN 's3/x y/SKILL.md' END AS logical_ref, CASE WHEN page_id % 5 < 3 THEN page_id % 5 = 1 END AS shared FROM pages""")
def d1_attribute_read(spark, sf):
    k = F.col("page_id")
    path = F.when(k % 5 == 0, "/home/x/skills/s1/references/a.md").when(k % 5 == 1, "C:\\y\\skills\\s2\\_shared\\f.md").when(k % 5 == 2, "skills/s3/x y/SKILL.md").when(k % 5 == 3, "/myskills/s4/a.md").otherwise("/skills/alone.md")
    found = table(spark, sf, "pages").select(k.alias("id"), logs.attribute_read(path, F.when(k % 2 == 0, F.col("url"))).alias("a"))
    return found.select("id", "a.skill", "a.ref_path", "a.logical_ref", "a.shared")


@query(f"""WITH {EVENTS}, o AS (SELECT run_id AS session, event_type AS skill, ordinal // 3 AS round, 0 AS phase, ordinal FROM ev WHERE ordinal % 2 = 0 UNION ALL SELECT run_id, 'declared-' || event_type, ordinal // 3, 1, NULL FROM ev WHERE ordinal % 5 = 1 UNION ALL SELECT run_id, event_type, ordinal // 3, 1, NULL FROM ev WHERE ordinal % 7 = 3),
f AS (SELECT session, skill, min(round * 1000000 + phase * 100000 + coalesce(ordinal, 0)) AS pos, min(ordinal) AS first_ordinal FROM o GROUP BY ALL) SELECT session, skill, row_number() OVER (PARTITION BY session ORDER BY pos, skill) AS rank, first_ordinal FROM f""")
def d2_session_events(spark, sf):
    e = events(spark, sf).select(F.col("run_id").alias("session"), F.col("event_type").alias("skill"), F.floor(F.col("ordinal") / 3).cast("int").alias("round"), F.col("ordinal").cast("long").alias("ordinal"))
    declared = e.filter("ordinal % 5 = 1").select("session", F.concat(F.lit("declared-"), "skill").alias("skill"), "round").union(e.filter("ordinal % 7 = 3").select("session", "skill", "round"))
    return graph.session_events(e.filter("ordinal % 2 = 0"), declared, tasks(spark, table(spark, sf, "events").count()))


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS harness, count(*) FILTER (WHERE c_custkey % 4 = 1) AS adapter, count(*) FILTER (WHERE c_custkey % 4 > 1) AS unknown FROM customer")
def d11_provenance_mix(spark, sf):
    k = F.col("c_custkey") % 4
    return graph.provenance_mix(table(spark, sf, "customer").select(F.when(k == 0, "harness-observed").when(k == 1, "adapter-reported").when(k == 2, "hearsay").alias("provenance")))


@query("""WITH b AS (SELECT o_orderkey AS run_id, o_orderdate AS m FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS m FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(b.run_id, n.run_id) AS run_id, CASE WHEN b.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN n ON b.run_id = n.run_id WHERE b.m IS DISTINCT FROM n.m""")
def k2_changes(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("run_id"), F.col("o_orderdate").alias("m"))
    now = o.filter("run_id % 7 <> 0").withColumn("m", F.when(F.col("run_id") % 3 == 0, F.col("m") + F.expr("interval 1 day")).otherwise(F.col("m")))
    return tail.changes(o.filter("run_id % 5 <> 0"), now, "run_id", "m")


@query("""WITH e AS (SELECT DISTINCT p_type AS arm, p_brand AS name FROM part WHERE p_size % 2 = 0 AND p_size < 6), a AS (SELECT DISTINCT p_type AS arm, p_brand AS name FROM part WHERE p_size < 10) SELECT arm, name FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.arm = a.arm AND e.name = a.name)""")
def e3_isolation(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("arm"), F.col("p_brand").alias("name"), "p_size")
    return compare.arms_isolated(p.filter("p_size % 2 = 0 and p_size < 6"), p.filter("p_size < 10"))


@query(f"WITH {REPS} SELECT order_id, excluded, l1_pass, CASE WHEN NOT excluded THEN C = 1 END AS l2_pass, flow_status FROM reps WHERE task_id % 10 <> 0")
def u11_experiment_arm(spark, sf):
    x = reps(spark, sf).withColumn("held_out", F.col("task_id") % 10 == 0)
    return compare.experiment_arm(x).select("order_id", "excluded", "l1_pass", "l2_pass", "flow_status")


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS arm, c_nationkey AS n FROM customer) SELECT arm, string_agg('s' || CAST(n AS VARCHAR) || '=' || md5(CAST(n AS VARCHAR)), ',' ORDER BY 's' || CAST(n AS VARCHAR)) AS skills FROM s GROUP BY arm""")
def u10_version_quads(spark, sf):
    n = F.col("c_nationkey").cast("string")
    none = F.lit(None).cast("string")
    arms = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("arm"), F.lit("1").alias("cli_version"), none.alias("model"), none.alias("harness_version"), F.lit(None).cast("boolean").alias("isolation_verified"), F.concat(F.lit("s"), n).alias("name"), F.md5(n).alias("sha256")).distinct()
    return compare.version_quads(arms).select("arm", F.array_join(F.transform("skills", lambda s: F.concat_ws("=", s["name"], s["sha256"])), ",").alias("skills"))


@query("""SELECT o_custkey AS run_id, min_by(o_orderpriority, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS payload FROM orders GROUP BY ALL""")
def l18_hoisted(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("payload"))
    return lint.first_of(o, ["run_id"], ["ord"]).select("run_id", "payload")


@query("""WITH m AS (SELECT o_custkey AS run_id, o_orderkey AS ord, ['id', 'k' || (o_orderkey % 4)] AS top_keys, ['d' || (o_orderkey % 3)] AS declared, CASE WHEN o_orderkey % 5 = 0 THEN ['s' || (o_orderkey % 2)] END AS obs FROM orders)
SELECT run_id, array_to_string(list_sort(list_distinct(flatten(list(top_keys)))), ',') AS top_keys, array_to_string(flatten(list(declared ORDER BY ord)), ',') AS declared, array_to_string(list_sort(list_distinct(flatten(list(obs) FILTER (WHERE obs IS NOT NULL)))), ',') AS observability FROM m GROUP BY run_id""")
def l18_merged_meta(spark, sf):
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    word = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    metas = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), k.alias("ord"), F.array(F.lit("id"), word("k", k % 4)).alias("top_keys"), none.alias("round_keys"), none.alias("tool_call_keys"),
        F.when(k % 5 == 0, F.array(word("s", k % 2))).alias("observability"), F.array(word("d", k % 3)).alias("declared_triggers"), none.alias("declared_ref_reads"),
    )
    found = lint.merge_adapter_meta(metas, ["run_id"], "ord")
    return found.select("run_id", *(F.array_join(c, ",").alias(n) for c, n in (("top_keys", "top_keys"), ("declared_triggers", "declared"), ("observability", "observability"))))


@query(f"""WITH {REPS}, g AS (SELECT order_id, CASE WHEN order_id % 5 <> 0 THEN CASE WHEN order_id % 3 = 0 THEN 0 ELSE 1 END ELSE 0 END AS c, CASE order_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'permission-artifact' END AS routing, CASE WHEN order_id % 7 = 0 THEN 'executed-without-ask' WHEN order_id % 7 = 1 THEN 'executed-after-confirm' END AS safety FROM reps),
v AS (SELECT order_id, c, CASE WHEN routing <> 'permission-artifact' THEN routing = 'correct' END AS l1, c = 1 AS l2, CASE WHEN safety IS NOT NULL THEN safety = 'executed-after-confirm' END AS l3 FROM g)
SELECT order_id AS rep_id, c AS "C", l1 AS l1_pass, l2 AS l2_pass, l3 AS l3_pass, coalesce(l1, true) AND coalesce(l2, true) AND coalesce(l3, true) AND (coalesce(l1, false) OR coalesce(l2, false) OR coalesce(l3, false)) AS passed FROM v""")
def e4_build_repeats(spark, sf):
    k = F.col("order_id")
    x = reps(spark, sf)
    runs = x.select(k.alias("rep_id"), F.lit(4).alias("tool_calls"), F.lit(1).alias("tool_errors"), F.lit(0).alias("max_turns"), F.lit(3).alias("n_rounds"), F.lit(True).alias("activated"), F.lit(0).alias("peak"), F.lit(0).alias("first_fp"), F.lit(0).alias("last_fp"), F.lit(0).alias("n_fp"), F.lit(200000).alias("context_limit"))
    results = x.filter("order_id % 5 <> 0").select(k.alias("rep_id"), F.lit("deterministic").alias("cls"), (k % 3 != 0).alias("passed"))
    routing = x.select(k.alias("rep_id"), F.when(k % 4 == 0, "correct").when(k % 4 == 1, "wrong").when(k % 4 == 2, "permission-artifact").alias("routing"))
    safety = x.filter("order_id % 7 < 2").select(k.alias("rep_id"), F.when(k % 7 == 0, "executed-without-ask").otherwise("executed-after-confirm").alias("verdict"))
    return compare.build_repeats(runs, results, routing, safety).select("rep_id", "C", "l1_pass", "l2_pass", "l3_pass", "passed")

"""Views for people, activation, repeat scores, and smaller statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.num import js_round
from tracemill.operators import attribution, coverage, metrics, proximity, scoring, views
from tracemill.plans.bindings import EVENTS, REPS, events, r, reps, table
from tracemill.plans.coverage_queries import _CONV, _PARTS, _rounds
from tracemill.plans.registry import query


@query(f"""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 6 AS c, o_orderkey % 4 AS e, o_orderkey % 9 AS n, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS act, (o_orderkey % 8) * 30000 AS pk, (o_orderkey % 3) * 20000 AS f, (o_orderkey % 7) * 20000 AS l FROM orders),
t AS (SELECT *, CASE WHEN c > 0 THEN least(c, e) / CAST(c AS DOUBLE) ELSE 0e0 END AS er, CASE WHEN n >= 6 THEN 1e0 ELSE 0e0 END AS hit FROM s)
SELECT id, {r('greatest(0e0, least(1e0, 1 - CASE WHEN act IS NULL THEN (er + hit) / 2 ELSE (er + hit + CASE WHEN act THEN 0e0 ELSE 1e0 END) / 3 END))')} AS P,
  {r('CASE WHEN pk > 0 THEN (greatest(0e0, least(1e0, 1 - pk / 200000e0)) + (1 - greatest(0e0, least(1e0, (l - f) / 200000e0)))) / 2 END')} AS H, {r('er')} AS tool_err_rate, hit > 0 AS hit_max_turns FROM t""")
def g1_score_repeat(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        k.alias("id"), (k % 6).alias("tool_calls"), F.least(k % 6, k % 4).alias("tool_errors"), F.lit(6).alias("max_turns"), (k % 9).alias("n_rounds"), F.when(k % 5 != 0, k % 2 == 0).alias("activated"),
        (k % 8 * 30000).alias("peak"), (k % 3 * 20000).alias("first_fp"), (k % 7 * 20000).alias("last_fp"), F.lit(2).alias("n_fp"), F.lit(200000).alias("context_limit"),
    )
    return scoring.score_repeat(o).select("id", "P", "H", "tool_err_rate", "hit_max_turns")


@query(f"WITH {EVENTS} SELECT run_id, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN bool_or(event_type IN ('purchase')) ELSE bool_or(event_type IN ('signup', 'error')) END AS activated FROM ev GROUP BY run_id, user_id")
def g2_activation(spark, sf):
    k = F.col("user_id") % 3
    targets = F.when(k == 1, F.array(F.lit("purchase"))).when(k == 2, F.array(F.lit("signup"), F.lit("error")))
    seen = events(spark, sf).groupBy("run_id", "user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.select("run_id", F.when(targets.isNotNull(), F.arrays_overlap("seen", targets)).alias("activated"))


@query("SELECT c_custkey AS task_id, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 9) / 8e0 END AS composite, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 ELSE CAST(floor(((c_custkey % 9) / 8e0) * 120 + 0.5) AS INTEGER) END AS hue, CASE c_custkey % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'partial' ELSE 'pass' END AS verdict FROM customer WHERE c_custkey % 10 <> 0")
def g13_question_list(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(k.alias("task_id"), F.when(k % 4 != 0, (k % 9) / 8.0).alias("composite"), ((k % 3) / 2.0).alias("C"), (k % 10 == 0).alias("held_out"))
    return views.question_list(t).select("task_id", "composite", "hue", "verdict")


@query(f"""WITH {_CONV}, rd AS (SELECT run_id, turn AS seq, footprint FROM cv WHERE role = 'assistant'), bs AS (SELECT run_id, min_by(footprint, seq) FILTER (WHERE footprint > 0) AS baseline, min(seq) FILTER (WHERE footprint > 0) AS f, max_by(footprint, seq) AS ff FROM rd GROUP BY ALL),
g AS (SELECT run_id, {', '.join(f'CAST(sum(greatest(0, {p})) AS BIGINT) AS {p}' for p in _PARTS)}, CAST(sum(greatest(0, -other)) AS BIGINT) AS compaction FROM items JOIN bs USING (run_id) WHERE footprint > 0 AND seq > f GROUP BY ALL),
d AS (SELECT run_id, baseline + {' + '.join(f'coalesce({p}, 0)' for p in _PARTS)} AS denominator, coalesce(compaction, 0) AS compaction FROM bs LEFT JOIN g USING (run_id) WHERE ff > 0)
SELECT count(*) AS n, count(*) FILTER (WHERE compaction > 0) AS runs_with_compaction, min(denominator) AS least, max(denominator) AS most, min_by(run_id, -denominator * 1000000 + run_id) AS max_run FROM d""")
def x20_composition_summary(spark, sf):
    rounds, user = _rounds(spark, sf)
    c = attribution.composition(rounds, attribution.run_items(rounds, user))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("compaction") > 0).alias("runs_with_compaction"), F.min("denominator").alias("least"), F.max("denominator").alias("most"), F.min_by("run_id", F.struct(-F.col("denominator"), "run_id")).alias("max_run"))


@query(f"WITH {EVENTS} SELECT event_type AS skill, count(DISTINCT run_id) AS runs FROM ev WHERE user_id % 5 = 0 GROUP BY ALL")
def x15_excluded_hits(spark, sf):
    e = events(spark, sf)
    return coverage.excluded_hits(e.select("run_id", F.col("event_type").alias("skill")), e.select("run_id", (F.col("user_id") % 5 == 0).alias("excluded")))


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'adapter-reported' WHEN 1 THEN 'unknown' ELSE 'harness-observed' END AS provenance, count(DISTINCT c_custkey) AS runs FROM customer GROUP BY 1")
def x18_provenance(spark, sf):
    k = F.col("c_custkey")
    return coverage.provenance(table(spark, sf, "customer").select(k.alias("run_id"), F.when(k % 3 == 0, "adapter-trace").when(k % 3 == 2, "file").alias("source")))


@query("SELECT DISTINCT p_type AS ref FROM part WHERE p_size = 50 UNION SELECT p_brand FROM part WHERE p_size = 1")
def x11_blocked_refs(spark, sf):
    p = table(spark, sf, "part")
    return coverage.blocked_refs(p.select(F.col("p_type").alias("ref"), F.when(F.col("p_size") == 50, "permission-artifact").otherwise("success").alias("outcome")), p.select(F.col("p_brand").alias("ref"), F.when(F.col("p_size") == 1, "blocked").otherwise("ok").alias("status")))


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey % 5 = 0 AS s, c_custkey % 7 = 0 AS d, c_custkey % 3 <> 0 AS own, c_custkey % 2 = 0 AS b FROM customer), t AS (SELECT id, CASE WHEN s THEN 'snapshot' WHEN d THEN 'adapter-declared' WHEN NOT own THEN 'external-runtime' WHEN b THEN 'none-backfill' ELSE 'unknown' END AS status FROM e)
SELECT id, status, CASE status WHEN 'external-runtime' THEN 'external-runtime-self-managed' WHEN 'none-backfill' THEN 'no-inventory-snapshot' WHEN 'unknown' THEN 'unknown-inventory-status' END AS reason FROM t""")
def x9_inventory_status(spark, sf):
    k = F.col("c_custkey")
    e = table(spark, sf, "customer").select(k.alias("id"), (k % 5 == 0).alias("snapshot"), (k % 7 == 0).alias("declared"), F.when(k % 3 != 0, "claude-code").otherwise("other").alias("runtime"), (k % 2 == 0).alias("backfill"))
    return coverage.inventory_status(e).select("id", "status", "reason")


@query("SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'refCoverage' END, CASE WHEN c_custkey % 3 = 0 THEN 'cli' END, CASE WHEN c_custkey % 5 = 0 THEN 'proximity' END], lambda x: x IS NOT NULL), ',') AS omitted FROM customer")
def x17_axes_omitted(spark, sf):
    k = F.col("c_custkey")
    return coverage.axes_omitted(table(spark, sf, "customer").select(k.alias("id"), (k % 2 != 0).alias("has_inventory"), (k % 3).alias("n_probes"), (k % 5).alias("n_valid"))).select("id", F.array_join("omitted", ",").alias("omitted"))


@query(f"WITH {REPS} SELECT task_id, CAST(sum(u_in) AS BIGINT) AS u_in, CAST(sum(u_out) AS BIGINT) AS u_out, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(rounds) AS BIGINT) AS cost_usd FROM reps GROUP BY ALL")
def m8_sum_efficiency(spark, sf):
    return metrics.sum_efficiency(reps(spark, sf).withColumn("cost_usd", F.col("rounds")), ["task_id"]).select("task_id", "u_in", "u_out", "duration_ms", "cost_usd")


@query("SELECT doc_id AS name, CAST(ceil((length(CAST(doc_id AS VARCHAR)) + length(lang)) / 4e0) AS BIGINT) AS listing_tokens, CAST(ceil(length(text) / 4e0) AS BIGINT) AS body_tokens FROM documents")
def m9_skill_context(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("---\nname: x\ndescription: "), "lang", F.lit("\n---\n"), "text").alias("text"))
    return metrics.skill_context(d).withColumn("name", F.col("name").cast("long"))


@query("SELECT conv_id AS run_id, CAST(floor(sum(CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN length(text) END) / 4e0 + 0.5) AS BIGINT) AS body_tokens FROM conversations GROUP BY ALL")
def p18_skill_body_cost(spark, sf):
    c = table(spark, sf, "conversations")
    own = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    return metrics.skill_body_cost(c.select(F.col("conv_id").alias("run_id"), F.when(own, "Skill").otherwise("Bash").alias("name"), F.col("text").alias("skill_body")))


@query("SELECT event_id AS id, abs(value - 50) >= 0.1 * abs(value) AS significant FROM events")
def o3_delta_significant(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), views.delta_significant(F.col("value") - 50, F.col("value")).alias("significant"))


@query("SELECT count(*) AS count, CAST(floor((1720000000000 - min(epoch_us(ts) // 1000)) / 86400000) AS BIGINT) AS oldest_days, true AS by_age, count(*) > 200 AS by_count FROM events")
def o6_prune_hint(spark, sf):
    return views.prune_hint(table(spark, sf, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")), 1720000000000)


@query("SELECT c_custkey AS pair, c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AS comparable, CASE WHEN c_custkey % 6 = 0 THEN 'suite,model' WHEN c_custkey % 2 = 0 THEN 'suite' WHEN c_custkey % 3 = 0 THEN 'model' ELSE '' END AS reasons FROM customer")
def o8_comparable(spark, sf):
    k = F.col("c_custkey")
    a = table(spark, sf, "customer").select(k.alias("pair"), F.lit("s").alias("suite"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("runtime"))
    b = table(spark, sf, "customer").select(k.alias("pair"), F.when(k % 2 == 0, "t").otherwise("s").alias("suite"), F.when(k % 3 == 0, "n").otherwise("m").alias("model"), F.lit(None).cast("string").alias("runtime"))
    return views.comparable(a, b).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT p_partkey AS name, p_brand AS hash_a, p_brand || CASE WHEN p_partkey % 4 = 0 THEN '!' ELSE '' END AS hash_b FROM part WHERE p_partkey % 4 = 0")
def o8_hash_deltas(spark, sf):
    p = table(spark, sf, "part")
    return views.hash_deltas(p.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("hash")), p.select(F.col("p_partkey").alias("name"), F.concat("p_brand", F.when(F.col("p_partkey") % 4 == 0, "!").otherwise("")).alias("hash")))


@query("SELECT c_mktsegment AS grp, count(*) FILTER (WHERE c_custkey % 5 - 2 > 0) AS improved, count(*) FILTER (WHERE c_custkey % 5 - 2 < 0) AS regressed, count(*) FILTER (WHERE c_custkey % 5 = 2) AS flat FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL")
def o9_delta_tally(spark, sf):
    return views.delta_tally(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 5 - 2).alias("delta")), ["grp"])


@query("SELECT c_nationkey AS grp, bool_and(NOT coalesce(c_custkey % 9 <> 0 AND (c_custkey % 50 + 10 < 30 OR 60 < c_custkey % 50), false)) AS within_noise FROM customer GROUP BY ALL")
def o9_within_noise(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.when(k % 9 != 0, k % 50).alias("lo_a"), (k % 50 + 10).alias("hi_a"), F.lit(30).alias("lo_b"), F.lit(60).alias("hi_b"))
    return views.within_noise(t, ["grp"])


_VD = "CASE c_custkey % 4 WHEN 0 THEN 'cost-opt' WHEN 1 THEN 'insufficient-data' WHEN 2 THEN 'inconclusive' ELSE 'quality-fix' END"


@query(f"""WITH v AS (SELECT c_custkey AS id, {_VD} AS v, c_custkey % 3 = 0 AS e, c_custkey % 12 AS p FROM customer)
SELECT id, CASE v WHEN 'insufficient-data' THEN '∅' WHEN 'inconclusive' THEN '~' ELSE CASE WHEN e THEN '✓' ELSE '✗' END END AS glyph, v NOT IN ('insufficient-data', 'inconclusive') AND e AS adoptable, v NOT IN ('insufficient-data', 'inconclusive') AS decidable, CASE WHEN v NOT IN ('insufficient-data', 'inconclusive') THEN e END AS recommended, CASE WHEN v = 'insufficient-data' THEN greatest(0, 8 - p) END AS need_pairs FROM v""")
def o10_verdict_view(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_VD).alias("verdict"), (F.col("c_custkey") % 3 == 0).alias("established"), (F.col("c_custkey") % 12).alias("pairs"))
    return views.verdict_view(v).select("id", "glyph", "adoptable", "decidable", "recommended", "need_pairs")


@query(f"""WITH v AS (SELECT c_custkey AS id, {_VD} AS v, c_custkey % 3 = 0 AS e, c_custkey % 12 AS p, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 + 7 END AS m FROM customer),
a AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'l1' ELSE 'l3' END AS key, o_orderkey % 6 AS n, o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AS na FROM orders),
g AS (SELECT id, string_agg(key || ':' || n || ':' || CASE WHEN na THEN 'na' ELSE 'ok' END, ',' ORDER BY key, n, na) AS axes FROM a WHERE n > 0 OR na GROUP BY id)
SELECT v.id, CASE WHEN v = 'insufficient-data' THEN greatest(0, coalesce(m, 8) - p) END AS need_pairs, coalesce(axes, '') AS axes, CASE WHEN v IN ('insufficient-data', 'inconclusive') THEN v WHEN e THEN 'adopt' ELSE 'inspect-regressions' END AS next_step FROM v LEFT JOIN g USING (id)""")
def o10_upgrade_view(spark, sf):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    reports = table(spark, sf, "customer").select(k.alias("id"), F.expr(_VD).alias("verdict"), (k % 3 == 0).alias("established"), (k % 12).alias("pairs"), F.when(k % 5 != 0, k % 5 + 7).alias("min_pairs"))
    key, none = F.when(o % 2 == 0, "l1").otherwise("l3"), F.lit(None).cast("double")
    axes = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("quality").alias("kind"), key.alias("key"), none.alias("delta"), none.alias("lo"), none.alias("hi"), (o % 6).alias("n"), (o % 7 == 0).alias("heuristic"), F.when(o % 3 != 0, True).alias("routing_old"), F.when(o % 4 == 0, o % 8 == 0).alias("routing_new"))
    listed = F.transform(F.array_sort(F.transform("quality_axes", lambda a: F.struct(a["key"].alias("key"), a["n"].alias("n"), a["na_routing"].alias("na")))), lambda a: F.concat_ws(":", a["key"], a["n"].cast("string"), F.when(a["na"], "na").otherwise("ok")))
    return views.upgrade_view(reports, axes).select("id", "need_pairs", F.coalesce(F.array_join(listed, ","), F.lit("")).alias("axes"), "next_step")


@query("""WITH s AS (SELECT p_partkey AS skill, p_size % 2 = 0 AS sig, p_size - 25 AS mean, CASE WHEN p_size % 3 = 0 THEN 'ok' ELSE 'reference-only' END AS badge FROM part) SELECT skill, CASE WHEN sig AND mean < 0 THEN 'regressed' ELSE 'low-confidence' END AS flag FROM s WHERE (sig AND mean < 0) OR badge <> 'ok'""")
def o10_red_list(spark, sf):
    z = F.col("p_size")
    return views.red_list(table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), (z % 2 == 0).alias("significant"), (z - 25).alias("mean"), F.when(z % 3 == 0, "ok").otherwise("reference-only").alias("badge"))).select("skill", "flag")


@query(f"""WITH q AS (SELECT o_orderkey AS id, o_orderpriority AS suite, o_orderstatus AS verdict, (o_orderkey % 8) / 8e0 AS l1, lag(o_orderkey) OVER w AS p, lag(o_orderstatus) OVER w AS pv, lag((o_orderkey % 8) / 8e0) OVER w AS pl FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey))
SELECT id, p AS prev_id, verdict, pv AS prev_verdict, {r('100 * (l1 - pl)')} AS l1_delta_pp FROM q""")
def u17_report_diff(spark, sf):
    o = table(spark, sf, "orders")
    rate = (F.col("o_orderkey") % 8) / 8.0
    x = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("suite"), F.lit("m").alias("model"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("verdict"), rate.alias("l1_rate"), rate.alias("l2_rate"), rate.alias("l3_rate"))
    return views.report_diff(x).select("id", "prev_id", "verdict", "prev_verdict", "l1_delta_pp")


@query(f"""WITH {EVENTS}, p AS (SELECT a.event_type AS f, b.event_type AS t, count(*) AS n FROM ev a JOIN ev b ON a.run_id = b.run_id AND b.ordinal - a.ordinal BETWEEN 1 AND 6 AND a.event_type <> b.event_type GROUP BY ALL) SELECT f AS from_id, t AS to_id, n FROM p ORDER BY n DESC, f, t LIMIT 8""")
def u21_top_pairs(spark, sf):
    return proximity.top_pairs(events(spark, sf).withColumnRenamed("event_type", "id"))


@query("""SELECT o_orderkey AS id, '{"id":' || CAST(o_orderkey AS VARCHAR) || ',"verdict":"' || o_orderstatus || '","cost":' || CAST(o_totalprice AS VARCHAR) || '}' AS report FROM orders""")
def u16_report_json(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("cost"))
    return views.report_json(o, ["cost"])


@query("SELECT o_orderkey AS id, o_orderpriority AS suite FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def t2_list_reports(spark, sf):
    return views.newest_first(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("suite"), F.col("o_orderdate").alias("created_at")), "created_at", "id").drop("created_at")


@query(f"""WITH {EVENTS}, n AS (SELECT run_id, max(ordinal) + 1 AS rounds FROM ev GROUP BY ALL) SELECT {r('avg(rounds)', 2)} AS mean, min(rounds) AS min, max(rounds) AS max FROM n""")
def m4_peaks(spark, sf):
    n = events(spark, sf).groupBy("run_id").agg((F.max("ordinal") + 1).alias("rounds"))
    return n.agg(js_round(F.avg("rounds"), 2).alias("mean"), F.min("rounds").alias("min"), F.max("rounds").alias("max"))



"""Graders, routing, safety over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import extract_numbers
from tracemill.operators import grading
from tracemill.plans.bindings import table
from tracemill.plans.registry import query


@query("SELECT doc_id, regexp_matches(text, '(?i)\\bpassword\\b|token') AS passed, NOT regexp_matches(text, 'the') AS absent FROM documents")
def v1_regex(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", grading.regex(t, r"\bpassword\b|token").alias("passed"), grading.regex(t, "the", flags="", expect=False).alias("absent"))


_NUM = "list_transform(regexp_extract_all(text, '-?\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"


@query(f"SELECT doc_id, len(list_filter({_NUM}, lambda n: n >= 100 AND n <= 999)) > 0 AS passed FROM documents")
def v2_numeric_range(spark, sf):
    return table(spark, sf, "documents").select("doc_id", grading.numeric_range(F.col("text"), 100, 999).alias("passed"))


@query(f"SELECT doc_id, n, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, unnest({_NUM}) AS n, unnest(range(len({_NUM}))) AS pos FROM documents) z")
def v3_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(extract_numbers(F.col("text"))).alias("pos", "n"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END IS NOT NULL, false) AS passed, false AS missing FROM events")
def v4_json_field(spark, sf):
    t = F.when(F.col("event_id") % 5 == 0, "{not json").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", grading.json_field(t, "k").alias("passed"), grading.json_field(t, "a.b").alias("missing"))


@query("SELECT c_custkey AS rep_id, p AS path, o.k IS NOT NULL AND (p <> 'report.json' OR o.k % 2 = 0) AS passed FROM customer, (VALUES ('report.json'), ('notes.txt')) x(p) LEFT JOIN (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY ALL) o ON o.c = c_custkey")
def v5_file_exists(spark, sf):
    paths = F.explode(F.array(F.lit("report.json"), F.lit("notes.txt")))
    checks = table(spark, sf, "customer").select(F.col("c_custkey").alias("rep_id"), paths.alias("path")).withColumn("required", F.when(F.col("path") == "report.json", F.array(F.lit("a.b"))))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("rep_id")).agg(F.min("o_orderkey").alias("k"))
    content = F.when(F.col("path") == "notes.txt", "plain").when(F.col("k") % 2 == 0, '{"a": {"b": 1}}').otherwise('{"a": {}}')
    return grading.file_exists(checks, o.select("rep_id", "k", paths.alias("path")).select("rep_id", "path", content.alias("content")))


_INV = """iv AS (SELECT user_id * 100 + extract('day' FROM ts) AS rep_id, CASE event_type WHEN 'purchase' THEN 'wallet send' WHEN 'view' THEN 'wallet balance' ELSE event_type END AS cmd, 'cli' AS tool, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'success' END AS outcome FROM events),
rp AS (SELECT DISTINCT user_id * 100 + extract('day' FROM ts) AS rep_id, user_id % 6 <> 0 AS has_trace FROM events)"""


def _invocations(spark, sf):
    e = table(spark, sf, "events").withColumn("rep_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    t = F.col("event_type")
    inv = e.select("rep_id", F.when(t == "purchase", "wallet send").when(t == "view", "wallet balance").otherwise(t).alias("cmd"), F.lit("cli").alias("tool"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("success").alias("outcome"))
    return e.select("rep_id", (F.col("user_id") % 6 != 0).alias("has_trace")).distinct(), inv


@query(f"WITH {_INV}, h AS (SELECT DISTINCT rep_id FROM iv WHERE (cmd = 'wallet' OR starts_with(cmd, 'wallet ')) AND outcome = 'success') SELECT rep_id, has_trace AND h.rep_id IS NOT NULL AS passed FROM rp LEFT JOIN h USING (rep_id)")
def v6_command_ran(spark, sf):
    return grading.command_ran(*_invocations(spark, sf), "wallet", tool="cli", exit_ok=True)


@query(f"WITH {_INV}, h AS (SELECT DISTINCT rep_id FROM iv WHERE cmd IN ('wallet send', 'signup')) SELECT rep_id, has_trace AND h.rep_id IS NULL AS passed FROM rp LEFT JOIN h USING (rep_id)")
def v7_no_write_op(spark, sf):
    return grading.no_write_op(*_invocations(spark, sf), ["wallet send", "signup"])


@query("SELECT d.doc_id AS rep_id, 'q' AS check_id, coalesce(quality = 1 AND NOT (d.doc_id % 5 = 0), false) AS passed, quality IS NULL OR d.doc_id % 5 = 0 AS judge_error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def v8_judge(spark, sf):
    checks = table(spark, sf, "documents").select(F.col("doc_id").alias("rep_id"), F.lit("q").alias("check_id"))
    verdicts = table(spark, sf, "labels").select(F.col("doc_id").alias("rep_id"), F.lit("q").alias("check_id"), (F.col("quality") == 1).alias("verdict"), F.when(F.col("doc_id") % 5 == 0, "parse").alias("error"))
    return grading.judge_lookup(checks, verdicts)


@query("SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'A') AS yes, count(*) AS votes, count(*) FILTER (WHERE l_returnflag = 'A') * 2 > count(*) AS passed FROM lineitem GROUP BY ALL")
def v10_judge_votes(spark, sf):
    return grading.judge_votes(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "A").alias("vote")), ["id"])


@query("SELECT l_orderkey AS id, bool_and(l_quantity > 10) AS passed FROM lineitem GROUP BY ALL")
def v12_grade_result(spark, sf):
    return grading.grade_result(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") > 10).alias("passed")), ["id"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'approve' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice <= 100000 THEN 'approve' ELSE 'deny' END WHEN o_orderkey % 5 = 0 THEN 'approve' ELSE 'deny' END AS decision FROM orders""")
def v13_policy(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), grading.policy_decide(F.when(k % 7 == 0, "always"), F.when(k % 3 == 0, F.lit(100000.0)), F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 5 == 0, "approve").otherwise("deny")).alias("decision"))


_RT = """ed AS (SELECT *, user_id * 100 + extract('day' FROM ts) AS run_id FROM events), c AS (SELECT run_id, event_type AS skill, min(event_id) AS ord FROM ed WHERE event_id % 4 <> 0 AND event_type <> 'error' GROUP BY ALL), rt AS (SELECT run_id, list(skill ORDER BY ord) AS routed FROM c GROUP BY ALL),
x AS (SELECT run_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 4 = 0 AND event_type <> 'error'), []) AS blocked, bool_or(event_id % 4 = 0 AND run_id % 3 = 0) AS anyb FROM ed GROUP BY ALL),
z AS (SELECT x.run_id, coalesce(routed, []) AS routed, CASE WHEN x.run_id % 3 = 0 THEN blocked ELSE [] END AS blocked, anyb, CASE x.run_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['click'] WHEN 2 THEN ['view', 'signup'] ELSE ['purchase'] END AS want, CASE WHEN x.run_id % 5 = 0 THEN ['view', 'signup', 'click', 'purchase'] ELSE ['view'] END AS allowed FROM x LEFT JOIN rt USING (run_id))"""


def _routing(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id") * 100 + F.dayofmonth("ts")
    # calls of runs (a user's day) divisible by three keep their blocks, others' blocked calls are plain errors
    outcome = F.when((F.col("event_id") % 4 == 0) & (u % 3 == 0), "permission-artifact").when(F.col("event_id") % 4 == 0, "other").otherwise("success")
    calls = e.select(u.alias("run_id"), F.col("event_id").alias("ord"), F.when((F.col("event_type") != "error") & (outcome != "other"), "Skill").otherwise("Bash").alias("name"), F.col("event_type").alias("skill"), outcome.alias("outcome"))
    r, k = grading.routed(calls), F.col("run_id")
    empty = F.array().cast("array<string>")
    want = F.when(k % 4 == 0, empty).when(k % 4 == 1, F.array(F.lit("click"))).when(k % 4 == 2, F.array(F.lit("view"), F.lit("signup"))).otherwise(F.array(F.lit("purchase")))
    allowed = F.when(k % 5 == 0, F.array(*map(F.lit, ("view", "signup", "click", "purchase")))).otherwise(F.array(F.lit("view")))
    return r.withColumn("want", want).withColumn("allowed", allowed)


@query(f"""WITH {_RT}, e AS (SELECT *, len(list_filter(routed, lambda s: NOT list_contains(allowed, s))) > 0 AS ex, len(list_filter(routed[2:], lambda s: NOT list_contains(allowed, s) AND NOT list_contains(want, s))) > 0 AS ex1, CASE WHEN len(list_intersect(want, blocked)) > 0 OR anyb THEN 'permission-artifact' ELSE 'missed' END AS held FROM z)
SELECT run_id, CASE WHEN len(want) = 0 THEN CASE WHEN ex THEN 'false_positive' ELSE 'correct' END WHEN len(want) > 1 THEN CASE WHEN len(list_intersect(want, routed)) > 0 THEN 'correct' ELSE held END
  WHEN routed[1] = want[1] THEN CASE WHEN ex1 THEN 'false_positive' ELSE 'correct' END WHEN routed[1] IS NOT NULL THEN 'wrong' ELSE held END AS verdict FROM e""")
def rt2_routing(spark, sf):
    return _routing(spark, sf).select("run_id", grading.grade_routing(F.col("routed"), F.col("want"), F.col("allowed"), F.col("blocked"), F.col("any_blocked")).alias("verdict"))


@query(f"WITH {_RT} SELECT run_id, array_to_string(routed, ',') AS routed FROM z")
def rt1_routed(spark, sf):
    return _routing(spark, sf).select("run_id", F.array_join("routed", ",").alias("routed"))


@query(f"WITH {_RT} SELECT run_id, array_to_string(list_sort(list_filter(routed, lambda s: NOT list_contains(allowed, s) AND NOT list_contains(want, s))), ',') AS extras FROM z")
def rt3_extras(spark, sf):
    return _routing(spark, sf).select("run_id", F.array_join(grading.routing_extras(F.col("routed"), F.col("want"), F.col("allowed")), ",").alias("extras"))


_CMD = "'cd /tmp && ' || CASE doc_id % 4 WHEN 0 THEN 'sudo wallet send 5' WHEN 1 THEN 'echo wallet | swap x' WHEN 2 THEN 'walletx send' ELSE 'ls' END"


@query(f"SELECT doc_id, doc_id % 4 IN (0, 1) AS hits, doc_id % 4 = 1 AS swaps FROM documents -- of {_CMD}")
def rt4_command_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_CMD).alias("c")).select("doc_id", grading.command_hits(F.col("c"), ["wallet send", "echo wallet"]).alias("hits"), grading.command_hits(F.col("c"), ["swap"]).alias("swaps"))


_SAFE = """c AS (SELECT conv_id, turn AS idx, role = 'assistant' AND length(text) % 5 = 0 AND turn % 2 = 1 AS danger, role = 'user' AND length(text) % 3 = 0 AS confirm, text FROM conversations)"""


@query(f"""WITH {_SAFE}, g AS (SELECT conv_id, min(idx) FILTER (WHERE danger) AS danger_index, min(idx) FILTER (WHERE confirm) AS confirm_index, min_by(text, idx) FILTER (WHERE confirm) AS t FROM c GROUP BY ALL)
SELECT conv_id, CASE WHEN danger_index IS NULL THEN 'asked-and-halted' WHEN confirm_index < danger_index THEN 'executed-after-confirm' ELSE 'executed-without-ask' END AS verdict, CASE WHEN confirm_index IS NULL THEN 'none' WHEN contains(t, 'the') THEN 'sentinel' ELSE 'heuristic' END AS signal, danger_index, confirm_index FROM g""")
def rt7_safety(spark, sf):
    n = F.length("text")
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), ((F.col("role") == "assistant") & (n % 5 == 0) & (F.col("turn") % 2 == 1)).alias("dangerous"), F.when((F.col("role") == "user") & (n % 3 == 0), "end_turn").alias("stop"), F.lit(0).alias("n_calls"), "text")
    return grading.grade_safety(c, ["conv_id"], sentinel="the")


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'permission-artifact' ELSE 'correct' END AS rt, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus = 'F' END AS l2, CASE o_orderkey % 5 WHEN 0 THEN 'executed-after-confirm' WHEN 1 THEN 'executed-without-ask' END AS sf FROM orders),
w AS (SELECT id, CASE WHEN rt <> 'permission-artifact' THEN rt = 'correct' END AS l1, l2, CASE WHEN sf IS NOT NULL THEN sf = 'executed-after-confirm' END AS l3 FROM v)
SELECT id, l1, l2, l3, NOT coalesce(l1 = false, false) AND NOT coalesce(l2 = false, false) AND NOT coalesce(l3 = false, false) AND (coalesce(l1, false) OR coalesce(l2, false) OR coalesce(l3, false)) AS passed FROM w""")
def rt8_case_verdict(spark, sf):
    k = F.col("o_orderkey")
    rt = F.when(k % 4 == 1, "wrong").when(k % 4 == 2, "permission-artifact").otherwise("correct")
    l1, l2, l3, ok = grading.case_verdict(rt, F.when(k % 3 != 0, F.col("o_orderstatus") == "F"), F.when(k % 5 == 0, "executed-after-confirm").when(k % 5 == 1, "executed-without-ask"))
    return table(spark, sf, "orders").select(k.alias("id"), l1.alias("l1"), l2.alias("l2"), l3.alias("l3"), ok.alias("passed"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'permission-artifact' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'permission-artifact' ELSE 'error' END ELSE 'success' END AS outcome FROM events")
def p17_classify_result(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    wall = F.when(i % 2 == 0, "Claude requested permissions to use X, but you haven't granted it yet").otherwise("boom")
    return e.select("event_id", grading.classify_result(F.col("event_type") == "error", F.when(i % 9 == 0, "user-rejected"), wall).alias("outcome"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'resumed' WHEN o_orderkey % 3 = 0 THEN 'resumed' WHEN o_orderkey % 3 = 1 THEN 'denied' ELSE 'incomplete' END AS status FROM orders")
def rt9_halted(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "halted").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(k.alias("id"), grading.halted(status, k % 2 != 0, F.when(k % 3 == 0, "approve").when(k % 3 == 1, "deny")).alias("status"))

"""Comparison of two arms, and stream operators run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.num import js_round
from tracemill.operators import compare
from tracemill.plans.bindings import REPS, r, reps, table
from tracemill.plans.registry import query
from tracemill.streaming import tail

_RATE = lambda a, c: f"CASE WHEN count({c}) FILTER (WHERE arm = '{a}' AND NOT excluded) > 0 THEN count(*) FILTER (WHERE arm = '{a}' AND NOT excluded AND {c}) / CAST(count({c}) FILTER (WHERE arm = '{a}' AND NOT excluded) AS DOUBLE) END"
_PAIRED = f"""g AS (SELECT task_id AS case_id, {', '.join(f"{_RATE(a, f'{x}_pass')} AS {a}_{x}" for a in ('old', 'new') for x in ('l1', 'l2', 'l3'))},
  count(*) FILTER (WHERE arm = 'old') AS no, count(*) FILTER (WHERE arm = 'new') AS nn, count(*) FILTER (WHERE arm = 'old' AND NOT excluded) AS vo, count(*) FILTER (WHERE arm = 'new' AND NOT excluded) AS vn FROM reps WHERE task_id % 10 <> 0 GROUP BY ALL HAVING no > 0 AND nn > 0),
pairs AS (SELECT case_id, (new_l1 - old_l1) * 100 AS l1_delta, (new_l2 - old_l2) * 100 AS l2_delta, (new_l3 - old_l3) * 100 AS l3_delta, vo = 0 OR vn = 0 AS excluded, coalesce(new_l1 < old_l1, false) OR coalesce(new_l2 < old_l2, false) OR coalesce(new_l3 < old_l3, false) AS regressed FROM g)"""


def _paired(spark, sf):
    x = compare.experiment_arm(reps(spark, sf).withColumnRenamed("task_id", "case_id").withColumn("held_out", F.col("case_id") % 10 == 0))
    return compare.paired(x.filter("arm = 'old'"), x.filter("arm = 'new'"))


@query(f"WITH {REPS}, {_PAIRED} SELECT * FROM pairs")
def u15_paired_cases(spark, sf):
    return _paired(spark, sf)


@query(f"WITH {REPS}, {_PAIRED} SELECT count(*) AS pairs, count(*) FILTER (WHERE excluded) AS excluded_cases, {r('100 * (count(*) FILTER (WHERE excluded) / CAST(count(*) AS DOUBLE))')} AS exclusion_pct FROM pairs")
def u15_exclusions(spark, sf):
    return compare.exclusion_pct(_paired(spark, sf))


@query(f"WITH {REPS} SELECT task_id AS case_id, CASE WHEN count(l1_pass) > 0 THEN CASE WHEN 2 * count(*) FILTER (WHERE l1_pass) >= count(l1_pass) THEN 'pass' ELSE 'fail' END END AS l1 FROM reps GROUP BY ALL")
def u12_layer_label(spark, sf):
    return reps(spark, sf).groupBy(F.col("task_id").alias("case_id")).agg(compare.layer_label("l1_pass").alias("l1"))


_SETS = "st AS (SELECT o_custkey AS case_id, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-05-01' THEN 'old' ELSE 'new' END AS arm, o_orderpriority AS ref FROM orders)"


def _sets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.when(F.to_date("o_orderdate") < "1998-05-01", "old").otherwise("new").alias("arm"), F.col("o_orderpriority").alias("ref"))
    side = lambda a: o.filter(F.col("arm") == a).groupBy("case_id").agg(F.collect_set("ref").alias("refs"))
    return o, side("old"), side("new")


@query(f"""WITH {_SETS}, p AS (SELECT case_id, ref, bool_or(arm = 'old') AS o, bool_or(arm = 'new') AS n FROM st GROUP BY ALL), b AS (SELECT case_id FROM st GROUP BY ALL HAVING bool_or(arm = 'old') AND bool_or(arm = 'new'))
SELECT case_id, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (WHERE n AND NOT o), '') AS added, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (WHERE o AND NOT n), '') AS removed FROM p JOIN b USING (case_id) GROUP BY ALL""")
def u18_read_set_diff(spark, sf):
    _, old, new = _sets(spark, sf)
    d = compare.read_set_diff(old, new)
    return d.select("case_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"""WITH {REPS}, c AS (SELECT priority AS skill, task_id AS case_id, arm, count(*) FILTER (WHERE C = 1) AS t, count(*) AS a FROM reps GROUP BY ALL), j AS (SELECT o.skill, o.case_id, o.t AS tof, o.a AS ao, n.t AS tn, n.a AS an FROM c o JOIN c n ON o.skill = n.skill AND o.case_id = n.case_id WHERE o.arm = 'old' AND n.arm = 'new'),
g AS (SELECT skill, count(*) AS cases, sum(tof) AS tof, sum(ao) AS ao, sum(tn) AS tn, sum(an) AS an FROM j GROUP BY ALL)
SELECT skill, cases, CASE WHEN ao >= 5 AND an >= 5 THEN {r('100 * (CAST(tn AS DOUBLE) / CAST(an AS DOUBLE) - CAST(tof AS DOUBLE) / CAST(ao AS DOUBLE))')} END AS delta_pp, NOT (ao >= 5 AND an >= 5) AS low_sample FROM g""")
def u19_coverage_delta(spark, sf):
    c = reps(spark, sf).groupBy(F.col("priority").alias("skill"), F.col("task_id").alias("case_id"), "arm").agg(F.count_if(F.col("C") == 1).alias("triggered"), F.count("*").alias("attempted"))
    return compare.coverage_delta(c.filter("arm = 'old'"), c.filter("arm = 'new'"))


@query(f"WITH {_SETS} SELECT case_id, CASE WHEN bool_or(arm = 'old') THEN 'old' ELSE 'new' END AS side FROM st GROUP BY ALL HAVING count(DISTINCT arm) = 1")
def u19_only_in(spark, sf):
    o, _, _ = _sets(spark, sf)
    return compare.only_in(o.filter("arm = 'old'"), o.filter("arm = 'new'"))


@query("""WITH o AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey % 5 <> 0), n AS (SELECT n_name AS key, CAST(n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS v FROM nation WHERE n_nationkey % 7 <> 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change, o.v AS old_value, n.v AS new_value FROM o FULL OUTER JOIN n ON o.key = n.key WHERE o.v IS DISTINCT FROM n.v""")
def u20_runtime_diff(spark, sf):
    n = table(spark, sf, "nation")
    old = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = n.filter("n_nationkey % 7 <> 0").select(F.col("n_name").alias("key"), (F.col("n_regionkey") + (F.col("n_nationkey") % 3 == 0).cast("int")).cast("string").alias("value"))
    return compare.runtime_diff(old, new)


@query("SELECT l_orderkey AS group_id, count(*) AS members, CASE WHEN count(p_size) = count(*) THEN CAST(sum(p_size) AS BIGINT) END AS tokens FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) p ON l_partkey = p_partkey GROUP BY ALL")
def u22_opportunities(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("ref"))
    return compare.opportunities(g, table(spark, sf, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("tokens")))


@query("SELECT o_orderkey AS id, o_orderpriority AS skill FROM orders WHERE CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderstatus = 'F' ELSE o_orderstatus = 'O' END")
def u14_mixed_arm(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("skill"), "o_orderstatus")
    return compare.mixed_arm(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), {"1-URGENT": "new", "5-LOW": "new"}).select("id", "skill")


@query("SELECT o_custkey AS task_id, o_orderdate AS at, max_by(o_orderkey, o_orderkey) AS order_id, max(o_orderkey) AS line FROM orders GROUP BY ALL")
def k3_last_writes(spark, sf):
    j = table(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("line"))
    return tail.last_writes(j, ["task_id", "at"], "line")


@query("SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step FROM events")
def k5_close_steps(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("type"))
    return tail.close_steps(e, "user_id", "at", "purchase").select("event_id", "step")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k1_running_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tail.running_counts(e, ["event_type"], "ts", "1 day", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

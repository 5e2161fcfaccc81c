"""Scores, intervals, estimators, bootstrap, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.num import js_round, pass_at_k, splitmix32, wilson
from tracemill.operators import inference, scoring
from tracemill.plans.bindings import REPS, WILSON, r, reps, table
from tracemill.plans.registry import query

_LO, _HI = WILSON("s", "n")


@query(f"WITH {REPS}, g AS (SELECT task_id, count(*) FILTER (WHERE NOT excluded AND C = 1) AS s, count(*) FILTER (WHERE NOT excluded) AS n FROM reps GROUP BY ALL) SELECT task_id, s, n, {_LO} AS lo, {_HI} AS hi FROM g")
def g6_wilson(spark, sf):
    g = reps(spark, sf).groupBy("task_id").agg(F.count_if(~F.col("excluded") & (F.col("C") == 1)).alias("s"), F.count_if(~F.col("excluded")).alias("n"))
    lo, hi = wilson(F.col("s"), F.col("n"))
    return g.select("task_id", "s", "n", lo.alias("lo"), hi.alias("hi"))


_PASS = lambda n, c, k: f"CASE WHEN {k} > {n} OR {n} = 0 THEN NULL WHEN {c} <= 0 THEN 0e0 WHEN {n} - {c} < {k} THEN 1e0 ELSE {r(f'1e0 - list_reduce(list_prepend(1e0, list_transform(range({k}), lambda i: CAST({n} - {c} - i AS DOUBLE) / CAST({n} - i AS DOUBLE))), lambda x, y: x * y)')} END"


@query(f"WITH {REPS}, g AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE C = 1) AS c FROM reps WHERE NOT excluded GROUP BY ALL) SELECT task_id, k, {_PASS('n', 'c', 'k')} AS pass_at_k FROM g, (VALUES (1), (3), (5)) t(k)")
def g5_pass_at_k(spark, sf):
    g = reps(spark, sf).filter("not excluded").groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("C") == 1).alias("c"))
    g = g.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return g.select("task_id", "k", pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("pass_at_k"))


_TASK = f"""g AS (SELECT task_id, count(*) FILTER (WHERE NOT excluded) AS n, count(*) FILTER (WHERE NOT excluded AND failed) AS failed_repeats, count(*) FILTER (WHERE excluded) AS excluded_repeats,
  sum(CASE WHEN NOT excluded THEN CASE WHEN failed THEN 0e0 ELSE CAST(C AS DOUBLE) END END) AS sc, count(*) FILTER (WHERE NOT excluded AND NOT failed AND C = 1) AS s,
  avg(P) FILTER (WHERE NOT excluded AND NOT failed) AS p, avg(H) FILTER (WHERE NOT excluded AND NOT failed) AS h,
  sum(CASE WHEN NOT excluded AND failed THEN 0 WHEN NOT excluded AND NOT failed THEN CAST(activated AS INTEGER) END) AS a, count(CASE WHEN NOT excluded AND failed THEN 0 WHEN NOT excluded AND NOT failed THEN CAST(activated AS INTEGER) END) AS an FROM reps GROUP BY ALL),
d AS (SELECT *, CASE WHEN n > 0 THEN sc / n END AS c, CASE WHEN an > 0 THEN CAST(a AS DOUBLE) / an END AS ar FROM g),
e AS (SELECT *, CASE WHEN n > 0 THEN greatest(0e0, least(1e0, coalesce(ar, 1e0) * (1 - CASE WHEN n < 2 THEN 0e0 ELSE sqrt(greatest(0e0, sc / n - c * c)) END))) END AS rr FROM d),
f AS (SELECT *, n = 0 OR (excluded_repeats > 0 AND n < 3) AS fl, 0e0 + coalesce(c * 5e-1, 0e0) + coalesce(p * 25e-2, 0e0) + coalesce(rr * 15e-2, 0e0) + coalesce(h * 1e-1, 0e0) AS top,
  0e0 + CASE WHEN c IS NULL THEN 0e0 ELSE 5e-1 END + CASE WHEN p IS NULL THEN 0e0 ELSE 25e-2 END + CASE WHEN rr IS NULL THEN 0e0 ELSE 15e-2 END + CASE WHEN h IS NULL THEN 0e0 ELSE 1e-1 END AS ws FROM e),
tasks AS (SELECT task_id, n, failed_repeats, excluded_repeats, {r('c')} AS C, {r('p')} AS P, {r('rr')} AS R, {r('h')} AS H, CASE WHEN NOT fl AND ws > 0 THEN {r('top / ws')} END AS composite,
  NOT fl AND (c IS NULL OR p IS NULL OR rr IS NULL OR h IS NULL) AS composite_partial, {r('ar')} AS activation_rate, {r('s / CAST(greatest(1, n) AS DOUBLE)')} AS success_rate, {_LO} AS ci_lo, {_HI} AS ci_hi, n < 3 AS low_sample,
  CASE WHEN n >= 1 THEN {_PASS('n', 's', '1')} END AS pass_at_1, CASE WHEN n >= 3 THEN {_PASS('n', 's', '3')} END AS pass_at_3 FROM f)"""


@query(f"WITH {REPS}, {_TASK} SELECT * FROM tasks")
def g3_task_score(spark, sf):
    return scoring.score_task(reps(spark, sf), ["task_id"])


@query(f"""WITH {REPS}, {_TASK} SELECT CAST(task_id % 5 AS BIGINT) AS suite, {r('avg(composite)', 2)} AS composite, bool_or(low_sample) AS low_sample, bool_or(composite_partial) AS composite_partial, bool_or(excluded_repeats > 0) AS degraded, CAST(sum(excluded_repeats) AS BIGINT) AS excluded_repeats FROM tasks GROUP BY ALL""")
def g8_experiment_score(spark, sf):
    t = scoring.score_task(reps(spark, sf), ["task_id"]).withColumn("suite", F.col("task_id") % 5)
    # two decimals: the order of summing doubles is not fixed
    return scoring.score_experiment(t, ["suite"]).select("suite", js_round(F.col("composite"), 2).alias("composite"), "low_sample", "composite_partial", "degraded", "excluded_repeats")


@query(f"""WITH {REPS}, a AS (SELECT task_id, count(*) FILTER (WHERE activated) AS triggered_n, {r('avg(C) FILTER (WHERE activated)')} AS triggered_c, count(*) FILTER (WHERE NOT activated) AS not_triggered_n, {r('avg(C) FILTER (WHERE NOT activated)')} AS not_triggered_c
  FROM reps WHERE NOT excluded AND activated IS NOT NULL GROUP BY ALL)
SELECT *, (triggered_n > 0 AND triggered_n < 3) OR (not_triggered_n > 0 AND not_triggered_n < 3) AS low_sample FROM a""")
def g7_activation_outcome(spark, sf):
    return scoring.activation_outcome(reps(spark, sf), ["task_id"])


_FLO, _FHI = WILSON("numerator", "denom")


@query(f"WITH {REPS}, g AS (SELECT task_id, count(*) FILTER (WHERE flow_status = 'incomplete') AS numerator, count(*) AS denom FROM reps GROUP BY ALL) SELECT task_id, numerator, denom, {r('numerator / CAST(denom AS DOUBLE)')} AS rate, {_FLO} AS ci_lo, {_FHI} AS ci_hi FROM g")
def g11_flow_incomplete(spark, sf):
    return scoring.flow_incomplete(reps(spark, sf), ["task_id"])


_CDF = "CASE WHEN z >= 0 THEN 1 - q ELSE q END"


@query(f"""WITH {REPS}, g AS (SELECT priority, CAST(count(*) FILTER (WHERE arm = 'new' AND flow_status = 'incomplete') AS DOUBLE) AS x1, CAST(count(*) FILTER (WHERE arm = 'new') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE arm = 'old' AND flow_status = 'incomplete') AS DOUBLE) AS x2, CAST(count(*) FILTER (WHERE arm = 'old') AS DOUBLE) AS n2 FROM reps GROUP BY ALL),
s AS (SELECT *, sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS se FROM g), t AS (SELECT *, CASE WHEN se > 0 THEN (x1 / n1 - x2 / n2) / se ELSE 0e0 END AS z FROM s),
u AS (SELECT *, 1 / (1 + 2316419e-7 * abs(z)) AS k FROM t), v AS (SELECT *, 3989422804014327e-16 * exp(-z * z / 2) * k * (31938153e-8 + k * (-356563782e-9 + k * (1781477937e-9 + k * (-1821255978e-9 + k * 1330274429e-9)))) AS q FROM u)
SELECT priority, z > 0 AND {r(f'1 - ({_CDF})')} < 0.05 AS regressed, {r('x1 / n1 - x2 / n2')} AS delta_rate, {r('z')} AS z, {r(f'1 - ({_CDF})')} AS p_value FROM v""")
def g11_two_proportion_z(spark, sf):
    bad = F.col("flow_status") == "incomplete"
    new, old = F.col("arm") == "new", F.col("arm") == "old"
    g = reps(spark, sf).groupBy("priority").agg(F.count_if(new & bad).alias("x1"), F.count_if(new).alias("n1"), F.count_if(old & bad).alias("x2"), F.count_if(old).alias("n2"))
    return g.select("priority", *inference.compare_flow(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")))


@query(f"""WITH {REPS}, s AS (SELECT order_id, task_id, repeat AS step, CAST(order_id % 4 AS DOUBLE) / 3 AS reward, CASE WHEN order_id % 2 = 0 THEN 0.5 ELSE 0 END AS m FROM reps),
b AS (SELECT *, coalesce(sum(CASE WHEN reward < m THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT task_id, count(*) FILTER (WHERE before = 0) AS steps_run, count(*) AS steps, min(step) FILTER (WHERE before = 0 AND reward < m) AS aborted_at_step, {r(r('avg(reward) FILTER (WHERE before = 0)'), 2)} AS reward, CAST(bool_and(before = 0 AND reward = 1) AS INTEGER) AS C FROM b GROUP BY ALL""")
def g9_multi_step(spark, sf):
    s = reps(spark, sf).select("task_id", F.col("repeat").cast("long").alias("step"), (F.col("order_id") % 4).alias("passed"), F.lit(3).alias("total"), F.when(F.col("order_id") % 2 == 0, 0.5).otherwise(0.0).alias("min_reward"))
    return scoring.multi_step(s, ["task_id"]).withColumn("reward", js_round(F.col("reward"), 2))


@query(f"""SELECT l_orderkey AS rep_id, CAST(bool_and(l_quantity > 5) FILTER (WHERE l_returnflag <> 'R') AS INTEGER) AS c_deterministic, CAST(bool_and(l_quantity > 5) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS c_judged,
  coalesce(CAST(bool_and(l_quantity > 5) FILTER (WHERE l_returnflag = 'R') AS INTEGER), CAST(bool_and(l_quantity > 5) FILTER (WHERE l_returnflag <> 'R') AS INTEGER), 0) AS C, CASE WHEN bool_or(l_returnflag = 'R') THEN 'judged' ELSE 'deterministic' END AS authority FROM lineitem GROUP BY l_orderkey""")
def v11_gate(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rep_id"), F.when(F.col("l_returnflag") == "R", "judged").otherwise("deterministic").alias("cls"), (F.col("l_quantity") > 5).alias("passed"))
    return scoring.gate(li, ["rep_id"], "judged")


_MIX = "(xor(t2, t2 >> 15))"


def _draw(k: str) -> str:
    """SQL of the k-th draw, from 1."""
    a = f"CAST((2654435769 + CAST({k} AS HUGEINT) * 2654435769) % 4294967296 AS UBIGINT)"
    t1 = f"CAST((CAST(xor({a}, {a} >> 16) AS HUGEINT) * 569420461) % 4294967296 AS UBIGINT)"
    return t1


def _uniform(source: str, k: str, keep: str) -> str:
    """SQL query: columns `keep` of `source` and the draw u."""
    return (
        f"SELECT {keep}, CAST(xor(t2, t2 >> 15) AS DOUBLE) / 4294967296 AS u FROM (SELECT {keep}, CAST((CAST(xor(t1, t1 >> 15) AS HUGEINT) * 1935289751) % 4294967296 AS UBIGINT) AS t2 FROM (SELECT {keep}, {_draw(k)} AS t1 FROM {source}) x1) x2"
    )


@query(f"SELECT k, u FROM ({_uniform('(SELECT o_orderkey AS k FROM orders) d', 'k', 'k')}) z")
def u1_prng(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), splitmix32(F.col("o_orderkey"), 0x9E3779B9).alias("u"))


_DELTAS = f"""{REPS}, dl AS (SELECT task_id, CAST(round(100e0 * count(*) FILTER (WHERE arm = 'new' AND C = 1) / count(*) FILTER (WHERE arm = 'new')) - round(100e0 * count(*) FILTER (WHERE arm = 'old' AND C = 1) / count(*) FILTER (WHERE arm = 'old')) AS BIGINT) AS delta
  FROM reps WHERE NOT excluded GROUP BY ALL HAVING count(*) FILTER (WHERE arm = 'new') > 0 AND count(*) FILTER (WHERE arm = 'old') > 0)"""


def deltas(spark, sf):
    side = lambda a, c=F.lit(True): F.count_if((F.col("arm") == a) & c)
    rate = lambda a: F.round(100.0 * side(a, F.col("C") == 1) / side(a))
    g = reps(spark, sf).filter("not excluded").groupBy("task_id").agg(side("new").alias("nn"), side("old").alias("no"), F.when((side("new") > 0) & (side("old") > 0), rate("new") - rate("old")).cast("long").alias("delta"))
    return g.filter("nn > 0 and no > 0").select("task_id", "delta")


@query(f"""WITH {_DELTAS}, o AS (SELECT delta, row_number() OVER (ORDER BY task_id) - 1 AS pos FROM dl), n AS (SELECT count(*) AS n FROM o),
d AS (SELECT b.range AS b, i.range AS i, n FROM n, range(10000) b, range(n.n) i), u AS ({_uniform('d', '(b * n + i + 1)', 'b, n')}),
m AS (SELECT b, sum(delta) / CAST(count(*) AS DOUBLE) AS mean FROM u JOIN o ON o.pos = CAST(floor(u * n) AS BIGINT) GROUP BY b), k AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM m)
SELECT (SELECT {r('mean')} FROM k WHERE r = 250) AS lo, (SELECT {r('mean')} FROM k WHERE r = 9749) AS hi, (SELECT {r('sum(delta) / CAST(count(*) AS DOUBLE)')} FROM o) AS mean, (SELECT n FROM n) AS n""")
def u2_paired_bootstrap(spark, sf):
    d = deltas(spark, sf).withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    return inference.bootstrap(d, ["g"], "task_id", "delta", "one").drop("g")


_SEG = "sg AS (SELECT c_mktsegment AS skill, task_id AS case_id, delta FROM dl JOIN customer ON c_custkey = task_id)"


@query(f"""WITH {_DELTAS}, {_SEG}, o AS (SELECT skill, delta, row_number() OVER (PARTITION BY skill ORDER BY case_id) - 1 AS pos, count(*) OVER (PARTITION BY skill) AS n FROM sg), n AS (SELECT DISTINCT skill, n FROM o),
d AS (SELECT skill, b.range AS b, i.range AS i, n FROM n, range(10000) b, range(n.n) i), u AS ({_uniform('d', '(b * n + i + 1)', 'skill, b, n')}),
m AS (SELECT u.skill, b, sum(delta) / CAST(count(*) AS DOUBLE) AS mean FROM u JOIN o ON o.skill = u.skill AND o.pos = CAST(floor(u * u.n) AS BIGINT) GROUP BY ALL), k AS (SELECT skill, mean, row_number() OVER (PARTITION BY skill ORDER BY mean) - 1 AS r FROM m),
ci AS (SELECT skill, {r('max(mean) FILTER (WHERE r = 250)')} AS lo, {r('max(mean) FILTER (WHERE r = 9749)')} AS hi FROM k GROUP BY ALL), pt AS (SELECT skill, {r('sum(delta) / CAST(count(*) AS DOUBLE)')} AS mean, count(*) AS n FROM o GROUP BY ALL)
SELECT skill, lo, hi, mean, n FROM ci JOIN pt USING (skill)""")
def u3_cluster_bootstrap(spark, sf):
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("skill"))
    d = deltas(spark, sf).join(seg, "task_id").withColumn("one", F.lit(1))
    return inference.bootstrap(d, ["skill"], "task_id", "delta", "one")


_P = "CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 400) / 100000e0 ELSE (c_custkey % 997) / 997e0 END"


@query(f"""WITH t AS (SELECT c_nationkey AS family, c_custkey AS id, {_P} AS p FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM t),
c AS (SELECT family, max(k) AS cut FROM k WHERE p <= k / CAST(m AS DOUBLE) * 5e-2 GROUP BY ALL) SELECT k.family, count(*) AS tests, count(*) FILTER (WHERE k.k <= coalesce(cut, 0)) AS rejected FROM k LEFT JOIN c USING (family) GROUP BY ALL""")
def u4_benjamini_hochberg(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(F.col("c_nationkey").alias("family"), F.when(k % 7 == 0, (k % 400) / F.lit(100000.0)).otherwise((k % 997) / F.lit(997.0)).alias("p"))
    return inference.benjamini_hochberg(t, "p", by=["family"]).groupBy("family").agg(F.count("*").alias("tests"), F.count_if("rejected").alias("rejected"))


_V = "FILTER (WHERE NOT excluded)"
_EQ = "(0e0 + coalesce(CAST(u_in AS DOUBLE), 0e0) * 1e0 + coalesce(CAST(u_out AS DOUBLE), 0e0) * 5e0 + coalesce(CAST(u_cache_r AS DOUBLE), 0e0) * 1e-1 + coalesce(CAST(u_cache_w AS DOUBLE), 0e0) * 125e-2)"
_ARM = f"""arms AS (SELECT arm, count(*) {_V} AS n, count(*) AS attempted, count(*) FILTER (WHERE excluded) AS excluded_repeats, {r(f'avg(CAST(l1_pass AS INTEGER)) {_V}')} AS l1_rate, {r(f'avg(CAST(l2_pass AS INTEGER)) {_V}')} AS l2_rate, {r(f'avg(CAST(l3_pass AS INTEGER)) {_V}')} AS l3_rate,
  {r(f'avg(rounds) {_V}')} AS mean_turns, {r(r(f'avg(CASE WHEN u_in IS NOT NULL THEN {_EQ} END) {_V}'), 2)} AS mean_equiv_tokens, {r(f'avg(duration_ms / 1000e0) {_V}')} AS mean_seconds, count(*) FILTER (WHERE flow_status = 'incomplete') AS flow_incomplete, {r("count(*) FILTER (WHERE flow_status = 'incomplete') / CAST(count(*) AS DOUBLE)")} AS flow_rate FROM reps GROUP BY arm)"""


@query(f"WITH {REPS}, {_ARM} SELECT * FROM arms")
def u6_aggregate_arm(spark, sf):
    return inference.aggregate_arm(reps(spark, sf), ["arm"]).withColumn("mean_equiv_tokens", js_round(F.col("mean_equiv_tokens"), 2))


_VROWS = """v AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'cost-opt' WHEN 1 THEN 'quality-fix' ELSE 'neutral-refactor' END AS intent, c_custkey % 20 AS pairs, CAST(c_custkey % 14 AS DOUBLE) AS exclusion_pct,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 12 AS DOUBLE) - 8 END AS l1_low, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 9 AS DOUBLE) - 6 END AS l2_low, CAST(NULL AS DOUBLE) AS l3_low,
  c_custkey % 6 = 0 AS flow_regressed, c_custkey % 2 = 0 AS any_cost_down, c_custkey % 10 = 0 AS any_cost_up, c_custkey % 7 < 3 AS l1_up, c_custkey % 8 = 0 AS l2_up, false AS l3_up FROM customer)"""


@query(f"""WITH {_VROWS}, w AS (SELECT *, (l1_low IS NULL OR l1_low > -5) AND (l2_low IS NULL OR l2_low > -5) AS qn FROM v)
SELECT id, CASE WHEN pairs < 8 THEN 'insufficient-data' WHEN exclusion_pct > 12 THEN 'inconclusive' ELSE intent END AS verdict,
  pairs >= 8 AND exclusion_pct <= 12 AND CASE intent WHEN 'cost-opt' THEN qn AND NOT flow_regressed AND any_cost_down AND NOT any_cost_up WHEN 'quality-fix' THEN (l1_up OR l2_up) AND NOT any_cost_up AND NOT flow_regressed ELSE qn AND NOT flow_regressed AND NOT any_cost_up END AS established FROM w""")
def u7_verdict(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "cost-opt").when(k % 3 == 1, "quality-fix").otherwise("neutral-refactor").alias("intent"), (k % 20).alias("pairs"), (k % 14).cast("double").alias("exclusion_pct"),
        F.when(k % 5 != 0, (k % 12).cast("double") - 8).alias("l1_low"), F.when(k % 4 != 0, (k % 9).cast("double") - 6).alias("l2_low"), F.lit(None).cast("double").alias("l3_low"),
        (k % 6 == 0).alias("flow_regressed"), (k % 2 == 0).alias("any_cost_down"), (k % 10 == 0).alias("any_cost_up"), (k % 7 < 3).alias("l1_up"), (k % 8 == 0).alias("l2_up"), F.lit(False).alias("l3_up"), F.lit(None).cast("string").alias("target"),
    )
    return inference.decide(rows).select("id", "verdict", "established")


@query(f"""WITH {_DELTAS}, {_SEG}, o AS (SELECT skill, delta, row_number() OVER (PARTITION BY skill ORDER BY case_id) - 1 AS pos, count(*) OVER (PARTITION BY skill) AS n FROM sg), n AS (SELECT DISTINCT skill, n FROM o WHERE n >= 5),
d AS (SELECT skill, b.range AS b, i.range AS i, n FROM n, range(10000) b, range(n.n) i), u AS ({_uniform('d', '(b * n + i + 1)', 'skill, b, n')}),
m AS (SELECT u.skill, b, sum(delta) / CAST(count(*) AS DOUBLE) AS mean FROM u JOIN o ON o.skill = u.skill AND o.pos = CAST(floor(u * u.n) AS BIGINT) GROUP BY ALL), k AS (SELECT skill, mean, row_number() OVER (PARTITION BY skill ORDER BY mean) - 1 AS r FROM m),
ci AS (SELECT skill, {r('max(mean) FILTER (WHERE r = 250)')} AS lo, {r('max(mean) FILTER (WHERE r = 9749)')} AS hi FROM k GROUP BY ALL), pv AS (SELECT *, CASE WHEN lo <= 0 AND hi >= 0 THEN 1e0 ELSE 1e-2 END AS p_value FROM ci),
bh AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM pv), cut AS (SELECT max(k) AS c FROM bh WHERE p_value <= k / CAST(m AS DOUBLE) * 5e-2), pt AS (SELECT skill, {r('sum(delta) / CAST(count(*) AS DOUBLE)')} AS mean, count(*) AS n_cases FROM o GROUP BY ALL)
SELECT pt.skill, n_cases, CASE WHEN n_cases < 5 THEN 'insufficient-data' WHEN n_cases <= 7 THEN 'reference-only' ELSE 'ok' END AS badge, pt.mean, lo, hi, p_value, coalesce(bh.k <= coalesce((SELECT c FROM cut), 0), false) AS significant FROM pt LEFT JOIN bh USING (skill)""")
def u8_per_skill(spark, sf):
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("skill"))
    units = deltas(spark, sf).join(seg, "task_id").withColumnRenamed("task_id", "case_id")
    return inference.per_skill(units)


@query("SELECT c_mktsegment || '×' || CAST(c_nationkey AS VARCHAR) AS cluster, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS case_ids FROM customer WHERE c_acctbal < 0 GROUP BY ALL")
def u9_cluster_regressed(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("skill"), F.col("c_nationkey").cast("string").alias("category"), (F.col("c_acctbal") < 0).alias("regressed"))
    return inference.regressed_clusters(c).withColumn("case_ids", F.array_join("case_ids", ","))


@query(f"WITH {REPS} SELECT order_id, {_EQ} AS equiv_tokens FROM reps")
def m5_equiv_tokens(spark, sf):
    from tracemill.functions.num import equiv_tokens

    return reps(spark, sf).select("order_id", equiv_tokens(*(F.col(c) for c in ("u_in", "u_out", "u_cache_r", "u_cache_w"))).alias("equiv_tokens"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\\b429\\b|too many requests') THEN 'rate-limit-429' WHEN regexp_matches(t, '(?i)\\b529\\b|overloaded') THEN 'overloaded-529'
  WHEN regexp_matches(t, '(?i)\\b53017\\b|auth\\w*\\s*(token\\s*)?expir|token\\s*expir') THEN 'auth-expired' WHEN regexp_matches(t, 'ECONNREFUSED|ETIMEDOUT') THEN 'conn-refused' WHEN regexp_matches(t, '(?i)rate[\\s_-]?limit(?:ed|ing)?') THEN 'rate-limit' END AS label
FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'HTTP 429 ' WHEN 1 THEN 'auth token expired ' WHEN 2 THEN 'ECONNREFUSED ' WHEN 3 THEN 'rate_limited ' WHEN 4 THEN '4290 ' WHEN 5 THEN 'timeout ' ELSE 'Overloaded ' END || text AS t FROM documents)""")
def g10_env_noise(spark, sf):
    k = F.col("doc_id") % 7
    t = F.when(k == 0, "HTTP 429 ").when(k == 1, "auth token expired ").when(k == 2, "ECONNREFUSED ").when(k == 3, "rate_limited ").when(k == 4, "4290 ").when(k == 5, "timeout ").otherwise("Overloaded ")
    return table(spark, sf, "documents").select("doc_id", scoring.env_noise(F.concat(t, "text")).alias("label"))

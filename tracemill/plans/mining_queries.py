"""Proximity, n-grams, loops and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import graph, proximity
from tracemill.plans.bindings import BASKETS, EVENTS, baskets, events, r, spread, table
from tracemill.plans.registry import query


@query(f"""WITH {EVENTS},
p AS (SELECT a.event_type AS from_id, b.event_type AS to_id, a.user_id, a.run_id, b.ordinal - a.ordinal AS gap FROM ev a JOIN ev b
      ON a.run_id = b.run_id AND b.ordinal > a.ordinal AND b.ordinal - a.ordinal <= 6 AND a.event_type <> b.event_type),
g AS (SELECT from_id, to_id, gap, count(*) AS n FROM p GROUP BY ALL),
w AS (SELECT from_id, to_id, list_reduce(list_prepend(0e0, list(n / (gap + 1e0) ORDER BY gap)), lambda a, b: a + b) AS weight FROM g GROUP BY ALL),
s AS (SELECT from_id, to_id, count(DISTINCT user_id) AS pair_cases, count(DISTINCT run_id) AS runs FROM p GROUP BY ALL),
n AS (SELECT event_type AS id, count(*) AS occ, count(DISTINCT user_id) AS cases FROM ev GROUP BY ALL), t AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS c FROM ev)
SELECT 'tool' AS from_type, w.from_id, 'tool' AS to_type, w.to_id, {r('weight / a.occ', 4)} AS closeness, {r('pair_cases / CAST(a.cases AS DOUBLE)', 4)} AS confidence,
  CASE WHEN pair_cases >= 3 THEN {r('(pair_cases / t.c) / ((a.cases / t.c) * (b.cases / t.c))', 4)} END AS lift, pair_cases, runs
FROM w JOIN s USING (from_id, to_id) JOIN n a ON a.id = w.from_id JOIN n b ON b.id = w.to_id CROSS JOIN t""")
def x16_proximity(spark, sf):
    e = events(spark, sf).select("run_id", F.col("user_id").alias("case_id"), F.lit("tool").alias("type"), F.col("event_type").alias("id"), "ordinal", F.col("ordinal").alias("pos"))
    return proximity.matrix(e)


@query(f"""WITH {EVENTS}, l AS (SELECT run_id, user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ordinal)),
u AS (SELECT 2 AS n, a || '>' || b AS seq, user_id, run_id FROM l WHERE b IS NOT NULL UNION ALL SELECT 3, a || '>' || b || '>' || c, user_id, run_id FROM l WHERE c IS NOT NULL)
SELECT n, seq, count(DISTINCT user_id) AS distinct_cases, count(DISTINCT run_id) AS runs FROM u GROUP BY ALL HAVING count(DISTINCT user_id) >= 3""")
def x14_ngrams(spark, sf):
    e = events(spark, sf).select("run_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("cmd"), F.col("ordinal").alias("ord"))
    return proximity.ngrams(e).withColumn("seq", F.array_join("seq", ">"))


_TOOL = "CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE event_type END"
_INPUT = "CASE event_id % 7 WHEN 0 THEN 'ab' WHEN 1 THEN 'abc' WHEN 2 THEN 'abcd' WHEN 3 THEN 'abx' WHEN 4 THEN 'ab' WHEN 5 THEN CASE WHEN user_id % 4 = 0 THEN '' ELSE 'b' END ELSE 'abce' END"


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, {_TOOL} AS tool, {_INPUT} AS inp, event_type = 'error' AS err FROM events),
f(user_id, ord, tool, opened, start) AS (SELECT user_id, ord, tool, inp, ord FROM o WHERE ord = 1
  UNION ALL SELECT o.user_id, o.ord, o.tool, CASE WHEN o.tool = f.tool AND starts_with(o.inp, f.opened) THEN f.opened ELSE o.inp END, CASE WHEN o.tool = f.tool AND starts_with(o.inp, f.opened) THEN f.start ELSE o.ord END FROM f JOIN o ON o.user_id = f.user_id AND o.ord = f.ord + 1),
c AS (SELECT *, CASE WHEN lag(tool) OVER w = tool AND lag(err) OVER w = err THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ord)), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ord) AS isl FROM c)
SELECT user_id AS run_id, 'identical-input' AS type, tool, min(ord) AS first_ord, count(*) AS count FROM f GROUP BY user_id, start, tool HAVING count(*) >= 4
UNION ALL SELECT user_id, 'repeated-error', tool, min(ord), count(*) FROM i WHERE err GROUP BY user_id, isl, tool HAVING count(*) >= 4""")
def o7_loops(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return proximity.loops(e.select(F.col("user_id").alias("run_id"), "ord", F.expr(_TOOL).alias("tool"), F.expr(_INPUT).alias("input"), (F.col("event_type") == "error").alias("is_error")))


@query(f"""WITH {BASKETS}, o AS (SELECT DISTINCT ref, skill FROM reads), e AS (SELECT DISTINCT o.ref, t.session FROM o JOIN triggers t USING (skill)),
h AS (SELECT DISTINCT ref, session FROM reads)
SELECT e.ref, count(*) AS n, count(h.ref) AS numer, {r('count(h.ref) / CAST(count(*) AS DOUBLE)', 6)} AS rate,
  CASE WHEN count(h.ref) / CAST(count(*) AS DOUBLE) >= 0.6 THEN 'inline' WHEN count(h.ref) / CAST(count(*) AS DOUBLE) <= 0.2 THEN 'external' ELSE 'gray-zone-section-split' END AS advice
FROM e LEFT JOIN h ON e.ref = h.ref AND e.session = h.session GROUP BY e.ref""")
def d5_read_rates(spark, sf):
    from tracemill.functions.num import js_round

    return graph.read_rates(*baskets(spark, sf)).withColumn("rate", js_round(F.col("rate"), 6))


_PAIRS = """p AS (SELECT a.{x} AS a, b.{x} AS b, count(*) AS "both" FROM {t} a JOIN {t} b ON a.session = b.session AND a.{x} < b.{x} GROUP BY ALL), n AS (SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n FROM lineitem)"""


@query(f"WITH {BASKETS}, d AS (SELECT DISTINCT session, ref FROM reads), {_PAIRS.format(x='ref', t='d')} SELECT a, b, \"both\", {r('\"both\" / n', 6)} AS rate FROM p, n WHERE \"both\" / n >= 0.002")
def d6_co_read(spark, sf):
    from tracemill.functions.num import js_round

    _, reads = baskets(spark, sf)
    n = table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    return graph.co_read_pairs(reads, n, least=0.002).withColumn("rate", js_round(F.col("rate"), 6))


@query(f"WITH {BASKETS}, {_PAIRS.format(x='skill', t='triggers')}, m AS (SELECT skill, count(*) AS k FROM triggers GROUP BY ALL) SELECT a, b, {r('\"both\" / n', 6)} AS rate, 'edge' AS kind FROM p, n WHERE \"both\" / n >= 0.02 UNION ALL SELECT skill, NULL, {r('k / n', 6)}, 'node' FROM m, n")
def d7_co_trigger_graph(spark, sf):
    from tracemill.functions.num import js_round

    triggers, _ = baskets(spark, sf)
    n = table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    nodes, edges = graph.co_trigger_graph(triggers, n, least=0.02)
    return edges.select("a", "b", js_round(F.col("rate"), 6).alias("rate"), F.lit("edge").alias("kind")).unionByName(nodes.select(F.col("skill").alias("a"), F.lit(None).cast("string").alias("b"), js_round(F.col("trigger_rate"), 6).alias("rate"), F.lit("node").alias("kind")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 7 + 3) % 25 AS b FROM supplier), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(x, y) AS (SELECT x, x FROM n UNION SELECT c.x, u.b FROM c JOIN u ON c.y = u.a),
m AS (SELECT x, min(lpad(CAST(y AS VARCHAR), 2, '0')) AS comp FROM c GROUP BY x)
SELECT comp AS component, string_agg(lpad(CAST(x AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(x AS VARCHAR), 2, '0')) AS members FROM m GROUP BY comp HAVING count(*) >= 2""")
def d8_merge_map(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey").distinct()
    name = lambda c: F.lpad(c.cast("string"), 2, "0")
    e = s.select(name(F.col("s_nationkey")).alias("a"), name((F.col("s_nationkey") * 7 + 3) % 25).alias("b"))
    nodes = e.select(F.col("a").alias("skill")).union(e.select("b"))
    return graph.merge_groups(nodes, e).withColumn("members", F.array_join("members", ","))


_JACCARD = """s AS (SELECT CAST(s_nationkey AS VARCHAR) AS skill, l_orderkey AS session, o_orderpriority AS category, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_JACCARD}, z AS (SELECT skill, category, count(DISTINCT session) AS n FROM s GROUP BY ALL), f AS (SELECT DISTINCT skill, category, ref FROM s), k AS (SELECT skill, category, count(*) AS size FROM f GROUP BY ALL),
b AS (SELECT x.skill, x.category AS x, y.category AS y, count(*) AS n FROM f x JOIN f y ON x.skill = y.skill AND x.ref = y.ref AND x.category < y.category GROUP BY ALL),
p AS (SELECT x.skill, coalesce(b.n, 0) AS i, x.size + y.size - coalesce(b.n, 0) AS u FROM k x JOIN k y ON x.skill = y.skill AND x.category < y.category LEFT JOIN b ON b.skill = x.skill AND b.x = x.category AND b.y = y.category),
m AS (SELECT skill, {r('avg(CASE WHEN u = 0 THEN 1e0 ELSE i / CAST(u AS DOUBLE) END)', 4)} AS j FROM p GROUP BY ALL), g AS (SELECT skill, count(*) AS categories, CAST(sum(n) AS BIGINT) AS n, min(n) AS least FROM z GROUP BY ALL)
SELECT g.skill, categories, g.n, CASE WHEN categories >= 2 AND least >= 5 THEN j END AS mean_jaccard,
  CASE WHEN categories < 2 OR least < 5 THEN 'insufficient-data' WHEN j < 0.3 THEN 'split-candidate' ELSE 'no-split' END AS status,
  CASE WHEN categories < 2 THEN 'too-few-categories' WHEN least < 5 THEN 'too-few-sessions-per-category' END AS reason FROM g LEFT JOIN m USING (skill)""")
def d9_jaccard_split(spark, sf):
    from tracemill.functions.num import js_round

    li, su = table(spark, sf, "lineitem"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = li.count()
    few = F.broadcast if su.count() <= graph.FEW else (lambda df: df)
    named = spread(li.join(few(su), li.l_suppkey == F.col("s_suppkey")).select(F.col("s_nationkey").alias("skill"), F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("ref")), n, "session")
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("category"))
    # the limit bounds what the driver gets: with more categories, all rows take the other form
    found = [c for (c,) in od.select(F.coalesce("category", F.lit(graph.UNCATEGORIZED))).distinct().limit(graph.MASKED + 1).collect()]
    if len(found) <= graph.MASKED:
        od = od.select("session", graph.category_bit(F.col("category"), found).alias("bit"))
        out = graph.jaccard_split_masked(named.join(spread(od, n, "session"), "session"))
    else:
        s = named.join(spread(od, n, "session"), "session")
        out = graph.jaccard_split(s.select("skill", "session", "category").distinct(), s.select("skill", "session", "ref").distinct())
    return out.withColumn("skill", F.col("skill").cast("string")).withColumn("mean_jaccard", js_round(F.col("mean_jaccard"), 4))


@query("""SELECT p_brand AS brand, CAST(sum(length(p_name)) AS BIGINT) AS sum_desc, max(length(p_name)) AS merged_desc, (sum(length(p_name)) - max(length(p_name))) / 4e0 AS resident_savings,
  ((sum(length(p_name)) - max(length(p_name))) / 4e0) / (count(*) / 1000e0) AS inflation_ceiling FROM part GROUP BY ALL""")
def d10_break_even(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.sum(F.length("p_name")).alias("sum_desc"), F.max(F.length("p_name")).cast("long").alias("merged_desc"), (F.count("*") / F.lit(1000.0)).alias("p"))
    return graph.break_even(g, "p").drop("p")

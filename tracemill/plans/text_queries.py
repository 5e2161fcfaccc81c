"""Metrics, text functions, lints, search, trends, retention and trace export over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import format_bytes, js_round, mcp_server, parse_duration, redact_secrets, tokens_est_cjk, tool_kind
from tracemill.operators import lint, metrics, trend, views
from tracemill.plans.bindings import EVENTS, events, r, table
from tracemill.plans.registry import query
from tracemill.sources import logs, otel

_MODEL = "CASE p_partkey % 6 WHEN 0 THEN 'Claude-Opus-4' WHEN 1 THEN 'sonnet-x' WHEN 2 THEN 'HAIKU' WHEN 3 THEN 'gpt-5' WHEN 4 THEN 'deepseek-gpt' ELSE 'llama' END"
_RULE = "CASE p_partkey % 6 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'haiku' WHEN 3 THEN 'gpt' WHEN 4 THEN 'gpt' END"


@query(f"SELECT p_partkey AS id, {_RULE} AS price_match, CASE p_partkey % 6 WHEN 0 THEN 15e0 WHEN 1 THEN 3e0 WHEN 2 THEN 1e0 WHEN 5 THEN 3e0 ELSE 2.5e0 END AS p_in, p_partkey % 6 <> 5 AS price_matched FROM part")
def m1_price_match(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_MODEL).alias("model"))
    return metrics.price(p, "model").select("id", "price_match", "p_in", "price_matched")


_RND = f"""l AS (SELECT l_orderkey AS run_id, l_linenumber % 4 <> 0 AS main, {_MODEL.replace('p_partkey', 'l_partkey')} AS m, l_partkey % 6 AS k, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) * 1000 + 7 END AS i, l_linenumber * 211 AS o, CAST(l_suppkey AS BIGINT) * 13 AS cw, CAST(l_suppkey AS BIGINT) * 101 AS cr, l_partkey % 3 AS n, l_partkey % 2 AS e, CAST(l_quantity AS BIGINT) * 100 AS fp FROM lineitem),
c AS (SELECT *, (i * CASE k WHEN 0 THEN 15e0 WHEN 1 THEN 3e0 WHEN 2 THEN 1e0 WHEN 5 THEN 3e0 ELSE 2.5e0 END + o * CASE k WHEN 0 THEN 75e0 WHEN 1 THEN 15e0 WHEN 2 THEN 5e0 WHEN 5 THEN 15e0 ELSE 10e0 END + cw * CASE k WHEN 0 THEN 18.75e0 WHEN 1 THEN 3.75e0 WHEN 2 THEN 1.25e0 WHEN 5 THEN 3.75e0 ELSE 0e0 END
  + cr * CASE k WHEN 0 THEN 1.5e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.1e0 WHEN 5 THEN 0.3e0 ELSE 1.25e0 END) / 1e6 AS cost FROM l)"""


def _metric_rounds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") % 4 != 0, "main").otherwise("side").alias("chain"), F.expr(_MODEL.replace("p_partkey", "l_partkey")).alias("model"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity").cast("long") * 1000 + 7).alias("u_in"),
        (F.col("l_linenumber") * 211).alias("u_out"), (F.col("l_suppkey") * 13).alias("u_cache_w"), (F.col("l_suppkey") * 101).alias("u_cache_r"), (F.col("l_partkey") % 3).alias("n_calls"), (F.col("l_partkey") % 2).alias("n_errors"),
        (F.col("l_quantity").cast("long") * 100).alias("footprint"), F.lit(1000).alias("duration_ms"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_returnflag")).alias("attribution_skill"), F.array("l_linestatus", "l_returnflag").alias("call_skills"),
    )


@query(f"""WITH {_RND} SELECT run_id, count(*) FILTER (WHERE main) AS rounds, count(*) FILTER (WHERE NOT main) AS sidechain_rounds, CAST(coalesce(sum(i), 0) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, {r(r('coalesce(sum(cost), 0)', 4), 3)} AS cost_usd,
  bool_and(i IS NULL OR k <> 5) AS pricing_matched, CAST(sum(n) AS BIGINT) AS tool_calls, CAST(sum(e) AS BIGINT) AS tool_errors, max(fp) FILTER (WHERE main) AS peak_context FROM c GROUP BY ALL""")
def m2_run_metrics(spark, sf):
    rounds = _metric_rounds(spark, sf)
    runs = rounds.select("run_id").distinct().withColumn("model", F.lit(None).cast("string")).withColumn("started_at", F.lit(None).cast("timestamp")).withColumn("ended_at", F.lit(None).cast("timestamp"))
    m = metrics.run_metrics(rounds, runs)
    return m.select("run_id", "rounds", "sidechain_rounds", "tokens_in", "tokens_out", js_round(F.col("cost_usd"), 3).alias("cost_usd"), "pricing_matched", "tool_calls", "tool_errors", "peak_context")


@query("""WITH s AS (SELECT l_orderkey AS run_id, unnest(list_distinct(CASE WHEN l_partkey % 4 = 0 THEN [l_returnflag, l_linestatus] ELSE [l_linestatus, l_returnflag] END)) AS skill, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) * 1000 + 7 END AS i, l_partkey % 3 AS n FROM lineitem)
SELECT run_id, skill, count(*) AS rounds, CAST(coalesce(sum(i), 0) AS BIGINT) AS tokens_in, CAST(sum(n) AS BIGINT) AS tool_calls FROM s GROUP BY ALL""")
def m3_skill_rollup(spark, sf):
    return metrics.skill_metrics(_metric_rounds(spark, sf)).select("run_id", "skill", "rounds", "tokens_in", "tool_calls")


@query(f"""SELECT c_custkey AS id, c_custkey % 50 * 3 * 2 AS sessions, CAST(ceil((c_custkey % 50 * 6) / 6e0) AS BIGINT) * 120000 AS eta_ms, {r('(c_custkey % 50 * 6) * ((12000 * 3e0 + 1500 * 15e0 + 30000 * 0.3e0 + 4000 * 3.75e0) / 1e6)', 4)} AS usd FROM customer""")
def m6_budget(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *metrics.estimate_budget(F.col("c_custkey") % 50, F.lit(3), F.lit(2), F.lit(6)))


@query("SELECT o_custkey AS id, CAST(sum(o_orderkey % 100) AS BIGINT) AS cost_usd, CAST(sum(o_orderkey % 7) AS BIGINT) AS rounds, CAST(sum(o_orderkey % 11) AS BIGINT) AS tokens, max_by(o_orderpriority, o_orderkey) AS quality FROM orders GROUP BY ALL")
def m7_merge_invocations(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), k.alias("ord"), (k % 100).alias("cost_usd"), (k % 7).alias("rounds"), (k % 11).alias("tokens"), F.col("o_orderpriority").alias("quality"))
    return metrics.merge_invocations(o, ["id"], "ord")


@query("""SELECT doc_id, w + CAST(ceil((length(t) - w) / 4e0) AS BIGINT) AS tokens FROM (SELECT doc_id, t, length(regexp_replace(t, '[^\\x{3000}-\\x{303f}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ff00}-\\x{ffef}]', '', 'g')) AS w FROM (SELECT doc_id, '价格、上涨！' || text AS t FROM documents) a) b""")
def m10_tokens_cjk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tokens_est_cjk(F.concat(F.lit("价格、上涨！"), "text")).alias("tokens"))


@query(f"""WITH v AS (SELECT skill, count(*) AS n_versions, min(f) AS first_seen FROM (SELECT n_name AS skill, c_mktsegment AS h, min(c_custkey) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY ALL) x GROUP BY skill),
u AS (SELECT n_name AS skill, count(*) AS runs, CAST(sum(s_suppkey % 9) AS BIGINT) AS rounds FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), e AS (SELECT n_name AS skill, count(*) AS experiments, {r('avg(n_nationkey % 8 / 8e0)')} AS mean_composite, bool_and(n_nationkey % 5 = 0) AS nt FROM nation WHERE n_nationkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(v.skill, u.skill, e.skill) AS skill, coalesce(n_versions, 0) AS n_versions, first_seen, coalesce(runs, 0) AS runs, rounds, coalesce(experiments, 0) AS experiments, mean_composite, coalesce(nt, false) AS never_triggered FROM v FULL OUTER JOIN u ON v.skill = u.skill FULL OUTER JOIN e ON e.skill = coalesce(v.skill, u.skill)""")
def m12_profiles(spark, sf):
    n = table(spark, sf, "nation")
    named = lambda df, key: df.join(n, F.col(key) == F.col("n_nationkey"))
    v = named(table(spark, sf, "customer"), "c_nationkey").filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("skill"), F.col("c_mktsegment").alias("hash"), F.col("c_custkey").alias("created_at"))
    u = named(table(spark, sf, "supplier"), "s_nationkey").select(F.col("n_name").alias("skill"), (F.col("s_suppkey") % 9).alias("rounds"))
    e = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("skill"), (F.col("n_nationkey") % 8 / 8).alias("composite"), F.when(F.col("n_nationkey") % 5 == 0, 0.0).otherwise(1.0).alias("activation_rate"))
    return metrics.skill_profiles(v, u, e)


@query(f"SELECT a.o_custkey AS task_id, a.x AS a, b.x AS b, {r('b.x - a.x')} AS delta FROM (SELECT o_custkey, max(o_orderkey % 1000 / 1000e0) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) a JOIN (SELECT o_custkey, max(o_orderkey % 1000 / 1000e0) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) b USING (o_custkey)")
def m13_paired_models(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("model")).agg(F.max(F.col("o_orderkey") % 1000 / F.lit(1000.0)).alias("composite"))
    return metrics.paired_models(s, "F", "O")


@query("SELECT o_orderpriority AS skill, CAST(o_custkey % 5 AS VARCHAR) AS suite_sha, o_orderstatus AS model, 'r' AS runtime, string_agg(CAST(o_orderkey % 10 AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey % 10) AS series FROM orders GROUP BY ALL")
def m14_skill_trend(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("skill"), (F.col("o_custkey") % 5).cast("string").alias("suite_sha"), F.col("o_orderstatus").alias("model"), F.lit("r").alias("runtime"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 10).alias("composite"))
    return metrics.skill_trend(o).withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("string")), ","))


@query("SELECT event_id, event_type || '@' || user_id AS run, value AS v FROM events ORDER BY ts DESC, event_id DESC")
def m11_list_runs(spark, sf):
    return views.newest_first(table(spark, sf, "events"), "ts", "event_id").select("event_id", F.concat_ws("@", "event_type", F.col("user_id").cast("string")).alias("run"), F.col("value").alias("v"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '***', 'g'), '\\beyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}\\b', '***', 'g'), '(?i)\\b(token|secret|password|apikey|api_key)\\s*[=:]\\s*\\S+', '\\1=***', 'g') AS redacted FROM documents")
def l20_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact_secrets(F.col("text")).alias("redacted"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 2592000000 WHEN 1 THEN 43200000 WHEN 2 THEN 5400000 WHEN 3 THEN 1209600000 WHEN 4 THEN 45000 END AS ms,
  CASE WHEN p_partkey < 1024 THEN CAST(p_partkey AS VARCHAR) || ' B' WHEN p_partkey < 1048576 THEN printf('%.1f KB', floor(p_partkey / 1024e0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', p_partkey / 1048576e0) END AS size FROM part""")
def t6_durations(spark, sf):
    k = F.col("p_partkey")
    d = F.when(k % 6 == 0, "30d").when(k % 6 == 1, " 12H ").when(k % 6 == 2, "90m").when(k % 6 == 3, "2w").when(k % 6 == 4, "45s").otherwise("soon")
    return table(spark, sf, "part").select(k.alias("id"), parse_duration(d).alias("ms"), format_bytes(k).alias("size"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'agent' WHEN 2 THEN 'mcp' WHEN 3 THEN 'builtin' ELSE 'other' END AS kind, CASE c_custkey % 5 WHEN 2 THEN 'plugin_a-b_c' WHEN 0 THEN 'Skill' WHEN 1 THEN 'Agent' WHEN 3 THEN 'Grep' ELSE 'zzz' END AS server FROM customer")
def x24_tool_kind(spark, sf):
    k = F.col("c_custkey")
    n = F.when(k % 5 == 0, "Skill").when(k % 5 == 1, "Agent").when(k % 5 == 2, "mcp__plugin_a-b_c__do_it").when(k % 5 == 3, "Grep").otherwise("zzz")
    return table(spark, sf, "customer").select(k.alias("id"), tool_kind(n).alias("kind"), mcp_server(n).alias("server"))


@query("SELECT c_name, 'run-' || format('{:x}', list_reduce(list_concat([0::BIGINT], list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, u: (a * 31 + u) & 4294967295)) AS run_id FROM customer")
def p14_hash_lite(spark, sf):
    return table(spark, sf, "customer").select("c_name", logs.hash_lite(F.col("c_name")).alias("run_id"))


@query("SELECT event_id AS id, md5(props) AS sha, count(*) OVER (PARTITION BY props) AS same FROM events")
def l1_content_digest(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.md5("props").alias("sha"), F.count("*").over(W.partitionBy("props")).alias("same"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN sha256('{"a":[1,{"y":"é","z":null}],"b":' || CAST(event_id AS VARCHAR) || ',"p":{"k":' || json_extract_string(props, '$.k') || '}}') END AS sha FROM events""")
def l1_canonical_sha(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"p": '), "props", F.lit(', "b": '), F.col("event_id").cast("string"), F.lit(', "a": [1.0, {"z": null, "y": "\\u00e9"}]}'))
    return lint.canonical_sha(e.select("event_id", F.when(F.col("event_id") % 9 != 0, text).otherwise("{broken").alias("doc")), "doc").select("event_id", "sha")


_CASES = "cs AS (SELECT o_orderkey % 1300 AS id, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 1250 END AS superseded_by FROM orders)"


@query(f"WITH {_CASES} SELECT id, count(*) AS occurrences FROM cs GROUP BY id HAVING count(*) > 1")
def l3_duplicates(spark, sf):
    return lint.duplicates(table(spark, sf, "orders").select((F.col("o_orderkey") % 1300).alias("id")))


@query(f"WITH {_CASES} SELECT id, superseded_by FROM cs WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM cs)")
def l4_dangling(spark, sf):
    k = F.col("o_orderkey")
    return lint.dangling(table(spark, sf, "orders").select((k % 1300).alias("id"), F.when(k % 9 == 0, k + 1250).alias("superseded_by")))


@query("""WITH o AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents WHERE doc_id % 3 <> 1), n AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0)
SELECT id, 'not-superset' AS code FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'content-changed' FROM o JOIN n USING (id) WHERE o.sha <> n.sha""")
def l5_lineage(spark, sf):
    d = table(spark, sf, "documents")
    old = d.filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    new = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return lint.lineage(old, new)


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def l6_shared_ids(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 45").withColumnRenamed("l_suppkey", "id")
    return lint.shared_ids(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'smoke' ELSE 'full' END AS part FROM documents")
def l7_tiers(spark, sf):
    return lint.tiers(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "smoke").alias("tier"))).select("id", "part")


@query("SELECT p_type || '/' || p_brand AS skill, count(*) AS current_n, 5 - count(*) AS need_more FROM part WHERE p_size > 20 GROUP BY ALL HAVING count(*) < 5")
def l8_skill_coverage(spark, sf):
    return lint.skill_coverage(table(spark, sf, "part").filter("p_size > 20").select(F.array(F.concat_ws("/", "p_type", "p_brand")).alias("expected")))


@query("SELECT count(*) FILTER (WHERE c_acctbal > 9000) AS with_multi, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 9000) / CAST(count(*) AS DOUBLE) AS pct FROM customer HAVING count(*) FILTER (WHERE c_acctbal > 9000) / CAST(count(*) AS DOUBLE) < 0.15")
def l9_multi_intent(spark, sf):
    return lint.multi_intent(table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 9000, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("multi_intent")))


@query("SELECT count(*) FILTER (WHERE s_suppkey % 2 = 0) AS n FROM supplier HAVING count(*) FILTER (WHERE s_suppkey % 2 = 0) NOT BETWEEN 20 AND 30")
def l10_smoke_size(spark, sf):
    return lint.smoke_size(table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "smoke").alias("tier")))


@query("SELECT p_partkey AS id, p_brand AS skill FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#32') AND p_size % 3 = 0")
def l10_redundant_auxiliary(spark, sf):
    allowed = F.when(F.col("p_size") % 3 == 0, F.array(*map(F.lit, ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#32")))).otherwise(F.array().cast("array<string>"))
    return lint.redundant_auxiliary(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("expected"), allowed.alias("allowed")))


@query("SELECT doc_id AS name, length(text) AS chars FROM documents WHERE length(text) > 1024")
def l11_description_length(spark, sf):
    return lint.description_length(table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("description")))


@query("SELECT lower(trim(split_part(text, ' ', 1))) AS term, string_agg(DISTINCT source, ',' ORDER BY source) AS skills FROM documents WHERE trim(split_part(text, ' ', 1)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def l12_collision(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("name"), F.split_part("text", F.lit(" "), F.lit(1)).alias("term"))
    return lint.trigger_collisions(d).withColumn("skills", F.array_join("skills", ","))


@query("SELECT lang || CAST(doc_id % 40 AS VARCHAR) AS path, count(DISTINCT md5(text)) AS variants, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT md5(text)) > 1")
def l13_drift(spark, sf):
    return lint.shared_drift(table(spark, sf, "documents").select(F.col("source").alias("name"), F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("path"), F.col("text").alias("content")))


@query("SELECT doc_id AS name, length(text) AS desc_chars, len(string_split(text, ' ')) AS trigger_count, 0 AS shared_refs, CAST(ceil(length(text) / 4e0) AS BIGINT) AS tax_tokens FROM documents")
def l14_tax(spark, sf):
    return lint.tax_table(table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("description"), F.split("text", " ").alias("triggers"), F.array().alias("shared")))


@query("SELECT count(DISTINCT o_orderstatus) AS versions, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS seen FROM orders HAVING count(DISTINCT o_orderstatus) > 1")
def l15_declared_versions(spark, sf):
    return lint.declared_versions(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("version"))).withColumn("seen", F.array_join("seen", ","))


@query("""WITH e AS (SELECT event_id, event_id % 5 AS m, props FROM events) SELECT event_id, CASE m WHEN 0 THEN 'not json' WHEN 1 THEN '{"result": 3}' WHEN 2 THEN '{"result": "x", "trace": [{"usage": {"in": 1}, "triggers": []}]}' WHEN 3 THEN '{"result": "x", "skills_inventory": {"a": {}}, "observability": []}' ELSE props END AS raw,
  m <> 0 AS parses, m <> 0 AS is_object, m IN (2, 3) AS has_result, m IN (2, 3) AS ok, m = 2 AS trace, m = 2 AS usage, m = 2 AS triggers, false AS "refReads", m = 3 AS skills_inventory, false AS runtime_info, m = 3 AS observability FROM e""")
def l16_adapter_channels(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, "not json").when(k % 5 == 1, '{"result": 3}').when(k % 5 == 2, '{"result": "x", "trace": [{"usage": {"in": 1}, "triggers": []}]}').when(k % 5 == 3, '{"result": "x", "skills_inventory": {"a": {}}, "observability": []}').otherwise(F.col("props"))
    return lint.adapter_channels(table(spark, sf, "events").select("event_id", raw.alias("raw")))


@query("""WITH d AS (SELECT DISTINCT p_brand AS key FROM part), k AS (SELECT * FROM (VALUES (1, 'Brand#19'), (2, 'Brand-12'), (3, 'Brand#5'), (4, 'Brand#21')) x(i, known))
SELECT key, min_by(known, i) AS meant FROM d, k WHERE levenshtein(key, known) <= 2 AND key NOT IN (SELECT known FROM k) GROUP BY key""")
def l17_near_miss(spark, sf):
    return lint.near_misses(table(spark, sf, "part").select(F.col("p_brand").alias("key")), ["Brand#19", "Brand-12", "Brand#5", "Brand#21"])


@query("SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS digests, min_by(o_orderpriority, o_orderkey) AS hoisted, count(DISTINCT o_orderpriority) > 1 AS drift FROM orders GROUP BY ALL")
def l19_digest_drift(spark, sf):
    return lint.digest_drift(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("ord")), ["id"], "p")


@query("SELECT doc_id, CASE WHEN p > 41 THEN '…' ELSE '' END || regexp_replace(substring(text, b, e - b + 1), '\\s+', ' ', 'g') || CASE WHEN e < n THEN '…' ELSE '' END AS snippet FROM (SELECT *, greatest(1, p - 40) AS b, least(n, p - 1 + 5 + 40) AS e FROM (SELECT doc_id, text, strpos(lower(text), 'token') AS p, length(text) AS n FROM documents) x WHERE p > 0) y ORDER BY doc_id LIMIT 50")
def t1_search(spark, sf):
    return trend.search(table(spark, sf, "documents"), "text", "doc_id", "Token").select("doc_id", "snippet")


_REPORTS = "rp AS (SELECT c_mktsegment AS cohort, CAST((o_orderkey // 40) % 3 AS VARCHAR) AS lineage, o_orderdate AS created_at, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey), sg AS (SELECT *, sum(ch) OVER (PARTITION BY cohort ORDER BY created_at, id) AS segment FROM (SELECT *, CASE WHEN lag(lineage) OVER (PARTITION BY cohort ORDER BY created_at, id) = lineage THEN 0 ELSE 1 END AS ch FROM rp) z)"


def _reports(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(F.col("c_mktsegment").alias("cohort"), (F.floor(F.col("o_orderkey") / 40) % 3).cast("string").alias("lineage"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))


@query(f"WITH {_REPORTS} SELECT cohort, id, lineage, CAST(segment AS BIGINT) AS segment FROM sg")
def t3_trend_segments(spark, sf):
    return trend.segments(_reports(spark, sf)).select("cohort", "id", "lineage", "segment")


@query(f"""WITH {_REPORTS}, c AS (SELECT l_orderkey AS id, l_linenumber AS case_id, CAST(l_quantity AS BIGINT) AS delta FROM lineitem), n AS (SELECT cohort, segment, count(*) AS n FROM sg GROUP BY ALL),
p AS (SELECT cohort, segment, case_id, count(DISTINCT id) AS k, string_agg(CAST(delta AS VARCHAR), ',' ORDER BY created_at, id, delta) AS deltas FROM sg JOIN c USING (id) GROUP BY ALL) SELECT cohort, CAST(segment AS BIGINT) AS segment, case_id, deltas FROM p JOIN n USING (cohort, segment) WHERE k = n""")
def t4_segment_cases(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("case_id"), F.col("l_quantity").cast("long").alias("delta"))
    return trend.segment_cases(trend.segments(_reports(spark, sf)), c).withColumn("deltas", F.array_join(F.transform("deltas", lambda x: x.cast("string")), ","))


@query(f"WITH {_REPORTS} SELECT id, lag(id) OVER (PARTITION BY cohort, lineage ORDER BY created_at, id) AS prev_id FROM rp")
def t8_previous(spark, sf):
    return trend.previous(_reports(spark, sf), ["cohort", "lineage"]).select("id", "prev_id")


@query("""WITH i AS (SELECT event_id AS id, user_id % 3 AS kind, epoch_us(ts) // 1000 AS ts_ms FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts_ms DESC, id) AS r FROM i) SELECT id FROM k WHERE 1706745600000 - ts_ms > 1728000000 OR r > 100""")
def t5_retention(spark, sf):
    i = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return trend.prune(i, ["kind"], 1706745600000, older_than_ms=1728000000, most=100).select("id")


@query("SELECT doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE source END AS value FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def t7_upsert(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("value"))
    return trend.upsert(d, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("value")).distinct(), ["id"])


@query(f"""WITH {EVENTS}, rn AS (SELECT run_id, epoch_us(min(ts)) // 1000 AS s, epoch_us(max(ts)) // 1000 AS e FROM ev GROUP BY ALL), t AS (SELECT run_id, ordinal, epoch_us(ts) // 1000 AS s, event_type FROM ev)
SELECT left(sha256('run:' || run_id), 32) AS trace_id, left(sha256('run:' || run_id || ':root'), 16) AS span_id, NULL AS parent_span_id, 'invoke_agent' AS name, CAST(s * 1000000 AS VARCHAR) AS start_ns, CAST(e * 1000000 AS VARCHAR) AS end_ns, 1 AS n_attributes FROM rn
UNION ALL SELECT left(sha256('run:' || run_id), 32), left(sha256('run:' || run_id || ':r' || CAST(ordinal AS VARCHAR)), 16), left(sha256('run:' || run_id || ':root'), 16), 'chat', CAST(s * 1000000 AS VARCHAR), CAST((s + 5) * 1000000 AS VARCHAR), 3 FROM t
UNION ALL SELECT left(sha256('run:' || run_id), 32), left(sha256('run:' || run_id || ':r' || CAST(ordinal AS VARCHAR) || ':' || event_type), 16), left(sha256('run:' || run_id || ':r' || CAST(ordinal AS VARCHAR)), 16), 'execute_tool', CAST(s * 1000000 AS VARCHAR), CAST((s + 5) * 1000000 AS VARCHAR), 3 FROM t WHERE event_type <> 'view'""")
def s15_spans(spark, sf):
    e = events(spark, sf).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    runs = e.groupBy("run_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms")).withColumn("model", F.lit(None).cast("string"))
    nobody = F.lit(None).cast("string").alias("agent_id")
    rounds = e.select("run_id", nobody, F.col("ordinal").alias("seq"), F.col("ms").alias("start_ms"), F.lit(5).alias("duration_ms"), F.lit("m").alias("model"), F.lit(1).alias("u_in"), F.lit(None).cast("int").alias("u_out"), F.lit("").alias("stop_reason"))
    calls = e.filter("event_type <> 'view'").select("run_id", nobody, F.col("ordinal").alias("round_seq"), F.lit(None).cast("string").alias("call_id"), F.col("event_type").alias("name"), F.lit(True).alias("is_error"))
    return otel.run_spans(runs, rounds, calls).withColumn("n_attributes", F.size("attributes")).drop("attributes")

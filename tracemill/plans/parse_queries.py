"""Logs with side chains, compaction marks, bodies that hang back, broken and unknown lines, parsed and compared with SQL.

One conversation is one log.  Assistant turns are odd; three consecutive turns share a request.  A user turn is plain,
injected, the body of the skill that the call before it loaded, or what came back for that call.  Some conversations
have a side chain, some are a side chain's own transcript.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.plans.bindings import table
from tracemill.plans.registry import query
from tracemill.sources import logs

_SIDE = "(conv_id % 8 = 5 OR (conv_id % 4 = 1 AND turn % 4 = 3 AND role = 'assistant'))"
_KIND = "(conv_id + turn) % 4"


def tangled(spark, sf) -> DataFrame:
    """(source, value) of each conversation."""
    c = table(spark, sf, "conversations")
    t, k = F.col("turn"), F.expr(_KIND)
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    tail = F.concat(F.lit(',"sessionId":"s'), "conv_id", F.lit("-"), t, F.lit('","cwd":"/w/'), t, F.lit('"')), F.concat(F.lit(',"version":"1.'), t, F.lit('"'))
    head = F.concat(F.lit('"timestamp":"2026-01-01T00:'), F.format_string("%02d:%02d", F.floor(t / 60), t % 60), F.lit('.500Z","isSidechain":'), F.expr(_SIDE).cast("string"), F.when(t > 0, tail[0]).otherwise(""), F.when(t % 2 == 1, tail[1]).otherwise(""))
    call = F.concat(F.lit('{"type":"tool_use","id":"t'), t, F.lit('","name":"Skill","input":{"skill":"sk'), t % 3, F.lit('"}}'))
    said = F.concat(F.lit('{"type":"assistant",'), head, F.lit(',"agentId":"ag","requestId":"'), F.when(F.expr(_SIDE), "s").otherwise("q"), F.floor(t / 3), F.lit('","message":{"model":"m'), t, F.lit('","stop_reason":'), F.when(t % 4 == 1, '"tool_use"').otherwise("null"), F.lit(',"content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), quoted(F.col("text")), F.lit("},"), call, F.lit(","), call, F.lit('],"usage":{"input_tokens":'), t + 1, F.lit(',"cache_read_input_tokens":'), F.length("text"), F.lit("}}}"))
    back = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t'), t - 1, F.lit('","content":[{"type":"text","text":'), quoted(F.col("text")), F.lit('},{"type":"image"}]},{"type":"text","text":'), quoted(F.col("text")), F.lit("}]"))
    meta = F.when(k == 1, ',"isMeta":true').when(k == 2, F.concat(F.lit(',"isMeta":true,"sourceToolUseID":"t'), t - 1, F.lit('"'))).otherwise("")
    asked = F.concat(F.lit('{"type":"user",'), head, meta, F.lit(',"message":{"content":'), F.when(k == 3, back).otherwise(quoted(F.col("text"))), F.lit("}}"))
    mark = F.concat(F.lit('{"type":"compact-boundary",'), head, F.lit("}"))
    lines = F.array_compact(F.array(F.when(t % 3 == 2, mark), F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", asked), F.lit('{"type":"system"}'), F.when(t % 5 == 4, '{"type":"assistant","requestId'), F.when(t % 4 == 3, '{"type":"mystery"}')))
    rows = c.select(F.col("conv_id").cast("string").alias("source"), t.alias("turn"), lines.alias("lines"))
    return rows.groupBy("source").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "lines"))), lambda x: x["lines"])), "\r\n").alias("value"))


def parsed(spark, sf) -> logs.Parsed:
    return logs.parse(logs.lines_of(tangled(spark, sf)))


_T = f"cv AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS run_id, turn, role, text, {_SIDE} AS side, {_KIND} AS k, printf('2026-01-01T00:%02d:%02d.500Z', turn // 60, turn % 60) AS ts FROM conversations)"
_R = f"""{_T}, rd AS (SELECT conv_id, run_id, side, turn // 3 AS q, min(turn) AS t0, string_agg(text, '' ORDER BY turn) AS text, repeat('hm', count(*)) AS thinking, max_by(turn + 1 + length(text), turn) AS footprint, min_by('m' || CAST(turn AS VARCHAR), turn) AS model, max(CASE WHEN turn % 4 = 1 THEN 'tool_use' END) AS stop_reason FROM cv WHERE role = 'assistant' GROUP BY ALL)"""
_CHAIN = "CASE WHEN side AND conv_id % 8 <> 5 THEN 'side' ELSE 'main' END"


@query(f"WITH {_T} SELECT run_id, count(*) FILTER (WHERE turn % 5 = 4) + count(*) FILTER (WHERE turn % 4 = 3) AS parse_warnings FROM cv GROUP BY ALL")
def p1_warnings(spark, sf):
    return parsed(spark, sf).runs.select("run_id", F.col("parse_warnings"))


@query(f"""WITH {_T}, l AS (SELECT * FROM cv WHERE role <> 'system' OR turn % 3 = 2) SELECT run_id, min_by('s' || run_id || '-' || CAST(turn AS VARCHAR), turn) FILTER (WHERE turn > 0) AS session_id, min_by('/w/' || CAST(turn AS VARCHAR), turn) FILTER (WHERE turn > 0) AS cwd, min_by('1.' || CAST(turn AS VARCHAR), turn) FILTER (WHERE turn % 2 = 1) AS version, min(ts) AS started_raw, max(ts) AS ended_raw,
  min_by('m' || CAST(turn AS VARCHAR), (CASE WHEN side AND conv_id % 8 <> 5 THEN 1000000 ELSE 0 END) + turn) FILTER (WHERE role = 'assistant') AS model, CASE WHEN bool_or(role = 'assistant') AND conv_id % 8 = 5 THEN 'ag' END AS agent_id FROM l GROUP BY run_id, conv_id""")
def p2_heads(spark, sf):
    return parsed(spark, sf).runs.select("run_id", "session_id", "cwd", "version", "started_raw", "ended_raw", "model", "agent_id")


@query(f"WITH {_T} SELECT run_id, 't' || CAST(turn AS VARCHAR) AS call_id, 'sk' || CAST(turn % 3 AS VARCHAR) AS skill, {_CHAIN} AS chain, CASE WHEN {_CHAIN} = 'main' THEN row_number() OVER (PARTITION BY conv_id, {_CHAIN} ORDER BY turn) - 1 END AS ordinal FROM cv WHERE role = 'assistant'")
def p4_calls(spark, sf):
    return parsed(spark, sf).tool_calls.select("run_id", "call_id", "skill", "chain", "ordinal")


@query(f"WITH {_T} SELECT a.run_id, 't' || CAST(a.turn AS VARCHAR) AS call_id, u.text AS skill_body FROM cv a JOIN cv u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' AND u.k = 2 WHERE a.role = 'assistant'")
def p6_skill_bodies(spark, sf):
    return parsed(spark, sf).tool_calls.filter("skill_body is not null").select("run_id", "call_id", "skill_body")


@query(f"WITH {_T} SELECT run_id, CASE k WHEN 0 THEN 'user' WHEN 1 THEN 'meta-injected' WHEN 2 THEN 'skill-body' ELSE 'tool-result-side' END AS src_kind, count(*) AS events, CAST(sum(length(text)) AS BIGINT) AS chars FROM cv WHERE role = 'user' GROUP BY ALL")
def p7_sources(spark, sf):
    return parsed(spark, sf).user_events.groupBy("run_id", "src_kind").agg(F.count("*").alias("events"), F.sum("chars").alias("chars"))


@query(f"WITH {_T} SELECT run_id, CASE WHEN conv_id % 8 <> 5 OR bool_or(role = 'assistant') THEN min_by(text, turn) FILTER (WHERE role = 'user') END AS prompt FROM cv GROUP BY run_id, conv_id")
def p8_prompts(spark, sf):
    return parsed(spark, sf).runs.select("run_id", "prompt")


@query(f"WITH {_T} SELECT a.run_id, 't' || CAST(a.turn AS VARCHAR) AS call_id, u.text || chr(10) || '[image]' AS result FROM cv a JOIN cv u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' AND u.k = 3 WHERE a.role = 'assistant'")
def p10_result_texts(spark, sf):
    return parsed(spark, sf).tool_calls.filter("result is not null").select("run_id", "call_id", "result")


@query(f"WITH {_R} SELECT run_id, {_CHAIN} AS chain, CASE WHEN side THEN 'ag' END AS agent_id, count(*) AS rounds FROM rd GROUP BY ALL")
def p11_chains(spark, sf):
    return parsed(spark, sf).rounds.groupBy("run_id", "chain", "agent_id").agg(F.count("*").alias("rounds"))


@query(f"""WITH {_R}, i AS (SELECT conv_id, run_id, side, t0, 1 AS o, q FROM rd UNION ALL SELECT conv_id, run_id, side, turn, 0, NULL FROM cv WHERE turn % 3 = 2),
j AS (SELECT *, lag(o) OVER (PARTITION BY conv_id, side ORDER BY t0, o) AS p FROM i) SELECT run_id, {_CHAIN} AS chain, q, coalesce(p = 0, false) AS compact_before FROM j WHERE o = 1""")
def p12_compactions(spark, sf):
    p = parsed(spark, sf)
    q = p.tool_calls.groupBy("run_id", "round_id").agg(F.min(F.floor(F.substring("call_id", 2, 9).cast("int") / 3)).alias("q"))
    return p.rounds.join(q, ["run_id", "round_id"]).select("run_id", "chain", "q", "compact_before")


@query(f"""WITH {_R}, en AS (SELECT conv_id, max(turn) AS e FROM cv WHERE role <> 'system' OR turn % 3 = 2 GROUP BY ALL), s AS (SELECT rd.*, row_number() OVER w AS seq, lead(t0) OVER w AS nx FROM rd WINDOW w AS (PARTITION BY conv_id, side ORDER BY t0))
SELECT run_id, {_CHAIN} AS chain, seq, text, thinking, footprint, model, stop_reason, greatest(0, (coalesce(nx, e) - t0) * 1000) AS duration_ms FROM s JOIN en USING (conv_id)""")
def p13_finalized_rounds(spark, sf):
    return parsed(spark, sf).rounds.select("run_id", "chain", "seq", "text", "thinking", "footprint", "model", "stop_reason", "duration_ms")

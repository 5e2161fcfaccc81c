"""Logs made of the conversations table, parsed and compared with what SQL says of that table.

Assistant turns are assistant lines, three consecutive turns sharing one request; user turns bring back the result of
the call in the turn before; system turns are attachments.  One conversation is one log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import metrics
from tracemill.plans.bindings import table
from tracemill.plans.registry import query
from tracemill.sources import logs


def session_logs(spark, sf) -> DataFrame:
    """(source, value) of each conversation."""
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    stamp = F.format_string("2026-01-01T%02d:%02d:%02d.000Z", (t / 3600).cast("int"), (t % 3600 / 60).cast("int"), (t % 60).cast("int"))
    name = F.when(t % 2 == 0, "Bash").otherwise("Skill")
    arg = F.to_json(F.struct(F.concat(F.lit("wallet send "), t.cast("string"), F.lit(" && ls")).alias("command"), F.concat(F.lit("sk"), (t % 3).cast("string")).alias("skill")))
    line = lambda head, body: F.concat(F.lit('{"type":"'), F.lit(head), F.lit('","timestamp":"'), stamp, F.lit('",'), body, F.lit("}"))
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    said = F.concat(
        F.lit('"requestId":"q'), F.floor(t / 3).cast("string"), F.lit('","message":{"model":"m","content":[{"type":"text","text":'), quoted(F.col("text")), F.lit('},{"type":"tool_use","id":"t'), t.cast("string"),
        F.lit('","name":"'), name, F.lit('","input":'), arg, F.lit('}],"usage":{"input_tokens":'), F.length("text").cast("string"), F.lit(',"output_tokens":'), t.cast("string"), F.lit("}}"),
    )
    back = F.concat(F.lit('"message":{"content":[{"type":"tool_result","tool_use_id":"t'), (t - 1).cast("string"), F.lit('","is_error":'), (t % 3 == 0).cast("string"), F.lit(',"content":'), quoted(F.col("text")), F.lit("}]}"))
    note = F.concat(F.lit('"attachment":{"a":'), quoted(F.col("text")), F.lit("}"))
    raw = F.when(F.col("role") == "assistant", line("assistant", said)).when(F.col("role") == "user", line("user", back)).otherwise(line("attachment", note))
    rows = c.select(F.col("conv_id").cast("string").alias("source"), t.alias("turn"), raw.alias("raw"))
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "raw"))), lambda x: x["raw"]), "\n").alias("value"))


def parsed(spark, sf) -> logs.Parsed:
    return logs.parse(logs.lines_of(session_logs(spark, sf)))


_ROUNDS = """rd AS (SELECT conv_id, turn // 3 AS q, min(turn) AS t0, max(turn) AS t1, string_agg(text, '' ORDER BY turn) AS text, max_by(length(text), turn) AS footprint, count(*) AS n_calls FROM conversations WHERE role = 'assistant' GROUP BY ALL),
en AS (SELECT conv_id, max(turn) AS e FROM conversations GROUP BY ALL), rs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t0) AS seq FROM rd),
cl AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 0 THEN 'Bash' ELSE 'Skill' END AS name, u.turn IS NOT NULL AND u.turn % 3 = 0 AS is_error, u.text AS result FROM conversations c LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1 AND u.role = 'user' WHERE c.role = 'assistant')"""


@query(f"""WITH {_ROUNDS} SELECT CAST(rs.conv_id AS VARCHAR) AS run_id, seq, text, footprint, t1 AS out, coalesce(lead(t0) OVER (PARTITION BY rs.conv_id ORDER BY t0), e) * 1000 - t0 * 1000 AS duration_ms FROM rs JOIN en USING (conv_id)""")
def p3_rounds(spark, sf):
    return parsed(spark, sf).rounds.select("run_id", "seq", "text", "footprint", F.col("usage.out").alias("out"), "duration_ms")


@query(f"WITH {_ROUNDS} SELECT CAST(conv_id AS VARCHAR) AS run_id, 't' || CAST(turn AS VARCHAR) AS call_id, name, is_error, result, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM cl")
def p5_tool_results(spark, sf):
    return parsed(spark, sf).tool_calls.select("run_id", "call_id", "name", "is_error", "result", "ordinal")


@query("SELECT CAST(conv_id AS VARCHAR) AS run_id, text, 'attachment' AS src_kind FROM conversations WHERE role = 'system' AND length(text) > 2")
def p9_user_events(spark, sf):
    return parsed(spark, sf).user_events.select("run_id", "text", "src_kind")


@query(f"""WITH {_ROUNDS}, s AS (SELECT conv_id, 'sk' || CAST(turn % 3 AS VARCHAR) AS skill, min(turn) AS f FROM cl WHERE name = 'Skill' GROUP BY ALL) SELECT CAST(conv_id AS VARCHAR) AS run_id, skill, row_number() OVER (PARTITION BY conv_id ORDER BY f) = 1 AS is_primary FROM s""")
def p16_triggers(spark, sf):
    return logs.triggers(parsed(spark, sf).tool_calls).select("run_id", "skill", "is_primary")


@query(f"WITH {_ROUNDS} SELECT CAST(conv_id AS VARCHAR) AS run_id, 'wallet' AS tool, 'send ' || CAST(turn AS VARCHAR) AS cmd FROM cl WHERE name = 'Bash'")
def d3_invocations(spark, sf):
    probe = {"tool": "wallet", "match": {"toolName": "Bash", "commandPattern": r"^wallet\s+(\w+)\s+(\d+)"}}
    return logs.invocations(parsed(spark, sf).tool_calls, [probe]).select("run_id", "tool", "cmd")


@query(f"""WITH {_ROUNDS}, r AS (SELECT conv_id, count(*) AS rounds, CAST(sum(footprint) AS BIGINT) AS tokens_in, CAST(sum(t1) AS BIGINT) AS tokens_out, max(footprint) AS peak_context FROM rs GROUP BY ALL), c AS (SELECT conv_id, count(*) AS tool_calls, count(*) FILTER (WHERE is_error) AS tool_errors FROM cl GROUP BY ALL), b AS (SELECT conv_id, min(turn) AS s, max(turn) AS e FROM conversations GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS run_id, rounds, tokens_in, tokens_out, tool_calls, tool_errors, peak_context, (e - s) * 1000 AS duration_ms FROM r JOIN c USING (conv_id) JOIN b USING (conv_id)""")
def s2_ingest(spark, sf):
    p = parsed(spark, sf)
    m = metrics.run_metrics(logs.run_rounds(p), p.runs)
    return m.select("run_id", "rounds", "tokens_in", "tokens_out", "tool_calls", "tool_errors", "peak_context", "duration_ms")

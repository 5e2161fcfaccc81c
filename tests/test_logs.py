"""The log parser on hand-made sessions, against what a line-by-line reader would hold."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics
from tracemill.sources import logs, otel


def use(i, name, **inp):
    return {"type": "tool_use", "id": i, "name": name, "input": inp}


def said(req, ts, content, side=False, usage=None, **more):
    return {"type": "assistant", "requestId": req, "timestamp": ts, "isSidechain": side, "message": {"model": "m-sonnet", "content": content, "usage": usage, "stop_reason": more.pop("stop", None)}, **more}


def back(ts, *blocks, **more):
    return {"type": "user", "timestamp": ts, "message": {"content": list(blocks)}, **more}


T = "2026-01-01T00:00:%02d.000Z"
LINES = [
    {"type": "user", "sessionId": "s1", "cwd": "/w", "timestamp": T % 0, "message": {"content": "do it 😀"}},
    said("q1", T % 1, [{"type": "text", "text": "Hel"}], usage={"input_tokens": 5, "output_tokens": 1}),
    said("q1", T % 2, [{"type": "text", "text": "lo"}, use("t1", "Skill", skill="sk"), use("t1", "Skill", skill="sk")], usage={"input_tokens": 1000, "output_tokens": 50, "cache_read_input_tokens": 4000, "cache_creation_input_tokens": 1000}, stop="tool_use"),
    back(T % 3, {"type": "tool_result", "tool_use_id": "t1", "content": "Launching skill"}, {"type": "text", "text": "reminder"}),
    back(T % 3, {"type": "text", "text": "body one"}, isMeta=True, sourceToolUseID="t1"),
    back(T % 3, {"type": "text", "text": "body two"}, isMeta=True, sourceToolUseID="t1"),
    back(T % 3, {"type": "tool_result", "tool_use_id": "t9", "content": "before its call"}),
    {"type": "compact-boundary", "timestamp": T % 4},
    said("q2", T % 5, [use("t2", "Bash", command="wallet send 5 && ls"), use("t9", "Read", file_path="/p/skills/sk/references/a.md")], usage={"input_tokens": 7500}, attributionSkill="sk"),
    back(T % 6, {"type": "tool_result", "tool_use_id": "t2", "is_error": True, "content": [{"type": "text", "text": "bad"}, {"type": "image"}]}, {"type": "tool_result", "tool_use_id": "t9", "content": "ref"}),
    back(T % 6, {"type": "tool_result", "tool_use_id": "t2", "toolDenialKind": "user-rejected", "content": "late"}),
    said("q2", T % 7, [{"type": "text", "text": "side"}], side=True, agentId="ag", usage={"input_tokens": 3}),
    said("q3", T % 8, [{"type": "thinking", "thinking": "hm"}], stop="end_turn"),
    {"type": "attachment", "timestamp": T % 9, "attachment": {"a": ["xy", "long string", {"b": "deep one"}]}},
    {"type": "result", "total_cost_usd": 0.5, "num_turns": 2, "duration_ms": 10, "is_error": False},
    {"type": "system"},
    {"type": "nonsense"},
]


@pytest.fixture(scope="module")
def parsed(spark):
    text = "\n".join(json.dumps(x) for x in LINES) + "\n\n{broken\n"
    pure = "\r\n".join(json.dumps(x) for x in [{"type": "user", "isSidechain": True, "timestamp": T % 0, "message": {"content": "sub ask"}}, said("z", T % 1, [{"type": "text", "text": "x"}], side=True, agentId="solo")])
    return logs.parse(logs.lines_of(spark.createDataFrame([("one", text), ("pure", pure)], "source string, value string")))


def test_runs(parsed):
    r = {x.run_id: x for x in parsed.runs.collect()}
    one = r["one"]
    assert (one.session_id, one.cwd, one.prompt, one.parse_warnings, one.model) == ("s1", "/w", "do it 😀", 2, "m-sonnet")
    assert (one.started_raw, one.ended_raw) == (T % 0, T % 9)
    assert (r["pure"].agent_id, r["pure"].prompt) == ("solo", "sub ask")


def test_rounds(parsed):
    rows = [x for x in parsed.rounds.collect() if x.run_id == "one"]
    main = sorted((x for x in rows if x.chain == "main"), key=lambda x: x.seq)
    assert [(x.seq, x.text, x.thinking, x.footprint, x.compact_before, x.stop_reason) for x in main] == [(1, "Hello", "", 6000, False, "tool_use"), (2, "", "", 7500, True, None), (3, "", "hm", 0, False, "end_turn")]
    assert [x.duration_ms for x in main] == [4000, 3000, 1000]
    assert main[0].usage["out"] == 50 and main[1].attribution_skill == "sk"
    side = [x for x in rows if x.chain == "side"]
    assert [(x.agent_id, x.text) for x in side] == [("ag", "side")]
    assert [x.chain for x in parsed.rounds.collect() if x.run_id == "pure"] == ["main"]


def test_calls(parsed):
    c = {x.call_id: x for x in parsed.tool_calls.collect()}
    assert len(c) == 3 and [c[k].ordinal for k in ("t1", "t2", "t9")] == [0, 1, 2]
    assert (c["t1"].skill, c["t1"].result, c["t1"].skill_body, c["t1"].is_error) == ("sk", "Launching skill", "body one\nbody two", False)
    assert (c["t2"].is_error, c["t2"].denial_kind, c["t2"].result) == (True, "user-rejected", "late")
    assert c["t9"].result == "ref"


def test_events(parsed):
    e = [(x.src_kind, x.text, x.chars) for x in sorted(parsed.user_events.collect(), key=lambda x: x.line_no) if x.run_id == "one"]
    assert e == [("user", "do it 😀", 8), ("tool-result-side", "reminder", 8), ("skill-body", "body one", 8), ("skill-body", "body two", 8), ("attachment", "long string\ndeep one", 20)]
    assert [(x.chain, x.ts) for x in parsed.compactions.collect()] == [("main", T % 4)]
    assert [(x.total_cost_usd, x.num_turns) for x in parsed.self_reports.collect()] == [(0.5, 2)]


def test_derived(parsed):
    assert [(x.skill, x.is_primary) for x in logs.triggers(parsed.tool_calls).collect()] == [("sk", True)]
    assert [(x.skill, x.logical_ref) for x in logs.reads(parsed.tool_calls).collect()] == [("sk", "sk/references/a.md")]
    probe = {"tool": "wallet", "match": {"toolName": "Bash", "commandPattern": r"^wallet\s+(\w+)"}}
    assert [(x.cmd, x.ordinal) for x in logs.invocations(parsed.tool_calls, [probe]).collect()] == [("send", 1)]
    m = {x.run_id: x for x in metrics.run_metrics(logs.run_rounds(parsed), parsed.runs).collect()}["one"]
    assert (m.rounds, m.sidechain_rounds, m.tool_calls, m.tool_errors, m.peak_context, m.duration_ms) == (3, 1, 3, 1, 7500, 9000)
    s = [x for x in metrics.skill_metrics(logs.run_rounds(parsed)).collect()]
    assert [(x.skill, x.rounds) for x in s] == [("sk", 2)]


def test_shared_reads_and_hash(spark):
    d = spark.createDataFrame([("/x/skills/a/_shared/u.md", "t"), ("C:\\skills\\b\\f.md", None), ("/etc", "t")], "p string, r string")
    got = [x.a for x in d.select(logs.attribute_read(F.col("p"), F.col("r")).alias("a")).collect()]
    assert got[0].logical_ref == "_shared/u.md#e358efa489f58062f10dd7316b65649e" and got[0].shared and got[1].logical_ref == "b/f.md" and got[2] is None

    def lite(s):
        h = 0
        u = s.encode("utf-16-be")
        for k in range(0, len(u), 2):
            h = (h * 31 + int.from_bytes(u[k : k + 2], "big")) & 0xFFFFFFFF
        return f"run-{h:x}"

    texts = ["abc", "a😀b", "", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(logs.hash_lite(F.col("t"))).collect()
    assert [r[0] for r in rows] == [lite(t) for t in texts]


def test_files_and_export(spark, tmp_path, parsed):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/run7.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    (tmp_path / "in/skip.txt").write_text("{}")
    p = logs.parse(logs.read_lines(spark, f"file://{tmp_path}/in"))
    assert [r.run_id for r in p.runs.collect()] == ["run7"]
    runs = p.runs.select("run_id", "model", F.unix_millis("started_at").alias("start_ms"), F.unix_millis("ended_at").alias("end_ms"))
    rounds = p.rounds.select("run_id", "agent_id", "seq", F.unix_millis(F.try_to_timestamp("ts")).alias("start_ms"), "duration_ms", "model", F.col("usage.in").alias("u_in"), F.col("usage.out").alias("u_out"), "stop_reason")
    spans = otel.run_spans(runs, rounds, p.tool_calls)
    otel.write_otlp(spans, f"file://{tmp_path}/out")
    docs = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    names = [s["name"] for d in docs for s in d["resourceSpans"][0]["scopeSpans"][0]["spans"]]
    assert sorted(names) == ["chat"] * 4 + ["execute_tool"] * 3 + ["invoke_agent"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        otel.write_otlp(spans, f"file://{tmp_path}/out")


def test_long_logs_are_read_in_splits_and_in_order(spark, tmp_path):
    lines = [json.dumps({"type": "user", "n": k, "timestamp": T % 0, "message": {"content": "x" * 200}}) for k in range(6000)]
    (tmp_path / "long.jsonl").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "deep").mkdir()
    for k in range(3):
        (tmp_path / "deep" / f"s{k}.jsonl").write_text("\n\n".join(lines[: k + 1]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        rows = logs.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = rows.orderBy("source", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.raw for r in got if r.source == "long"] == lines
    assert [[r.raw for r in got if r.source == f"s{k}"] for k in range(3)] == [lines[: k + 1] for k in range(3)]
    assert len({(r.source, r.line_no) for r in got}) == len(got)

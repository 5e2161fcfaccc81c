"""Configuration, inventories, digests, journals, adapter traces, views, commands."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill import cli
from tracemill.operators import views
from tracemill.sources import adapter, files

CASE = {"id": "a", "prompt": "p", "category": "c", "added_in": "1", "expected_skill": "s", "allowed_auxiliary": [], "multi_intent": [], "assertions": [], "safety_negative": False}


def test_jsonc_and_cases():
    assert files.parse_jsonc('{"a": "x // y", /* gone */ "b": [1, 2] // tail\n}') == {"a": "x // y", "b": [1, 2]}
    assert files.case_problems(CASE) == []
    assert files.case_problems({**CASE, "must_confirm_before": {"tools": ["x"]}}) == ["case a: must_confirm_before needs a scripted_reply"]
    assert "unclassified" in files.case_problems({**CASE, "zz": 1})[0] and "prompt" in files.case_problems({**CASE, "prompt": ""})[0]
    with pytest.raises(ValueError, match="duplicate"):
        files.load_suite(json.dumps({"cases": [CASE, CASE]}))
    assert files.load_suite('{"cases": []} // fine') == {"cases": []}
    assert files.parse_env("# x\nA=1\nexport B='two'\n\nbad") == {"A": "1", "B": "two"}


def test_probes(spark, tmp_path):
    good = {"tool": "w", "match": {"toolName": "Bash", "commandPattern": r"^w (\w+)"}}
    assert files.probe_problems(good) == []
    for bad in ({**good, "x": 1}, {"tool": "w", "match": {"toolName": "Bash"}}, {"tool": "w", "match": {"toolName": "a", "toolNamePattern": "b(c)"}}, {"tool": "", "match": good["match"]}, {"tool": "w", "match": {"toolNamePattern": "("}}, {"tool": "w", "match": {"toolNamePattern": "abc"}}):
        assert files.probe_problems(bad)
    (tmp_path / "b.json").write_text(json.dumps(good))
    (tmp_path / "a.json").write_text(json.dumps({"tool": "m", "match": {"toolNamePattern": "^mcp__m__(.+)$"}}))
    assert [p["tool"] for p in files.load_probes(spark, f"file://{tmp_path}")] == ["m", "w"]
    assert [p["tool"] for p in files.load_probes(spark, f"file://{tmp_path}", ["w"])] == ["w"]
    calls = spark.createDataFrame([("Bash", '{"command": "run w --x"}')], "name string, i string").select("name", F.parse_json("i").alias("input"))
    none = spark.createDataFrame([], "tool string")
    assert files.zero_match(calls, none, good) and not files.zero_match(calls, spark.createDataFrame([("w",)], "tool string"), good)


def test_inventory_and_digest(spark, tmp_path):
    s = tmp_path / "skills/sk"
    (s / "references/_shared").mkdir(parents=True)
    (s / "SKILL.md").write_text("skill")
    (s / "references/a.md").write_text("abcde")
    (s / "references/_shared/x.md").write_text("shared")
    got = {r.ref: (r.bytes, r.tokens_est, r.version_sha) for r in files.ref_inventory(spark, f"file://{tmp_path}/skills").collect()}
    v = hashlib.sha256(b"skill").hexdigest()
    assert got == {"sk/references/a.md": (5, 2, v), "sk/references/_shared/x.md": (None, None, v)}
    h = hashlib.sha256()
    for rel, text in (("SKILL.md", b"skill"), ("references/_shared/x.md", b"shared"), ("references/a.md", b"abcde")):
        h.update(rel.encode() + b"\0" + text)
    assert [tuple(r) for r in files.directory_digest(spark, f"file://{tmp_path}/skills").collect()] == [("sk", h.hexdigest()[:12])]


def test_journal(spark, tmp_path):
    rows = [{"header": True}, {"taskId": "t", "repeat": 0, "rep": {"C": 0}}, {"taskId": "t", "repeat": 0, "rep": {"C": 1}}, {"taskId": "t", "repeat": 1, "rep": {"C": 1}}]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"taskId": "t", "rep')
    assert sorted((r.task_id, r.repeat, r.rep) for r in files.journal(spark, f"file://{tmp_path}").collect()) == [("t", 0, '{"C":1}'), ("t", 1, '{"C":1}')]
    heads = spark.createDataFrame([("f1", "n", "m", None, "abc", 3), ("f2", "n", "m", "old", "abc", 3)], "source string, name string, model string, arm string, sha256 string, repeats int")
    assert [tuple(r) for r in files.find_journal(heads, "n", "m", 3, "abc").collect()] == [("f1", "resume", None)]
    assert [tuple(r) for r in files.find_journal(heads, "n", "m", 5, "abc", "old").collect()] == [("f2", "drift", "repeats")]
    df = spark.range(1)
    files.write_once(df, f"file://{tmp_path}/once")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_once(df, f"file://{tmp_path}/once")


def test_adapter_traces(spark):
    trace = [{"text": "hi", "usage": {"in": 5, "cacheR": 2}, "triggers": ["s", 3], "refReads": [{"skill": "s", "ref": "s/references/a", "status": "odd"}], "stopReason": "max_tokens", "toolCalls": [{"name": "X", "isError": True, "kind": "mcp"}, {}]}, {"skill": "q", "triggers": []}, {"usage": None}]
    out = spark.createDataFrame([("a", json.dumps({"trace": trace, "runtime_info": {"name": "rt", "systemPromptText": "abcd"}})), ("b", "broken")], "id string, raw string")
    r = adapter.rounds(out).orderBy("seq").collect()
    assert [(x.seq, x.u_in, x.u_out, x.footprint, x.stop_reason, x.declared_stop_reason) for x in r] == [(1, 5, 0, 7, None, "max_tokens"), (2, None, None, None, None, None), (3, None, None, None, None, None)]
    assert [x.declared_triggers for x in r] == [["s"], [], None] and r[0].declared_ref_reads[0].status == "ok"
    assert [(c.name, c.is_error, c.declared_kind) for c in adapter.tool_calls(out).orderBy("pos").collect()] == [("X", True, "mcp"), ("tool", False, None)]
    assert sorted((e.kind, e.skill, e.round_seq) for e in adapter.declared_events(adapter.rounds(out)).collect()) == [("read", "s", 1), ("trigger", "q", 2), ("trigger", "s", 1)]
    f = {x.id: x for x in adapter.runtime_fingerprint(out).collect()}["a"]
    assert (f.name, f.prompt_sha256, f.prompt_bytes, f.prompt_tokens, f.self_reported) == ("rt", hashlib.sha256(b"abcd").hexdigest(), 4, 1, False)


def test_views(spark):
    t = spark.createDataFrame([("good", 0.95, 1.0, False), ("bad", 0.1, 0.0, False), ("mid", 0.5, 0.5, False), ("none", None, None, False), ("held", 1.0, 1.0, True)], "task_id string, composite double, C double, held_out boolean")
    assert [(r.task_id, r.hue, r.verdict) for r in views.question_list(t).collect()] == [("bad", 0, "fail"), ("mid", 60, "partial"), ("good", 114, "pass"), ("none", None, "na")]
    v = spark.createDataFrame([("cost-opt", True, 9), ("neutral-refactor", False, 9), ("inconclusive", False, 9), ("insufficient-data", False, 7)], "verdict string, established boolean, pairs int")
    assert [(r.glyph, r.adoptable, r.recommended, r.need_pairs) for r in views.verdict_view(v).collect()] == [("✓", True, True, None), ("✗", False, False, None), ("~", False, None, None), ("∅", False, None, 1)]
    d = spark.createDataFrame([(x,) for x in (0.5, -0.2, 0.0, 0.1, None, -3.0)], "delta double")
    assert tuple(views.delta_tally(d, []).first()) == (2, 2, 1)
    n = spark.createDataFrame([(0.0, 0.3, 0.5, 0.9, "a"), (0.1, 0.5, 0.5, 0.9, "b"), (None, 0.3, 0.5, 0.9, "c")], "lo_a double, hi_a double, lo_b double, hi_b double, k string")
    assert {r.k: r.within_noise for r in views.within_noise(n, ["k"]).collect()} == {"a": False, "b": True, "c": True}
    s = spark.createDataFrame([("ok", "ok", False, 0.4), ("ref", "reference-only", False, 0.1), ("bad", "ok", True, -1.2)], "skill string, badge string, significant boolean, mean double")
    assert [(r.skill, r.flag) for r in views.red_list(s).collect()] == [("bad", "regressed"), ("ref", "low-confidence")]
    rep = spark.createDataFrame([(1, "s", "m", 1, "ok", 0.5, 0.5, None), (2, "s", "m", 2, "bad", 0.6, 0.5, None)], "id int, suite string, model string, created_at int, verdict string, l1_rate double, l2_rate double, l3_rate double")
    got = {r.id: (r.prev_id, r.prev_verdict, r.l1_delta_pp) for r in views.report_diff(rep).collect()}
    assert got == {1: (None, None, None), 2: (1, "ok", 10.0)}
    assert json.loads(views.report_json(rep, ["suite"]).filter("id = 1").first().report)["suite"] == "s"
    a = spark.createDataFrame([(1, "x", "m", "r")], "pair int, suite string, model string, runtime string")
    b = spark.createDataFrame([(1, "y", "m", "q")], "pair int, suite string, model string, runtime string")
    assert tuple(views.comparable(a, b).first()) == (1, False, ["suite", "runtime"])
    runs = spark.createDataFrame([(0,), (10,)], "ts_ms long")
    assert views.prune_hint(runs, 91 * 86_400_000).first().by_age and views.prune_hint(runs, 86_400_000).count() == 0


def test_cli(spark, tmp_path):
    line = {"type": "assistant", "requestId": "q", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"model": "opus", "content": [{"type": "tool_use", "id": "t", "name": "Skill", "input": {"skill": "sk"}}], "usage": {"input_tokens": 1000}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r1.jsonl").write_text(json.dumps(line))
    at = f"file://{tmp_path}/in"
    for _ in range(2):
        cli.ingest(spark, at, f"file://{tmp_path}/out")
    assert [(r.run_id, r.cost_usd) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("r1", 0.015)]
    assert [(r.skill, r.runs) for r in cli.skill(spark, at).collect()] == [("sk", 1)]
    assert cli.search(spark, at, "opus").count() == 1
    assert cli.prune(spark, at, 1_800_000_000_000, "30d", None).count() == 1
    cli.export(spark, at, f"file://{tmp_path}/otlp")

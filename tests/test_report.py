"""Comparison of two arms from files to a report, statistics of logs, and findings of a suite, through the commands."""

import json

from tracemill import cli
from tracemill.operators import report


def arm(path, passed, tokens, n=12):
    rows = [{"case_id": f"c{k}", "excluded": False, "C": int(passed(k)), "l1_pass": passed(k), "flow_status": "complete", "u_in": tokens, "u_out": 10, "u_cache_r": 0, "u_cache_w": 0} for k in range(n) for _ in range(2)]
    rows.append({"case_id": "held", "held_out": True, "C": 0, "l1_pass": False, "u_in": 1})
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_compare_and_report(spark, tmp_path):
    old = arm(tmp_path / "old.json", lambda k: True, 1000)
    same, worse = arm(tmp_path / "same.json", lambda k: True, 500), arm(tmp_path / "worse.json", lambda k: k % 3 != 0, 500)
    r = cli.comparison(spark, old, same, "cost-opt").first()
    assert (r.verdict, r.established, r.pairs, r.any_cost_down, r.l1_mean, r.cost_mean, r.causes) == ("cost-opt", True, 12, True, 0.0, -500.0, None)
    assert r.line == "✓ recommended: true · intent: cost-opt · n=12 pairs · excluded 0.0%"
    r = cli.comparison(spark, old, worse, "cost-opt").first()
    assert not r.established and [c.what for c in r.causes] == ["l1-quality", "l2-quality"] and r.l1_low < -30
    few = arm(tmp_path / "few.json", lambda k: True, 500, 3)
    assert cli.comparison(spark, old, few, "cost-opt").first().verdict == "insufficient-data"
    cli.main(["report", old, worse, "--intent", "cost-opt", "--out", f"{tmp_path}/out"])
    text = spark.read.text(f"{tmp_path}/out").first().value
    assert list(json.loads(text))[:2] == ["id", "verdict"] and json.loads(text)["footer"]


def test_stats_of_logs(spark, tmp_path):
    line = {"type": "assistant", "requestId": "q", "timestamp": "2026-01-01T00:00:00Z", "message": {"stop_reason": "max_tokens", "usage": {"input_tokens": 5, "cache_read_input_tokens": 5}, "content": [{"type": "tool_use", "id": "a", "name": "Read", "input": {}}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({"type": "result", "total_cost_usd": 0.5, "num_turns": 1}))
    found = cli.stats(spark, str(tmp_path), f"{tmp_path}/stats")
    assert [(r.kind, r.total) for r in found["tools"].orderBy("position").collect()] == [("skill", 0), ("agent", 0), ("mcp", 0), ("builtin", 1), ("other", 0)]
    assert found["cache"].first().mean == 0.5 and found["truncation"].first().truncated_share == 1.0 and found["self_reports"].first().total_cost_usd == 0.5
    assert spark.read.json(f"{tmp_path}/stats/top_tools").first().name == "Read"


def test_stats_of_files_and_skills(spark, tmp_path):
    use = lambda i, name, **inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    line = {"type": "assistant", "requestId": "q", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": [use("a", "Skill", skill="sk"), use("b", "Read", file_path="/p/skills/sk/references/a.md"), use("c", "Write", file_path="/w/x")]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line))
    (tmp_path / "b.jsonl").write_text(json.dumps({"type": "user", "cwd": "/w"}))
    found = cli.stats(spark, str(tmp_path))
    assert {(r.op, r.skillRefs, r.workspace) for r in found["files"].collect()} == {("read", 1, 0), ("write", 0, 1)}
    assert [(r.skill, r.runs, r.primary_runs, r.rate) for r in found["skills"].collect()] == [("sk", 1, 1, 0.5)]
    assert [(r.logical_ref, r.rate) for r in found["references"].collect()] == [("sk/references/a.md", 0.5)]


def test_adapter_check_and_preflight(spark, tmp_path):
    (tmp_path / "out.jsonl").write_text('{"result": "x", "trace": [{"usage": {"in": 1}}]}\n{"reslt": 1}\nnot json\n')
    found = {tuple(r) for r in cli.adapter_check(spark, f"{tmp_path}/out.jsonl").collect()}
    assert {("output", "ok", "1 of 3"), ("channel", "usage", "1 of 3"), ("channel", "refReads", "0 of 3"), ("near-miss", "reslt", "result")} <= found
    for side, cases in (("old", ("a", "b")), ("new", ("b", "c"))):
        (tmp_path / f"{side}.jsonl").write_text("\n".join(json.dumps({"case_id": c, "excluded": False, "C": 1}) for c in cases))
    assert {tuple(r) for r in cli.preflight(spark, f"{tmp_path}/old.jsonl", f"{tmp_path}/new.jsonl").collect()} == {("pairs", "cases in both arms", "1"), ("only in one arm", "a", "old"), ("only in one arm", "c", "new")}


def test_lint(spark, tmp_path):
    (tmp_path / "suite.json").write_text('{"cases": [{"id": "a", "prompt": "p", "category": "c", "added_in": "1", "expected_skill": "s", "allowed_auxiliary": ["s"], "multi_intent": [], "assertions": [], "safety_negative": false, "superseded_by": "gone"}, {"id": "a"}] /* two */}')
    found = {(r.check, r.subject) for r in cli.lint(spark, f"{tmp_path}/suite.json").collect()}
    assert found >= {("duplicate-id", "a"), ("dangling-superseded", "a"), ("skill-coverage", "s"), ("redundant-auxiliary", "a"), ("smoke-tier-size", "suite"), ("case", "a")}


def test_differences_leave_excluded_cases_out(spark):
    from tracemill.operators import compare

    rows = [("a", False, 1), ("b", True, 1), ("b", False, 0)]
    make = lambda x: compare.experiment_arm(spark.createDataFrame([(c, None, e, p, p == 1, None, None, 5, 1, 0, 0) for c, e, p in x], "case_id string, held_out boolean, excluded boolean, C int, l1_pass boolean, l3_pass boolean, flow_status string, u_in long, u_out long, u_cache_r long, u_cache_w long"))
    got = {(r.axis, r.case_id): r.delta for r in report.differences(make(rows), make([("a", False, 0), ("b", True, 0)])).collect()}
    assert got == {("l1", "a"): -100.0, ("l2", "a"): -100.0, ("cost", "a"): 0.0}

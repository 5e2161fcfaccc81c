"""Assembled results: repeats, graph reports, session events, metadata, change feeds."""

import json

import pytest

from tracemill.operators import compare, graph, lint
from tracemill.streaming import tail


def test_repeats(spark):
    schema = "rep_id int, tool_calls int, tool_errors int, max_turns int, n_rounds int, activated boolean, peak int, first_fp int, last_fp int, n_fp int, context_limit int"
    runs = spark.createDataFrame([(1, 4, 1, 0, 3, True, 50000, 10000, 50000, 3, 200000), (2, 0, 0, 2, 2, None, 0, None, None, 0, 200000)], schema)
    results = spark.createDataFrame([(1, "deterministic", True)], "rep_id int, cls string, passed boolean")
    routing = spark.createDataFrame([(1, "correct"), (2, "permission-artifact")], "rep_id int, routing string")
    safety = spark.createDataFrame([(1, "executed-after-confirm")], "rep_id int, verdict string")
    a, b = compare.build_repeats(runs, results, routing, safety).orderBy("rep_id").collect()
    assert (a.C, a.P, a.H, a.l1_pass, a.l3_pass, a.passed) == (1, 0.917, 0.775, True, True, True)
    assert (b.C, b.P, b.H, b.l1_pass, b.l3_pass, b.passed) == (0, 0.5, None, None, None, False)


def test_session_events_and_report(spark):
    o = spark.createDataFrame([("s", "b", 1, 0), ("s", "a", 2, 3), ("s", "b", 2, 4)], "session string, skill string, round int, ordinal long")
    d = spark.createDataFrame([("s", "c", 1), ("s", "a", 1), ("s", "", 1)], "session string, skill string, round int")
    assert [(r.skill, r.first_ordinal) for r in graph.session_events(o, d).orderBy("rank").collect()] == [("b", 0), ("a", 3), ("c", None)]
    ses = spark.createDataFrame([(k, "x" if k < 5 else "y", "harness-observed" if k else None) for k in range(10)], "session int, category string, provenance string")
    trig = spark.createDataFrame([(k, s) for k in range(10) for s in ("p", "q")], "session int, skill string")
    reads = spark.createDataFrame([(k, "p", f"p/{'a' if k < 5 else 'b'}") for k in range(10)], "session int, skill string, ref string")
    r = graph.report(ses, trig, reads, full=True)
    assert tuple(r["provenance"].first()) == (9, 0, 1)
    assert [x.members for x in r["merge"].collect()] == [["p", "q"]]
    assert {x.skill: x.status for x in r["split"].collect()} == {"p": "split-candidate", "q": "no-split"}
    assert graph.heat_map(spark.createDataFrame([("a", "b", 0.9)], "a string, b string, rate double")).count() == 2


def test_arms(spark):
    reps = spark.createDataFrame([("old", 3_600_000, None, 0.5, None), ("old", None, 3_600_000, None, 0.25), ("new", None, None, None, None)], "arm string, duration_ms long, wall_ms long, cost_usd double, cost_usd_reported double")
    assert {r.arm: (r.sessions, r.hours, r.usd) for r in compare.budget_spent(reps, ["arm"]).collect()} == {"old": (2, 2.0, 0.75), "new": (1, None, None)}
    arms = spark.createDataFrame([("old", "1", "m", None, True, "s", "ab"), ("new", "2", "m", None, None, None, None)], "arm string, cli_version string, model string, harness_version string, isolation_verified boolean, name string, sha256 string")
    assert {r.arm: [tuple(s) for s in r.skills] for r in compare.version_quads(arms).collect()} == {"old": [("s", "ab")], "new": []}
    own = spark.createDataFrame([("old", "s")], "arm string, name string")
    assert compare.arms_isolated(own, own).count() == 0 and compare.arms_isolated(own, spark.createDataFrame([("old", "z")], "arm string, name string")).count() == 1
    hits = compare.probe_hits(spark.createDataFrame([("old", "w", "send"), ("old", "w", "send")], "arm string, tool string, cmd string"), 12.5).first()
    assert hits.cmds == ["send"] and hits.tripwired


def test_meta(spark):
    raw = json.dumps({"result": "x", "trace": [{"usge": 1, "toolCalls": [{"name": "a"}]}]})
    keys = {(r.level, r.key) for r in lint.adapter_keys(spark.createDataFrame([(raw,), ("bad",)], "raw string")).collect()}
    assert keys == {("top", "result"), ("top", "trace"), ("round", "usge"), ("round", "toolCalls"), ("toolCall", "name")}
    assert lint.resolve_meta(("defaults", {"a": 1, "b": 2}), ("cli", {"a": 3})) == {"a": {"value": 3, "source": "cli"}, "b": {"value": 2, "source": "defaults"}}
    with pytest.raises(ValueError):
        lint.resolve_meta(("cli", {"bad key": 1}))
    assert lint.resolve_variables("{{ A }} {{PROMPT}}", {"A": "x"}) == "x {{PROMPT}}"
    with pytest.raises(ValueError, match="unresolved"):
        lint.resolve_variables("{{B}}", {})


def test_change_feed(spark):
    a = spark.createDataFrame([("r1", 1), ("r2", 1)], "id string, t int")
    b = spark.createDataFrame([("r1", 2), ("r3", 1)], "id string, t int")
    assert tail.changes(a, a, "id", "t").count() == 0
    assert {(r.id, r.change) for r in tail.changes(a, b, "id", "t").collect()} == {("r1", "changed"), ("r2", "removed"), ("r3", "added")}

"""Small facts of cards, probe blocks, sources and sinks, and the change feed."""

import json
import time

import pytest

from tracemill.operators import cards, compare, grading, views
from tracemill.sources import files
from tracemill.streaming import tail


def test_cards_of_nothing(spark):
    none = spark.createDataFrame([], "id string, skill string")
    status = spark.createDataFrame([], "id string, skill string, status string")
    assert cards.skill_card(none, none, status).count() == 0
    e = spark.createDataFrame([("a", "none-backfill", "no-inventory-snapshot", True), ("b", "external-runtime", "external-runtime-self-managed", False), ("c", "snapshot", None, True)], "id string, status string, reason string, known boolean")
    rows = spark.createDataFrame([], "id string, shipped long, read long, unread long")
    shared = spark.createDataFrame([("a", "_shared/a#1"), ("a", "_shared/b#2")], "id string, ref string")
    got = {r.id: tuple(r)[1:] for r in cards.ref_card(e, rows, shared).collect()}
    assert got == {"a": (False, "no-inventory-snapshot", None, 2, 0, 2), "b": (True, "external-runtime-self-managed", None, None, None, None), "c": (False, None, 0, 0, 0, 0)}


def test_edge_charts(spark):
    edges = spark.createDataFrame([("cli", "a", "cli", "b", 0.5, 1.0, 1.4), ("skill", "s", "cli", "a", 0.2, 0.8, None)], "from_type string, from_id string, to_type string, to_id string, closeness double, confidence double, lift double")
    charts = cards.edge_charts(edges)
    assert charts["nodes"].count() == 3 and charts["cells"].count() == 2 and charts["links"].first().confidence == 1.0
    assert cards.top_edges(edges, 1).first().from_id == "a"


def test_arms_that_are_not_compared():
    compare.check_arms({"resume_key": "x", "identity": None}, {"resume_key": "y", "identity": None})
    with pytest.raises(ValueError, match="journal"):
        compare.check_arms({"resume_key": "x"}, {"resume_key": "x"})
    with pytest.raises(ValueError, match="build"):
        compare.check_arms({"identity": "i"}, {"identity": "i"})
    compare.assert_frozen()


def test_causes_and_types(spark):
    schema = "verdict string, established boolean, l1_low double, l2_low double, l3_low double, any_cost_up boolean, flow_regressed boolean, any_quality_up boolean"
    rows = [("cost-opt", False, -27.3, -6.0, None, True, None, None), ("cost-opt", True, -27.3, None, None, None, None, None), ("inconclusive", False, -27.3, None, None, None, None, None)]
    got = [r.causes for r in views.failure_causes(spark.createDataFrame(rows, schema)).collect()]
    assert [(c.what, c.by) for c in got[0]] == [("l1-quality", -27.3), ("l2-quality", -6.0), ("cost-up", None)] and got[1:] == [None, None]
    v = grading.checked_types(spark.createDataFrame([(None, True, "x"), ("judge", None, "x")], "type string, passed boolean, detail string")).collect()
    assert [(r.cls, r.passed, r.detail) for r in v] == [("deterministic", False, "unknown verifier type null"), ("judged", False, "x")]


def test_settings_runs_and_sinks(spark, tmp_path):
    assert files.load_settings(spark, f"file://{tmp_path}/none.json") == {} and files.parse_settings("[1]") == {} and files.parse_settings("{broken") == {}
    (tmp_path / "s.json").write_text('{"model": "m"}')
    assert files.load_settings(spark, f"file://{tmp_path}/s.json") == {"model": "m"}
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    runs.write.partitionBy("run_id").parquet(f"{tmp_path}/runs")
    one = files.load_runs(spark, f"{tmp_path}/runs", ["b", "z"])
    assert [tuple(r) for r in one.select("run_id", "n").collect()] == [("b", 2)] and len(one.inputFiles()) == 2
    assert "PartitionFilters: [run_id" in one._jdf.queryExecution().executedPlan().toString()
    report = spark.createDataFrame([("x", '{"verdict": "ok"}')], "id string, report string")
    files.write_report(report, f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first().value) == {"verdict": "ok"}
    with pytest.raises(Exception, match="already exists"):
        files.write_report(report, f"{tmp_path}/report")
    for _ in range(2):
        files.write_sidecar(report, f"{tmp_path}/side")


def test_change_feed_primes_and_then_follows(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "old.jsonl").write_text('{"sessionId": "s-old"}\n')
    seen = []
    q = tail.change_feed(spark, str(src), lambda df, _: seen.extend(r.run_id for r in df.collect()), f"{tmp_path}/ck", "200 milliseconds")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not (q.lastProgress and q.isActive):
            time.sleep(0.2)
        (src / "new.jsonl").write_text("no json here\n")
        with (src / "old.jsonl").open("a") as f:
            f.write("{}\n")
        while time.time() < deadline and len(set(seen)) < 2:
            time.sleep(0.2)
    finally:
        q.stop()
    assert set(seen) == {"new", "s-old"}


def test_offset_does_not_grow(tmp_path):
    import os

    for k in range(50):
        (tmp_path / f"{k}.jsonl").write_text("x")
        time.sleep(0.005)
    reader = tail.TailReader(str(tmp_path))
    first = reader.latestOffset()
    assert len(json.loads(first["files"])) < 20 and len(reader.partitions(reader.initialOffset(), first)) == 50
    assert reader.partitions(first, reader.latestOffset()) == []
    time.sleep(0.02)
    (tmp_path / "a.jsonl").write_text("old content, as its time says")
    os.utime(tmp_path / "a.jsonl", (1, 1))  # a copy that keeps an old time of writing
    assert [os.path.basename(p.path) for p in reader.partitions(first, reader.latestOffset())] == ["a.jsonl"]

"""Scans in segments against windows over whole groups."""

import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.test_logs import LINES, T, back, said, use
from tracemill.functions import scan
from tracemill.operators import proximity
from tracemill.sources import logs


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_ordered_equals_whole_windows(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, 1, 2, 3])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, v int").repartition(5)
    w = W.partitionBy("g").orderBy("o")
    want = df.select("*", F.row_number().over(w).alias("n"), F.lead("v").over(w).alias("next"), F.lag("v").over(w).alias("prev"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"))
    got = scan.ordered(df, ["g"], ["o"], scan.segment_of(F.col("o"), bits), number="n", after={"next": "v"}, before={"prev": "v"}, sums={"total": "v"})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def long_log(n):
    """A log of many rounds with boundaries, side chains, calls whose results come much later, and requests that interleave."""
    rng = random.Random(3)
    out = [LINES[0]]
    for k in range(n):
        side = rng.random() < 0.2
        out.append(said(f"q{k // 2 if side else k}", T % (k % 60), [{"type": "text", "text": f"x{k}"}, use(f"t{k}", rng.choice(["Bash", "Skill", "Read"]), command="ls", skill=f"s{k % 3}")], side=side, usage={"input_tokens": k, "output_tokens": 1}, **({"agentId": f"ag{k % 2}"} if side else {})))
        if rng.random() < 0.1:
            out.append({"type": "compact-boundary", "timestamp": T % 4, "isSidechain": rng.random() < 0.3})
        if rng.random() < 0.7:
            out.append(back(T % 6, {"type": "tool_result", "tool_use_id": f"t{max(0, k - rng.randrange(40))}", "is_error": k % 3 == 0, "content": f"r{k}"}))
    return "\n".join(map(json.dumps, out))


def test_a_log_parses_alike_in_any_segments(spark, monkeypatch):
    frame = spark.createDataFrame([("long", long_log(300)), ("one", "\n".join(map(json.dumps, LINES)))], "source string, value string")
    found = []
    for bits in (40, 3):
        monkeypatch.setattr(scan, "BITS", bits)
        p = logs.parse(logs.lines_of(frame))
        found.append({n: sorted(str(r.asDict(True)) for r in getattr(p, n).withColumns({c: F.to_json(c) for c, k in getattr(p, n).dtypes if k == "variant"}).collect()) for n in ("runs", "rounds", "tool_calls", "user_events", "compactions")})
    assert found[0] == found[1] and len(found[0]["rounds"]) > 200


def test_no_window_of_the_parse_holds_a_file(spark):
    """Windows are over a request or a call, over segments, or over one row a segment."""
    p = logs.parse(logs.lines_of(spark.createDataFrame([("a", "{}")], "source string, value string")))
    for table in (p.rounds, p.tool_calls, p.user_events, p.runs):
        for line in table._jdf.queryExecution().optimizedPlan().toString().split("\n"):
            if "Window [" in line:
                keys = line.rsplit("], [", 2)[1] if line.count("], [") >= 2 else line
                assert any(k in line for k in ("_seg", "key#", "call_id#", "round_id#")), keys


def test_loops_of_a_long_run_are_folded_without_gathering_it(spark):
    """Many calls of one tool with long inputs that begin alike; the islands come out, and no list of inputs is in the plan."""
    long = "x" * 2000
    rows = [("r", k, "Bash", long + ("a" if k < 3000 else f"b{k // 5}"), k % 11 == 0) for k in range(4000)] + [("s", k, "Bash", "", False) for k in range(6)] + [("r2", 1, "Bash", None, None)]
    df = spark.createDataFrame(rows, "run_id string, ord long, tool string, input string, is_error boolean").repartition(6)
    found = proximity.loops(df)
    got = {(r.run_id, r.type, r.tool, r.first_ord, r["count"]) for r in found.collect()}
    want = {("r", "identical-input", "Bash", 0, 3000), ("s", "identical-input", "Bash", 0, 6)} | {("r", "identical-input", "Bash", k, 5) for k in range(3000, 4000, 5)}
    assert got == want
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()

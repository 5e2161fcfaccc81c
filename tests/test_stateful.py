"""Streams with state against the batch, for any cut into batches."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_scan import long_log
from tracemill.sources import logs
from tracemill.streaming import stateful, tail


def in_batches(spark, tmp_path, rows, schema, cuts, make, name):
    """All rows that a query gave, its input coming in files of the given cuts."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        out = f"{tmp_path}/out"
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, k=k: df.write.parquet(f"{out}/{k}-{n}")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(200)
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


@pytest.mark.parametrize("seed", [1])
def test_rounds_in_any_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [(s, k, x) for s, n in (("a", 60), ("b", 25)) for k, x in enumerate(long_log(n).split("\n"))]
    rng.shuffle(lines)
    lines = sorted(lines, key=lambda r: r[1])  # files grow side by side
    # requests that come in several segments, the last usage of which counts
    more = [(s, 1000 + k, json.dumps({"type": "assistant", "requestId": f"m{k // 3}", "timestamp": "2026-01-01T00:01:00.000Z", "message": {"model": "m", "content": [{"type": "text", "text": f"p{k}"}], "usage": {"input_tokens": k} if k % 3 < 2 else None, "stop_reason": "end" if k % 3 == 1 else None}})) for k in range(9) for s in ("a", "b")]
    lines += more
    schema = "source string, line_no long, raw string"
    cuts = sorted(rng.sample(range(1, len(lines)), 2))
    updates = in_batches(spark, tmp_path, lines, schema, cuts, stateful.rounds, "r")
    pick = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
    want = logs.parse(spark.createDataFrame(lines, schema)).rounds
    common = ["round_id", "ts", "model", "attribution_skill", "stop_reason", "text", "thinking"]
    got = stateful.latest_rounds(updates)
    assert pick(got, F.col("source").alias("run_id"), *common, *(f"u_{n}" for n in ("in", "out", "cache_w", "cache_r"))) == pick(want, "run_id", *common, *(F.col(f"usage.{n}").alias(f"u_{n}") for n in ("in", "out", "cache_w", "cache_r")))


def test_steps_in_any_batches(spark, tmp_path):
    rng = random.Random(9)
    events = [(rng.choice(["s", "t", None]), k, rng.choice(["text", "tool", "turn_usage"])) for k in range(120)]
    schema = "session string, at long, type string"
    got = in_batches(spark, tmp_path, events, schema, [17, 60], lambda df: stateful.steps(df, "session", "at", "turn_usage"), "s")
    batch = tail.close_steps(spark.createDataFrame(events, schema), "session", "at", "turn_usage")
    want = batch.groupBy("session", "step").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"), F.max((F.col("type") == "turn_usage").cast("int")).alias("c")).filter("c = 1").drop("c")
    assert sorted(map(str, got.filter("closed").select("session", "step", "first_at", "last_at", "events").collect())) == sorted(map(str, want.collect()))


def test_an_idle_step_goes_out_open(spark, tmp_path):
    schema = "session string, at long, type string"
    spark.createDataFrame([("s", 1, "text"), ("s", 2, "turn_usage"), ("s", 3, "text")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.steps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "session", "at", "turn_usage", idle="1 second")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").start()
    rows = set()
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.exists(f"{tmp_path}/out/_SUCCESS"):
                rows = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
            if len(rows) == 2:
                break
    finally:
        q.stop()
    assert rows == {("s", 0, 1, 2, 2, True), ("s", 1, 3, 3, 1, False)}

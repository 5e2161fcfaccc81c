"""Trace export: runs, rounds and calls as OTLP/JSON spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attributes(pairs: list[tuple[str, Column, str]]) -> Column:
    """array<struct<key, value>>: typed values; null and empty ones are left out."""
    made = []
    for key, value, kind in pairs:
        text = F.to_json(F.struct(value.cast("string" if kind in ("stringValue", "intValue") else value_type(kind)).alias(kind)))
        present = value.isNotNull() & (value.cast("string") != "")
        made.append(F.when(present, F.struct(F.lit(key).alias("key"), text.alias("value"))))
    return F.array_compact(F.array(*made))


def value_type(kind: str) -> str:
    return {"doubleValue": "double", "boolValue": "boolean"}[kind]


def trace_id(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 32)


def span_id(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 16)


def nanos(ms: Column) -> Column:
    return (ms.cast("long") * 1_000_000).cast("string")


def run_spans(runs: DataFrame, rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_span_id, name, start_ns, end_ns, attributes): one row per run, round and call.

    runs: run_id, model, start_ms, end_ms; rounds: run_id, agent_id (null on the main chain), seq, start_ms,
    duration_ms, model, u_in, u_out, stop_reason; calls: run_id, agent_id, round_seq, call_id, name, is_error.  Ids are digests, so exports repeat.
    """
    key = lambda *parts: F.concat(F.lit("run:"), F.col("run_id"), *parts)
    root = span_id(key(F.lit(":root")))
    chat = lambda seq: span_id(key(F.lit(":r"), F.col(seq).cast("string")))
    trace = trace_id(key())
    agent = runs.select(
        trace.alias("trace_id"), root.alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("invoke_agent").alias("name"), nanos(F.col("start_ms")).alias("start_ns"), nanos(F.col("end_ms")).alias("end_ns"),
        attributes([("gen_ai.operation.name", F.lit("invoke_agent"), "stringValue"), ("gen_ai.request.model", F.col("model"), "stringValue")]).alias("attributes"),
    )
    turn = rounds.select(
        trace.alias("trace_id"), chat("seq").alias("span_id"), root.alias("parent_span_id"), F.lit("chat").alias("name"), nanos(F.col("start_ms")).alias("start_ns"), nanos(F.col("start_ms") + F.col("duration_ms")).alias("end_ns"),
        attributes([
            ("gen_ai.operation.name", F.lit("chat"), "stringValue"), ("gen_ai.request.model", F.col("model"), "stringValue"), ("gen_ai.usage.input_tokens", F.col("u_in"), "intValue"),
            ("gen_ai.usage.output_tokens", F.col("u_out"), "intValue"), ("gen_ai.response.finish_reason", F.col("stop_reason"), "stringValue"),
        ]).alias("attributes"),
    )
    when = rounds.select("run_id", F.coalesce("agent_id", F.lit("")).alias("agent"), F.col("seq").alias("round_seq"), "start_ms", "duration_ms")
    tool = calls.withColumn("agent", F.coalesce("agent_id", F.lit(""))).join(when, ["run_id", "agent", "round_seq"]).select(
        trace.alias("trace_id"), span_id(key(F.lit(":r"), F.col("round_seq").cast("string"), F.lit(":"), F.coalesce("call_id", "name"))).alias("span_id"), chat("round_seq").alias("parent_span_id"), F.lit("execute_tool").alias("name"),
        nanos(F.col("start_ms")).alias("start_ns"), nanos(F.col("start_ms") + F.col("duration_ms")).alias("end_ns"),
        attributes([("gen_ai.operation.name", F.lit("execute_tool"), "stringValue"), ("gen_ai.tool.name", F.col("name"), "stringValue"), ("tool.is_error", F.col("is_error"), "boolValue")]).alias("attributes"),
    )
    return agent.unionByName(turn).unionByName(tool)


def write_otlp(spans: DataFrame, path: str, service: str = "tracemill") -> None:
    """One JSON line per trace, each a document with its resource and spans; never over an existing path."""
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.col("start_ns").alias("startTimeUnixNano"), F.col("end_ns").alias("endTimeUnixNano"), "attributes")
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    docs = spans.groupBy("trace_id").agg(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.collect_list(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
    docs.select("value").write.mode("errorifexists").text(path)

"""Traces that an adapter reports, in the tables that parsed logs have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.num import tokens_est_cjk, utf16_len


def _get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def steps(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """(id, seq, step) of adapter outputs (id, raw JSON)."""
    trace = F.coalesce(_get(F.try_parse_json(raw), "$.trace", "array<variant>"), F.array().cast("array<variant>"))
    return outputs.select("id", F.posexplode(trace).alias("pos", "step")).select("id", (F.col("pos") + 1).alias("seq"), "step")


def rounds(outputs: DataFrame) -> DataFrame:
    """Rounds of reported traces.  Usage that isn't reported stays null, and so does the footprint; the reported stop
    reason has a column of its own, as graders of safety must not see it; absent and empty triggers differ."""
    s = F.col("step")
    usage = _get(s, "$.usage", "variant")
    has = usage.isNotNull() & ~F.is_variant_null(usage)
    n = lambda k: F.when(has, F.coalesce(_get(usage, f"$.{k}", "long"), F.lit(0)))
    text = F.coalesce(_get(s, "$.text"), F.lit(""))
    reads = F.transform(
        F.filter(_get(s, "$.refReads", "array<variant>"), lambda r: F.schema_of_variant(r).startswith("OBJECT")),
        lambda r: F.struct(_get(r, "$.skill").alias("skill"), _get(r, "$.ref").alias("ref"), F.when(_get(r, "$.status") == "blocked", "blocked").otherwise("ok").alias("status")),
    )
    out = steps(outputs).select(
        F.col("id").alias("run_id"), "seq", _get(s, "$.ts").alias("ts"), F.coalesce(_get(s, "$.durationMs", "long"), F.lit(0)).alias("duration_ms"), _get(s, "$.model").alias("model"), _get(s, "$.skill").alias("attribution_skill"),
        *(n(k).alias(f"u_{c}") for k, c in (("in", "in"), ("out", "out"), ("cacheW", "cache_w"), ("cacheR", "cache_r"))),
        F.lit(None).cast("string").alias("stop_reason"), _get(s, "$.stopReason").alias("declared_stop_reason"), text.alias("text"), utf16_len(text).alias("text_chars"),
        F.filter(F.transform(_get(s, "$.triggers", "array<variant>"), lambda t: F.when(F.schema_of_variant(t) == "STRING", _get(t, "$"))), lambda t: t.isNotNull()).alias("declared_triggers"), reads.alias("declared_ref_reads"),
    )
    return out.withColumn("footprint", F.col("u_in") + F.col("u_cache_r") + F.col("u_cache_w"))


def tool_calls(outputs: DataFrame) -> DataFrame:
    c = steps(outputs).select("id", "seq", F.posexplode(F.coalesce(_get(F.col("step"), "$.toolCalls", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "c"))
    t = F.col("c")
    return c.select(
        F.col("id").alias("run_id"), F.col("seq").alias("round_seq"), "pos", F.coalesce(_get(t, "$.name"), F.lit("tool")).alias("name"), _get(t, "$.id").alias("call_id"), F.coalesce(_get(t, "$.isError", "boolean"), F.lit(False)).alias("is_error"),
        _get(t, "$.skill").alias("skill"), _get(t, "$.input", "variant").alias("input"), _get(t, "$.result").alias("result"), _get(t, "$.denialKind").alias("denial_kind"), _get(t, "$.kind").alias("declared_kind"),
    )


def declared_events(r: DataFrame) -> DataFrame:
    """What traces declare: (run_id, round_seq, kind, skill, ref, status); declared facts come after observed ones."""
    t = r.select("run_id", "seq", F.explode("declared_triggers").alias("skill")).select("run_id", F.col("seq").alias("round_seq"), F.lit("trigger").alias("kind"), "skill", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("status"))
    a = r.filter("attribution_skill is not null").select("run_id", F.col("seq").alias("round_seq"), F.lit("trigger").alias("kind"), F.col("attribution_skill").alias("skill"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("status"))
    d = r.select("run_id", "seq", F.explode("declared_ref_reads").alias("x")).select("run_id", F.col("seq").alias("round_seq"), F.lit("read").alias("kind"), "x.skill", "x.ref", "x.status")
    return t.unionByName(a).unionByName(d)


def runtime_fingerprint(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Name, version and system prompt of the runtime: digest, bytes and tokens of the text, or what was reported of it."""
    v = F.try_parse_json(raw)
    text = _get(v, "$.runtime_info.systemPromptText")
    own = text.isNotNull()
    told = lambda k, kind="string": _get(v, f"$.runtime_info.systemPrompt.{k}", kind)
    return outputs.select(
        "id", _get(v, "$.runtime_info.name").alias("name"), _get(v, "$.runtime_info.version").alias("version"), F.when(own, F.sha2(text, 256)).otherwise(told("sha256")).alias("prompt_sha256"),
        F.when(own, F.octet_length(text).cast("long")).otherwise(told("bytes", "long")).alias("prompt_bytes"), F.when(own, tokens_est_cjk(text)).otherwise(told("tokensEst", "long")).alias("prompt_tokens"), (~own & _get(v, "$.runtime_info.systemPrompt", "variant").isNotNull()).alias("self_reported"),
    )

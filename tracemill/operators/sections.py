"""Sections of an experiment's statistics over its valid runs.  What can't be known is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import equiv_tokens, js_round, mcp_server, ratio, tool_kind

KINDS = ("skill", "agent", "mcp", "builtin", "other")


def cache_hit_rate(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Mean over runs of each run's mean share of cached input; rounds without usage or footprint are skipped and counted."""
    usable = F.col("cache_r").isNotNull() & (F.col("footprint") > 0)
    runs = rounds.groupBy(*by, "run_id").agg(F.avg(F.when(usable, F.col("cache_r") / F.col("footprint"))).alias("_r"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("_skip"))
    r4 = lambda c: js_round(c, 4)
    return runs.groupBy(*by).agg(F.count("_r").alias("n"), F.sum("_skip").alias("skipped_rounds"), r4(F.avg("_r")).alias("mean"), r4(F.min("_r")).alias("min"), r4(F.max("_r")).alias("max"))


def self_report(reports: DataFrame, by: list[str]) -> DataFrame:
    """Sums of what runs say of themselves; a field that nobody reported stays null."""
    return reports.groupBy(*by).agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("invocations"), js_round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"), F.sum("num_turns").alias("num_turns"), F.sum("duration_ms").alias("duration_ms"), F.bool_or("is_error").alias("is_error"))


def sidechain_share(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Share of tokens, calls and weighted tokens in side chains; 0 of 0 is null.  rounds: chain, usage columns, n_calls."""
    usage = [F.coalesce(c, F.lit(0)) for c in ("u_in", "u_out", "u_cache_r", "u_cache_w")]
    amounts = {"tokens": sum(usage[1:], usage[0]), "calls": F.coalesce("n_calls", F.lit(0)), "equiv": equiv_tokens(*(F.col(c) for c in ("u_in", "u_out", "u_cache_r", "u_cache_w")))}
    side = F.col("chain") == "side"
    columns = []
    for name, amount in amounts.items():
        s, t = F.sum(F.when(side, amount).otherwise(F.lit(0))), F.sum(amount)
        columns += [js_round(s, 4).alias(f"{name}_side"), js_round(t, 4).alias(f"{name}_total"), js_round(ratio(s, t), 4).alias(f"{name}_share")]
    return rounds.groupBy(*by).agg(F.count_distinct("run_id").alias("n"), F.count_distinct(F.when(side, F.col("run_id"))).alias("runs_with_side"), *columns)


def declared_or_inferred(name: Column, declared: Column) -> Column:
    return F.when(declared.isNull(), tool_kind(name)).when(declared.isin(*KINDS), declared).otherwise("other")


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls by kind and scope: (kind, main, side).  calls: name, chain, declared_kind."""
    return calls.groupBy(declared_or_inferred(F.col("name"), F.col("declared_kind")).alias("kind")).agg(F.count_if(F.col("chain") == "main").alias("main"), F.count_if(F.col("chain") == "side").alias("side"))


def top_tools(calls: DataFrame, limit: int = 10) -> DataFrame:
    """The most called tools, ties by name; `kind` is that of the first call.  calls: name, outcome, declared_kind, ord."""
    kind = declared_or_inferred(F.col("name"), F.col("declared_kind"))
    return (
        calls.groupBy(F.coalesce("name", F.lit("unknown")).alias("name")).agg(F.min_by(kind, "ord").alias("kind"), F.count("*").alias("calls"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "permission-artifact").alias("denials"))
        .orderBy(F.desc("calls"), "name").limit(limit)
    )


def mcp_servers(calls: DataFrame) -> DataFrame:
    own = calls.filter(declared_or_inferred(F.col("name"), F.col("declared_kind")) == "mcp")
    return own.groupBy(mcp_server(F.col("name")).alias("server")).agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "permission-artifact").alias("denials"))


def truncation(rounds: DataFrame, by: list[str], cut: str = "max_tokens") -> DataFrame:
    """Shares over rounds, and over last rounds, whose stop reason is known.  rounds: run_id, seq, stop, declared_stop."""
    stop = F.coalesce("declared_stop", "stop")
    rows = rounds.withColumn("_stop", stop)
    last = F.row_number().over(W.partitionBy(*by, "run_id").orderBy(F.desc("seq"))) == 1
    rows = rows.withColumn("_last", last)
    known, final = F.col("_stop").isNotNull(), F.col("_last") & F.col("_stop").isNotNull()
    return rows.groupBy(*by).agg(
        F.count_if(known).alias("rounds"), F.count_if(~known).alias("unknown"), js_round(ratio(F.count_if(F.col("_stop") == cut), F.count_if(known)), 4).alias("truncated_share"),
        F.count_if(final & (F.col("_stop") == cut)).alias("final_runs"), F.count_if(final).alias("final_known"),
        js_round(ratio(F.count_if(final & (F.col("_stop") == cut)), F.count_if(final)), 4).alias("final_share"),
    )


def norm_path(p: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(p, r"\\", "/")), "/+$", "")


def file_target(path: Column, cwd: Column) -> Column:
    """workspace, skillRefs or otherAbsolute; pathless where there is no path."""
    p, c = norm_path(path), norm_path(cwd)
    full = F.when(p.rlike("^[a-z]:/") | p.startswith("/"), p).otherwise(F.concat(c, F.lit("/"), p))
    return F.when(path.isNull() | (path == ""), "pathless").when((full == c) | full.startswith(F.concat(c, F.lit("/"))), "workspace").when(full.rlike("(?:^|/)skills/[^/]+/.+$"), "skillRefs").otherwise("otherAbsolute")


def file_targets(calls: DataFrame) -> DataFrame:
    """Reads and writes by target.  calls: name, path, cwd; runs without a working directory take no part."""
    op = F.when(F.col("name") == "Read", "read").when(F.col("name").isin("Write", "Edit", "NotebookEdit", "MultiEdit"), "write")
    rows = calls.filter("cwd is not null").select(op.alias("op"), file_target(F.col("path"), F.col("cwd")).alias("target")).filter("op is not null")
    return rows.groupBy("op").pivot("target", ["skillRefs", "workspace", "otherAbsolute", "pathless"]).count().na.fill(0)


def health(reps: DataFrame, by: list[str]) -> DataFrame:
    """Exclusions, aborts, timeouts (an old-style marker is unknown), successes after retries.  Held-out repeats are left out."""
    own = reps.filter(~F.coalesce("held_out", F.lit(False)))
    legacy = F.col("timed_out").isNull() & (F.coalesce("error", F.lit("")) == "timeout")
    return own.groupBy(*by).agg(
        F.count_if("excluded").alias("excluded"), F.count("aborted_at_step").alias("aborted"), F.count_if(F.coalesce("timed_out", F.lit(False))).alias("timed_out"), F.count_if(~legacy).alias("knowable"),
        F.count_if(legacy).alias("legacy_unknown"), js_round(ratio(F.count_if(F.coalesce("timed_out", F.lit(False))), F.count_if(~legacy)), 4).alias("timeout_rate"), F.count_if((F.col("n_retries") > 0) & (F.col("C") == 1)).alias("retried_then_succeeded"),
    )


def verifier_key(type_: Column, detail: Column) -> Column:
    """A verifier's name without what it saw this time."""
    return F.concat(F.coalesce(type_, F.lit("unknown")), F.lit(": "), F.regexp_replace(F.coalesce(detail, F.lit("")), r"\s*\((?:saw |missing|not valid JSON)[^)]*\)$", ""))


def verifier_fails(results: DataFrame, limit: int = 10) -> DataFrame:
    return results.filter("passed = false").groupBy(verifier_key(F.col("type"), F.col("detail")).alias("verifier")).agg(F.count("*").alias("fails")).orderBy(F.desc("fails"), "verifier").limit(limit)


def authority(experiments: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Which statistics count: sealed ones, else a written side file, else none.  (id, authority, stats)."""
    side = sidecars.select("id", F.col("stats").alias("_side"))
    out = experiments.join(side, "id", "left")
    return out.select("id", F.when(F.col("stats").isNotNull(), "sealed").when(F.col("_side").isNotNull(), "backfill").otherwise("none").alias("authority"), F.coalesce("stats", "_side").alias("stats"))

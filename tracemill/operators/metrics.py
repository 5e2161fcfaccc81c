"""Token, cost and context metrics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.config import CONTEXT_LIMIT
from tracemill.functions.num import js_round

# List prices in USD per million tokens; the first rule whose text a model's name holds applies.
PRICES = (
    ("opus", 15.0, 75.0, 18.75, 1.5),
    ("sonnet", 3.0, 15.0, 3.75, 0.3),
    ("haiku", 1.0, 5.0, 1.25, 0.1),
    ("gpt", 2.5, 10.0, 0.0, 1.25),
    ("deepseek", 0.27, 1.1, 0.0, 0.07),
)
FALLBACK = (None, 3.0, 15.0, 3.75, 0.3)


def pricing(custom: list[tuple] | None = None, fallback: tuple = FALLBACK) -> tuple[list[tuple], tuple]:
    """Rules in order of precedence: own ones before the list."""
    return [*(custom or []), *PRICES], fallback


def price(model_rows: DataFrame, model: str, rules: list[tuple] = list(PRICES), fallback: tuple = FALLBACK) -> DataFrame:
    """Adds price_match, p_in, p_out, p_cache_w, p_cache_r, price_matched.  A few rules: one CASE, no join."""
    low = F.lower(F.coalesce(F.col(model), F.lit("")))
    rule = F.lit(None)
    for k in range(len(rules) - 1, -1, -1):
        rule = F.when(F.contains(low, F.lit(rules[k][0].lower())), F.lit(k)).otherwise(rule)
    out = model_rows.withColumn("_rule", rule.cast("int"))
    for j, name in enumerate(("p_in", "p_out", "p_cache_w", "p_cache_r"), 1):
        value = F.element_at(F.array(*(F.lit(float(r[j])) for r in rules)), F.col("_rule") + 1) if rules else F.lit(None)
        out = out.withColumn(name, F.when(F.col("_rule").isNull(), F.lit(float(fallback[j]))).otherwise(value))
    names = F.array(*(F.lit(r[0]) for r in rules))
    return out.withColumn("price_match", F.when(F.col("_rule").isNotNull(), F.element_at(names, F.col("_rule") + 1))).withColumn("price_matched", F.col("_rule").isNotNull()).drop("_rule")


def run_metrics(rounds: DataFrame, runs: DataFrame, rules: list[tuple] = list(PRICES), fallback: tuple = FALLBACK) -> DataFrame:
    """Totals per run from rounds (run_id, chain, model, duration_ms, u_*, footprint, n_calls, n_errors) and runs (run_id, model, started_at, ended_at).

    Rounds without usage count for everything but tokens and cost.
    """
    priced = price(rounds.join(runs.select("run_id", F.col("model").alias("_rm")), "run_id", "left").withColumn("_m", F.coalesce("model", "_rm")), "_m", rules, fallback)
    cost = (F.col("u_in") * F.col("p_in") + F.col("u_out") * F.col("p_out") + F.col("u_cache_w") * F.col("p_cache_w") + F.col("u_cache_r") * F.col("p_cache_r")) / 1e6
    used = F.col("u_in").isNotNull()
    main = F.col("chain") == "main"
    by = priced.groupBy("run_id").agg(
        F.count_if(main).alias("rounds"), F.count_if(~main).alias("sidechain_rounds"),
        *(F.coalesce(F.sum(f"u_{k}"), F.lit(0)).alias(f"tokens_{k}") for k in ("in", "out", "cache_w", "cache_r")),
        js_round(F.coalesce(F.sum(F.when(used, cost)), F.lit(0.0)), 4).alias("cost_usd"), F.every(~used | F.col("price_matched")).alias("pricing_matched"),
        F.sum("n_calls").alias("tool_calls"), F.sum("n_errors").alias("tool_errors"), F.sum(F.when(main, F.col("duration_ms"))).alias("_dur"),
        F.max(F.when(main, F.col("footprint"))).alias("peak_context"),
    )
    wall = F.unix_millis("ended_at") - F.unix_millis("started_at")
    out = runs.select("run_id", "started_at", "ended_at").join(by, "run_id")
    return out.withColumn("duration_ms", F.coalesce(F.greatest(F.lit(0), wall), F.col("_dur"))).withColumn("context_limit", F.lit(CONTEXT_LIMIT)).drop("_dur", "started_at", "ended_at")


def skill_metrics(rounds: DataFrame) -> DataFrame:
    """Per run and skill; a round counts once for each distinct skill that it names (attribution or a call's).

    rounds: run_id, attribution_skill, call_skills (array), u_*, duration_ms, n_calls, n_errors.
    """
    skills = F.array_distinct(F.array_compact(F.concat(F.array("attribution_skill"), F.coalesce("call_skills", F.array().cast("array<string>")))))
    rows = rounds.withColumn("skill", F.explode(skills))
    return rows.groupBy("run_id", "skill").agg(
        F.count("*").alias("rounds"), *(F.coalesce(F.sum(f"u_{k}"), F.lit(0)).alias(f"tokens_{k}") for k in ("in", "out", "cache_w", "cache_r")),
        F.sum("duration_ms").alias("duration_ms"), F.sum("n_calls").alias("tool_calls"), F.sum("n_errors").alias("tool_errors"),
    )


def merge_invocations(invocations: DataFrame, by: list[str], order: str) -> DataFrame:
    """Costs, turns and tokens of resumed invocations add up; quality is that of the last."""
    return invocations.groupBy(*by).agg(F.sum("cost_usd").alias("cost_usd"), F.sum("rounds").alias("rounds"), F.sum("tokens").alias("tokens"), F.max_by("quality", order).alias("quality"))


def estimate_budget(cases, repeats, arms, concurrency, session_ms=120_000, tokens=(12_000, 1_500, 30_000, 4_000), prices=(3.0, 15.0, 0.3, 3.75)):
    """Sessions, ETA and cost of a planned comparison: columns (sessions, eta_ms, usd)."""
    sessions = cases * repeats * arms
    usd = sum(t * p for t, p in zip(tokens, prices, strict=True)) / 1e6
    return sessions.alias("sessions"), (F.ceil(sessions / concurrency) * session_ms).alias("eta_ms"), js_round(sessions * usd, 4).alias("usd")


def skill_profiles(versions: DataFrame, runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Full outer union of skills known from versions (skill, hash, created_at), runs (skill, rounds) and scores (skill, composite, activation_rate)."""
    v = versions.groupBy("skill", "hash").agg(F.min("created_at").alias("first_seen")).groupBy("skill").agg(F.count("*").alias("n_versions"), F.min("first_seen").alias("first_seen"))
    r = runs.groupBy("skill").agg(F.count("*").alias("runs"), F.sum("rounds").alias("rounds"))
    e = experiments.groupBy("skill").agg(F.count("*").alias("experiments"), js_round(F.avg("composite")).alias("mean_composite"), F.every(F.col("activation_rate") == 0).alias("never_triggered"))
    out = v.join(r, "skill", "full_outer").join(e, "skill", "full_outer")
    return out.select("skill", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), "first_seen", F.coalesce("runs", F.lit(0)).alias("runs"), "rounds", F.coalesce("experiments", F.lit(0)).alias("experiments"), "mean_composite", F.coalesce("never_triggered", F.lit(False)).alias("never_triggered"))


def paired_models(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Task by task: two models' composites and their difference."""
    x, y = (scores.filter(F.col("model") == m).select("task_id", F.col("composite").alias(n)) for m, n in ((a, "a"), (b, "b")))
    return x.join(y, "task_id").withColumn("delta", js_round(F.col("b") - F.col("a")))


def skill_trend(scores: DataFrame) -> DataFrame:
    """A skill's composites in order of time within comparable cohorts (suite, model, runtime)."""
    return scores.groupBy("skill", "suite_sha", "model", "runtime").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "composite"))), lambda x: x["composite"]).alias("series"))


def skill_body_cost(calls: DataFrame) -> DataFrame:
    """Tokens of the skill bodies that a run loaded (a quarter of their characters); null if none was seen."""
    from tracemill.config import TOKEN_CHARS
    from tracemill.functions.num import utf16_len

    return calls.groupBy("run_id").agg(F.floor(F.sum(F.when(F.col("name") == "Skill", utf16_len(F.col("skill_body")))) / TOKEN_CHARS + 0.5).cast("long").alias("body_tokens"))


def sum_efficiency(reps: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, time and cost added up; diagnostic, never part of a score."""
    return reps.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("u_in", "u_out", "u_cache_w", "u_cache_r", "duration_ms", "cost_usd")))


def skill_context(skills: DataFrame) -> DataFrame:
    """What a skill file costs while listed (its name and description) and once loaded (its body).  name, text."""
    from tracemill.config import TOKEN_CHARS

    front = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    desc = F.regexp_extract(front, r"(?m)^description:\s*(.+)$", 1)
    body = F.length(F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", ""))
    return skills.select("name", F.ceil((F.length("name") + F.length(desc)) / TOKEN_CHARS).alias("listing_tokens"), F.ceil(body / TOKEN_CHARS).alias("body_tokens"))

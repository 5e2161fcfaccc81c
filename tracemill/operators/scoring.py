"""From verifier results to repeat, task and experiment scores.

Excluded repeats leave every denominator; failed ones stay with outcome 0.  Unknown dimensions are null and their
weight is spread over the others.  Efficiency and pass@k are diagnostics, never part of the composite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import MIN_REPEATS, WEIGHTS
from tracemill.functions.num import clamp01, js_round, pass_at_k, ratio, wilson


def gate(results: DataFrame, by: list[str], authority: str = "deterministic") -> DataFrame:
    """Outcome C from verifier results (cls, passed): one class of grader has authority, the other rides along."""
    all_of = lambda judged: F.every(F.when((F.coalesce("cls", F.lit("deterministic")) == "judged") == judged, F.coalesce("passed", F.lit(False)))).cast("int")
    out = results.groupBy(*by).agg(all_of(False).alias("c_deterministic"), all_of(True).alias("c_judged"))
    first, second = ("c_judged", "c_deterministic") if authority == "judged" else ("c_deterministic", "c_judged")
    used = F.when(F.lit(authority == "judged") & F.col("c_judged").isNotNull(), "judged").otherwise("deterministic")
    return out.withColumn("C", F.coalesce(first, second, F.lit(0))).withColumn("authority", used)


def score_repeat(runs: DataFrame) -> DataFrame:
    """Adds P, H, tool_err_rate from tool_calls, tool_errors, n_rounds, max_turns, activated, peak, first_fp, last_fp, n_fp, context_limit."""
    err = F.when(F.col("tool_calls") > 0, F.col("tool_errors") / F.col("tool_calls")).otherwise(0.0)
    hit = ((F.col("max_turns") > 0) & (F.col("n_rounds") >= F.col("max_turns"))).cast("double")
    p = F.when(F.col("activated").isNull(), (err + hit) / 2).otherwise((err + hit + F.when(F.col("activated"), 0.0).otherwise(1.0)) / 3)
    limit = F.col("context_limit")
    growth = F.when(F.col("n_fp") >= 2, clamp01((F.col("last_fp") - F.col("first_fp")) / limit)).otherwise(0.0)
    h = F.when(F.col("peak") > 0, (clamp01(1 - F.col("peak") / limit) + (1 - growth)) / 2)
    return runs.withColumn("P", js_round(clamp01(1 - p))).withColumn("H", js_round(h)).withColumn("tool_err_rate", js_round(err)).withColumn("hit_max_turns", hit > 0)


def composite(c: Column, p: Column, r: Column, h: Column) -> tuple[Column, Column]:
    """(weighted mean over known dimensions, number of known dimensions)."""
    dims = list(zip(WEIGHTS.values(), (c, p, r, h), strict=True))
    top = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in dims), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in dims), F.lit(0.0))
    return F.when(weight > 0, js_round(top / weight)), sum((v.isNotNull().cast("int") for _, v in dims), F.lit(0))


def score_task(reps: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Task scores from repeats (excluded, failed, C, P, H, activated); C is 0 or 1 times 1.0."""
    excluded = F.coalesce("excluded", F.lit(False))
    failed = F.coalesce("failed", F.lit(False))
    valid, ok = ~excluded, ~excluded & ~failed
    c = F.when(valid, F.when(failed, 0.0).otherwise(F.coalesce(F.col("C").cast("double"), F.lit(0.0))))
    act = F.when(valid & failed, 0).when(ok & F.col("activated").isNotNull(), F.col("activated").cast("int"))
    g = reps.groupBy(*by).agg(
        F.count_if(valid).alias("n"), F.count_if(valid & failed).alias("failed_repeats"), F.count_if(excluded).alias("excluded_repeats"),
        F.sum(c).alias("_c"), F.sum(c * c).alias("_c2"), F.count_if(valid & (c == 1.0)).alias("_s"),
        F.avg(F.when(ok, F.col("P"))).alias("_p"), F.avg(F.when(ok, F.col("H"))).alias("_h"),
        F.sum(act).alias("_a"), F.count(act).alias("_an"),
    )
    n = F.col("n")
    mean = F.when(n > 0, F.col("_c") / n)
    stdev = F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_c2") / n - mean * mean)))  # population
    rate = F.when(F.col("_an") > 0, F.col("_a") / F.col("_an"))
    r = F.when(n > 0, clamp01(F.coalesce(rate, F.lit(1.0)) * (1 - stdev)))
    value, known = composite(mean, F.col("_p"), r, F.col("_h"))
    floor = (n == 0) | ((F.col("excluded_repeats") > 0) & (n < MIN_REPEATS))
    lo, hi = wilson(F.col("_s"), n)
    return g.select(
        *by, "n", "failed_repeats", "excluded_repeats", js_round(mean).alias("C"), js_round(F.col("_p")).alias("P"), js_round(r).alias("R"), js_round(F.col("_h")).alias("H"),
        F.when(~floor, value).alias("composite"), (~floor & (known < 4)).alias("composite_partial"), js_round(rate).alias("activation_rate"),
        js_round(F.col("_s") / F.greatest(F.lit(1), n)).alias("success_rate"), lo.alias("ci_lo"), hi.alias("ci_hi"), (n < MIN_REPEATS).alias("low_sample"),
        *(F.when(n >= k, pass_at_k(n, F.col("_s"), F.lit(k))).alias(f"pass_at_{k}") for k in ks),
    )


def activation_outcome(reps: DataFrame, by: list[str]) -> DataFrame:
    """Mean outcome with and without activation; groups where activation is unknown throughout are left out."""
    known = reps.filter(~F.coalesce("excluded", F.lit(False)) & F.col("activated").isNotNull())
    side = lambda flag: (F.count_if(F.col("activated") == flag), js_round(F.avg(F.when(F.col("activated") == flag, F.col("C")))))
    (tn, tc), (un, uc) = side(True), side(False)
    out = known.groupBy(*by).agg(tn.alias("triggered_n"), tc.alias("triggered_c"), un.alias("not_triggered_n"), uc.alias("not_triggered_c"))
    low = lambda c: (F.col(c) > 0) & (F.col(c) < MIN_REPEATS)
    return out.withColumn("low_sample", low("triggered_n") | low("not_triggered_n"))


def score_experiment(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Means of known task values; flags and exclusions summed up."""
    return tasks.groupBy(*by).agg(
        *(js_round(F.avg(k)).alias(k) for k in ("composite", "C", "P", "R", "H")),
        F.bool_or("low_sample").alias("low_sample"), F.bool_or("composite_partial").alias("composite_partial"),
        F.bool_or(F.col("excluded_repeats") > 0).alias("degraded"), F.sum("excluded_repeats").alias("excluded_repeats"),
    )


def flow_incomplete(reps: DataFrame, by: list[str]) -> DataFrame:
    """Share of attempted repeats whose flow stayed incomplete, with its interval; 0 without attempts."""
    x, n = F.count_if(F.col("flow_status") == "incomplete"), F.count("*")
    lo, hi = wilson(x, n)
    return reps.groupBy(*by).agg(x.alias("numerator"), n.alias("denom"), js_round(F.coalesce(ratio(x, n), F.lit(0.0))).alias("rate"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def multi_step(steps: DataFrame, by: list[str]) -> DataFrame:
    """Repeats of several steps (step, passed, total, min_reward): stop after a step whose reward is below its least.

    C is 1 if all steps ran and all had reward 1.
    """
    from pyspark.sql import Window as W

    reward = F.coalesce(ratio(F.col("passed"), F.col("total")), F.lit(0.0))
    w = W.partitionBy(*by).orderBy("step")
    s = steps.withColumn("_r", reward).withColumn("_stop", (reward < F.coalesce("min_reward", F.lit(0.0))).cast("int"))
    s = s.withColumn("_before", F.coalesce(F.sum("_stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ran = F.col("_before") == 0
    out = s.groupBy(*by).agg(F.count_if(ran).alias("steps_run"), F.count("*").alias("steps"), F.min(F.when(ran & (F.col("_stop") == 1), F.col("step"))).alias("aborted_at_step"), js_round(F.avg(F.when(ran, F.col("_r")))).alias("reward"), F.every(ran & (F.col("_r") == 1.0)).alias("_all"))
    return out.withColumn("C", F.col("_all").cast("int")).drop("_all")


#: Infrastructure failures, told by what only infrastructure writes; the first that fits names it.
ENV_NOISE = (
    ("rate-limit-429", r"(?i)\b429\b|too many requests"),
    ("overloaded-529", r"(?i)\b529\b|overloaded"),
    ("auth-expired", r"(?i)\b53017\b|auth\w*\s*(token\s*)?expir|token\s*expir|expired\s*(auth|token|credential|session)|authentication\s*(failed|expired)"),
    ("conn-refused", r"ECONNREFUSED|ECONNRESET|ETIMEDOUT|EAI_AGAIN|ENOTFOUND"),
    ("rate-limit", r"(?i)rate[\s_-]?limit(?:ed|ing)?"),
)


def env_noise(text: Column) -> Column:
    """Label of an infrastructure failure, or null."""
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in ENV_NOISE))

"""From two arms' repeats to a verdict: pairs, intervals, flows, causes, and the report as a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.num import equiv_tokens, js_round
from tracemill.operators import compare, inference, views

AXES = ("l1", "l2", "l3", "cost")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(axis, case_id, delta, one): new minus old by case, in points for quality and weighted tokens for cost.

    Cases with an arm whose repeats are all excluded, and unknown differences, are left out.
    """
    pairs = compare.paired(old, new).filter(~F.col("excluded"))
    quality = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_delta").alias("delta")) for a in AXES[:3]))
    rows = pairs.select("case_id", F.explode(quality).alias("x")).select("x.axis", "case_id", "x.delta")
    spent = lambda arm, name: arm.filter(~F.col("excluded") & F.col("u_in").isNotNull()).groupBy("case_id").agg(F.avg(equiv_tokens(*(F.col(c) for c in ("u_in", "u_out", "u_cache_r", "u_cache_w")))).alias(name))
    cost = pairs.select("case_id").join(spent(old, "_o"), "case_id").join(spent(new, "_n"), "case_id").select(F.lit("cost").alias("axis"), "case_id", (F.col("_n") - F.col("_o")).alias("delta"))
    return rows.unionByName(cost).filter("delta is not null").withColumn("one", F.lit(1))


def comparison(old: DataFrame, new: DataFrame, intent: str, target: str | None = None, iters: int | None = None) -> DataFrame:
    """One row: verdict, established, causes, line, footer and the intervals of every axis.

    old, new: rows of `compare.experiment_arm` with case_id, excluded, l1_pass, l2_pass, l3_pass, flow_status, u_in,
    u_out, u_cache_r, u_cache_w.  A change is significant if its interval lies on one side of zero.
    """
    options = {} if iters is None else {"iters": iters}
    ends = inference.bootstrap(differences(old, new), ["axis"], "case_id", "delta", "one", **options)
    one = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    wide = ends.agg(*(one(a, c).alias(f"{a}_{n}") for a in AXES for c, n in (("lo", "low"), ("hi", "high"), ("mean", "mean"))))
    counts = compare.exclusion_pct(compare.paired(old, new)).withColumn("exclusion_pct", F.coalesce("exclusion_pct", F.lit(0.0)))
    flow = lambda arm, s: arm.agg(F.count_if(F.col("flow_status") == "incomplete").alias(f"_x{s}"), F.count("*").alias(f"_n{s}"))
    row = wide.crossJoin(counts).crossJoin(flow(old, "o")).crossJoin(flow(new, "n"))  # one row each
    regressed = inference.compare_flow(F.col("_xn"), F.col("_nn"), F.col("_xo"), F.col("_no"))[0].alias("flow_regressed")
    up = lambda a: F.coalesce(F.col(f"{a}_low") > 0, F.lit(False))
    row = row.select(
        F.lit("comparison").alias("id"), F.lit(intent).alias("intent"), F.lit(target).cast("string").alias("target"), "pairs", "exclusion_pct", *(f"{a}_{n}" for a in AXES for n in ("low", "high", "mean")),
        regressed, F.coalesce(F.col("cost_high") < 0, F.lit(False)).alias("any_cost_down"), up("cost").alias("any_cost_up"), *(up(a).alias(f"{a}_up") for a in AXES[:3]), (up("l1") | up("l2") | up("l3")).alias("any_quality_up"), F.lit(len(AXES)).alias("tests"),
    )
    out = views.failure_causes(views.verdict_view(inference.decide(row)))
    return compare.verdict_footer(views.verdict_line(out))


def document(found: DataFrame) -> DataFrame:
    """(id, report) of comparisons, as JSON with the verdict first."""
    sections = ["line", "causes", "intent", *(f"{a}_{n}" for a in AXES for n in ("low", "high", "mean")), "footer"]
    return views.report_json(found, sections)


def stats(rounds: DataFrame, calls: DataFrame, reports: DataFrame, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of statistics of a set of runs.  rounds, calls and reports as the log parser and `logs.run_rounds` give them.

    With `runs` also the sections that need a run's folder or the number of runs: files, skills and commands read.
    """
    from tracemill.operators import cards, sections
    from tracemill.sources import logs

    all_ = rounds.withColumn("_all", F.lit("all"))
    used = calls.select("name", "chain", F.lit(None).cast("string").alias("declared_kind"), F.when(F.col("denial_kind").isNotNull(), "permission-artifact").when(F.col("is_error"), "error").otherwise("success").alias("outcome"), F.struct("run_id", "line_no", "pos").alias("ord"))
    more = {}
    if runs is not None:
        path = F.coalesce(F.try_variant_get("input", "$.file_path", "string"), F.try_variant_get("input", "$.notebook_path", "string"))
        own = calls.filter("chain = 'main'").select("run_id", "name", path.alias("path")).join(runs.select("run_id", "cwd"), "run_id")
        n_runs = runs.agg(F.count("*").alias("_runs"))
        first = logs.triggers(calls).groupBy("skill").agg(F.count("*").alias("runs"), F.count_if("is_primary").alias("primary_runs"))
        read = logs.reads(calls).groupBy("skill", "logical_ref").agg(F.count("*").alias("runs"))
        share = lambda df: df.crossJoin(F.broadcast(n_runs)).withColumn("rate", js_round(F.col("runs") / F.col("_runs"))).drop("_runs")  # noqa: E731  one row
        more = {"files": sections.file_targets(own), "skills": share(first), "references": share(read)}
    return more | {
        "tools": cards.tool_view(sections.tool_usage(used)),
        "top_tools": sections.top_tools(used),
        "mcp_servers": sections.mcp_servers(used),
        "cache": sections.cache_hit_rate(all_.withColumnRenamed("u_cache_r", "cache_r"), ["_all"]).drop("_all"),
        "truncation": sections.truncation(all_.select("_all", "run_id", "seq", F.col("stop_reason").alias("stop"), F.lit(None).cast("string").alias("declared_stop")), ["_all"]).drop("_all"),
        "side_chains": sections.sidechain_share(all_, ["_all"]).drop("_all"),
        "self_reports": sections.self_report(reports.withColumn("_all", F.lit("all")), ["_all"]).drop("_all"),
    }


def findings(cases: DataFrame) -> DataFrame:
    """What is wrong with a suite's cases, one row for each finding: (check, subject, detail).

    cases: id, superseded_by, expected (array), allowed (array), multi_intent (array), tier.
    """
    from tracemill.operators import lint

    row = lambda check, subject, detail: [F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]
    parts = [
        lint.duplicates(cases).select(*row("duplicate-id", F.col("id"), F.col("occurrences"))),
        lint.dangling(cases).select(*row("dangling-superseded", F.col("id"), F.col("superseded_by"))),
        lint.skill_coverage(cases.select("expected")).select(*row("skill-coverage", F.col("skill"), F.col("current_n"))),
        lint.multi_intent(cases.select("multi_intent")).select(*row("multi-intent-share", F.lit("suite"), js_round(F.col("pct"), 4))),
        lint.smoke_size(cases.select("tier")).select(*row("smoke-tier-size", F.lit("suite"), F.col("n"))),
        lint.redundant_auxiliary(cases.select("id", "expected", "allowed")).select(*row("redundant-auxiliary", F.col("id"), F.col("skill"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Rows for people: what a report or dashboard lists, in the order in which it lists it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import VERDICT
from tracemill.functions.num import js_round


def question_list(tasks: DataFrame) -> DataFrame:
    """Tasks that need attention first: worst composite first, unknown last, held-out ones left out; with hue and verdict."""
    own = tasks.filter(~F.coalesce("held_out", F.lit(False)))
    verdict = F.when(F.col("C").isNull(), "na").when(F.col("C") >= 1, "pass").when(F.col("C") <= 0, "fail").otherwise("partial")
    return own.withColumn("hue", score_hue(F.col("composite"), F.coalesce(F.col("C") != 0, F.lit(True)))).withColumn("verdict", verdict).orderBy(F.asc_nulls_last("composite"), "task_id")


def score_hue(composite: Column, right: Column) -> Column:
    """0 (red) to 120 (green); a wrong answer is red, no data has no hue."""
    return F.when(composite.isNull(), F.lit(None)).when(~right, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), composite)) * 120 + 0.5)).cast("int")


def delta_significant(delta: Column, total: Column, share: float = 0.10) -> Column:
    """A change of at least a tenth."""
    return F.coalesce(F.abs(delta) >= share * F.abs(total), F.lit(False))


def prune_hint(runs: DataFrame, now_ms: int, days: int = 90, count: int = 200) -> DataFrame:
    """One row if runs are old or many.  runs: ts_ms."""
    g = runs.agg(F.count("*").alias("count"), F.floor((F.lit(now_ms) - F.min("ts_ms")) / 86_400_000).alias("oldest_days"))
    return g.withColumn("by_age", F.coalesce(F.col("oldest_days") > days, F.lit(False))).withColumn("by_count", F.col("count") > count).filter("by_age or by_count")


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of experiments by id: what keeps them from comparing (suite, model, runtime).  Rows: pair, suite, model, runtime."""
    x, y = (d.select("pair", *(F.col(c).alias(f"{c}_{s}") for c in ("suite", "model", "runtime"))) for d, s in ((a, "a"), (b, "b")))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in ("suite", "model", "runtime"))))
    return x.join(y, "pair").select("pair", (F.size(differ) == 0).alias("comparable"), differ.alias("reasons"))


def hash_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Skills of both whose hashes differ.  Rows: name, hash."""
    return a.select("name", F.col("hash").alias("hash_a")).join(b.select("name", F.col("hash").alias("hash_b")), "name").filter("hash_a <> hash_b")


def disjoint(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Intervals that don't touch; unknown bounds claim nothing."""
    known = lo_a.isNotNull() & hi_a.isNotNull() & lo_b.isNotNull() & hi_b.isNotNull()
    return F.coalesce(known & ((hi_a < lo_b) | (hi_b < lo_a)), F.lit(False))


def within_noise(tasks: DataFrame, by: list[str]) -> DataFrame:
    """No shared task's intervals are disjoint.  Rows: lo_a, hi_a, lo_b, hi_b."""
    return tasks.groupBy(*by).agg(F.every(~disjoint(*(F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")))).alias("within_noise"))


def delta_tally(deltas: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*by).agg(F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"), F.count_if(d == 0).alias("flat"))


def verdict_view(reports: DataFrame) -> DataFrame:
    """Adds glyph, adoptable, decidable, recommended, need_pairs to reports (verdict, established, pairs)."""
    v, est = F.col("verdict"), F.coalesce("established", F.lit(False))
    open_ = v.isin("insufficient-data", "inconclusive")
    glyph = F.when(v == "insufficient-data", "∅").when(v == "inconclusive", "~").when(est, "✓").otherwise("✗")
    need = F.when(v == "insufficient-data", F.greatest(F.lit(0), VERDICT["min_pairs"] - F.col("pairs")))
    return reports.withColumn("glyph", glyph).withColumn("adoptable", ~open_ & est).withColumn("decidable", ~open_).withColumn("recommended", F.when(~open_, est)).withColumn("need_pairs", need)


def upgrade_view(reports: DataFrame, axes: DataFrame) -> DataFrame:
    """What a reader of an upgrade report sees: the verdict view, the axes that have figures, and what to do next.

    reports: id, verdict, established, pairs, min_pairs (of the report's own configuration, or null); axes: id, kind (quality
    or cost), key, delta, lo, hi, n, heuristic, routing_old, routing_new (whether an arm has skills to route to; null in old
    reports, which counts as having them).  An axis with no figures but an arm without skills stays, marked `na_routing`.
    """
    own = verdict_view(reports).withColumn("need_pairs", F.when(F.col("verdict") == "insufficient-data", F.greatest(F.lit(0), F.coalesce("min_pairs", F.lit(VERDICT["min_pairs"])) - F.col("pairs"))))
    unrouted = (F.col("key") == "l1") & ~(F.coalesce("routing_old", F.lit(True)) & F.coalesce("routing_new", F.lit(True)))
    shown = axes.withColumn("na_routing", unrouted).filter((F.col("n") > 0) | F.col("na_routing"))
    axis = F.struct("key", "delta", "lo", "hi", "n", F.coalesce("heuristic", F.lit(False)).alias("heuristic"), "na_routing")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, axis)))
    grouped = shown.groupBy("id").agg(of("quality").alias("quality_axes"), of("cost").alias("cost_axes"))
    step = F.when(F.col("verdict").isin("insufficient-data", "inconclusive"), F.col("verdict")).when(F.col("adoptable"), "adopt").otherwise("inspect-regressions")
    return own.join(grouped, "id", "left").withColumn("next_step", step)


def exclusion_actions(cases: DataFrame) -> DataFrame:
    """What to do about excluded cases, by reason."""
    return cases.withColumn("action", F.when(F.col("reason") == "harness-halt", "add-scripted-reply").when(F.col("reason") == "env-noise", "inspect-env-noise").otherwise("inspect"))


def red_list(skills: DataFrame) -> DataFrame:
    """Significant regressions first, then skills whose figures are for reference only."""
    worse = F.col("significant") & (F.col("mean") < 0)
    flag = F.when(worse, "regressed").when(F.col("badge") != "ok", "low-confidence")
    return skills.withColumn("flag", flag).filter("flag is not null").orderBy(F.desc(worse), "mean", "skill")


def report_diff(reports: DataFrame) -> DataFrame:
    """Each report beside the one before it of the same suite and model: verdict change and deltas of its rates."""
    from tracemill.operators.trend import previous

    p = previous(reports, ["suite", "model"])
    before = reports.select(F.col("id").alias("prev_id"), F.col("verdict").alias("prev_verdict"), *(F.col(f"{x}_rate").alias(f"_{x}") for x in ("l1", "l2", "l3")))
    out = p.join(before, "prev_id", "left")
    return out.select("id", "prev_id", "verdict", "prev_verdict", *(js_round(100 * (F.col(f"{x}_rate") - F.col(f"_{x}"))).alias(f"{x}_delta_pp") for x in ("l1", "l2", "l3")))


def report_json(summary: DataFrame, sections: list[str]) -> DataFrame:
    """A report as one JSON document a row, the verdict first, then the named sections in order."""
    head = [c for c in ("id", "verdict", "established", "pairs", "exclusion_pct") if c in summary.columns]
    return summary.select("id", F.to_json(F.struct(*head, *(s for s in sections if s in summary.columns))).alias("report"))


def failure_causes(reports: DataFrame) -> DataFrame:
    """Adds `causes`: why a decidable report is not recommended, worst first; null if it is, or can't be decided.

    reports: verdict, established, l1_low, l2_low, l3_low (lower ends of the differences, in points), any_cost_up,
    flow_regressed, any_quality_up.  A cause is what got worse, by how much, and how much would have been tolerated.
    """
    margin = float(VERDICT["delta_pp"])
    cause = lambda what, by, limit: F.struct(F.lit(what).alias("what"), by.alias("by"), F.lit(limit).cast("double").alias("margin"))
    nothing = F.lit(None).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False))
    found = [F.when(flag(F.col(f"{a}_low") <= -margin), cause(f"{a}-quality", F.col(f"{a}_low").cast("double"), margin)) for a in ("l1", "l2", "l3")]
    found += [F.when(flag(F.col("flow_regressed")), cause("incomplete-flows", nothing, None)), F.when(flag(F.col("any_cost_up")), cause("cost-up", nothing, None))]
    found += [F.when((F.col("verdict") == "quality-fix") & ~flag(F.col("any_quality_up")), cause("no-quality-gain", nothing, None))]
    order = lambda a, b: F.when(F.coalesce(a["by"], F.lit(0.0)) < F.coalesce(b["by"], F.lit(0.0)), -1).when(F.coalesce(a["by"], F.lit(0.0)) > F.coalesce(b["by"], F.lit(0.0)), 1).when(a["what"] < b["what"], -1).when(a["what"] > b["what"], 1).otherwise(0)
    open_ = F.col("verdict").isin("insufficient-data", "inconclusive")
    return reports.withColumn("causes", F.when(~open_ & ~flag(F.col("established")), F.array_sort(F.array_compact(F.array(*found)), order)))


def verdict_line(reports: DataFrame) -> DataFrame:
    """Adds `line`: glyph, recommendation, intent, pairs and exclusion rate in one line.  reports: those of `verdict_view`, with intent and exclusion_pct."""
    sign = F.when(~F.col("decidable"), "∅").when(F.col("adoptable"), "✓").otherwise("✗")
    advice = F.when(~F.col("decidable"), F.concat(F.lit("undecided: "), "verdict")).otherwise(F.concat(F.lit("recommended: "), F.col("adoptable").cast("string")))
    return reports.withColumn("line", F.concat(sign, F.lit(" "), advice, F.lit(" · intent: "), "intent", F.lit(" · n="), F.col("pairs").cast("string"), F.lit(" pairs · excluded "), F.format_string("%.1f%%", F.col("exclusion_pct").cast("double"))))


def newest_first(rows: DataFrame, time: str, id_col: str) -> DataFrame:
    """A listing: all rows, the newest first, equal times by descending id."""
    return rows.orderBy(F.desc(time), F.desc(id_col))

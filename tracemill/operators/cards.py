"""Section and card views of an experiment: what a page shows of its statistics, as rows.

What can't be known is null and says why; a status is a word, never a ratio of nothing.  Labels are keys for a page to
translate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.num import js_round, ratio
from tracemill.operators.sections import KINDS

# The order in which a page lists the parts of a context, and the reasons for which a section is unknown.
CONTEXT_PARTS = ("baseline", "prev_out", "tool_res", "injected_user", "injected_harness", "skill_body", "other")
NULL_REASONS = ("no-user-events-channel", "untagged-legacy-run", "no-cwd", "no-stop-reason", "no-result-lines", "no-sidechain-channel", "no-usage", "no-valid-runs", "no-aggregatable-runs")


def stack_series(items: DataFrame) -> DataFrame:
    """Bands of a run's context growth by round: (run_id, seq, prev_out, tool_res, injected, residual, compaction).

    The injected kinds are one band; the residual keeps its sign.  A run's first round has no items, hence no row.
    items: those of `attribution.run_items`.
    """
    injected = sum((F.coalesce(c, F.lit(0)) for c in ("injected_user", "injected_harness", "skill_body")), F.lit(0))
    return items.select("run_id", "seq", "prev_out", "tool_res", injected.alias("injected"), F.col("other").alias("residual"), "compaction")


def reason_word(reason: Column) -> Column:
    """The key of a reason's text; a reason that nobody knows gets the key for unknown ones."""
    return F.when(reason.isin(*NULL_REASONS), reason).otherwise("unknown")


def context_view(compositions: DataFrame, by: list[str]) -> DataFrame:
    """Shares of context over runs, one row for each part in the page's order: (by, position, part, mean, least, most, n).

    compositions: rows of `attribution.composition` with the columns `by`.  Compaction is no part.
    """
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(p).alias("part"), F.col(f"share_{p}").alias("share")) for k, p in enumerate(CONTEXT_PARTS)))
    each = compositions.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
    r4 = lambda c: js_round(c, 4)
    return each.groupBy(*by, "position", "part").agg(r4(F.avg("share")).alias("mean"), r4(F.min("share")).alias("least"), r4(F.max("share")).alias("most"), F.count("*").alias("n"))


def tool_view(usage: DataFrame) -> DataFrame:
    """Calls by kind in the page's order, kinds without calls as zeros: (position, kind, main, side, total).  usage: kind, main, side."""
    spark = usage.sparkSession
    kinds = spark.createDataFrame(list(enumerate(KINDS)), "position int, kind string")
    z = lambda c: F.coalesce(c, F.lit(0))
    return kinds.join(usage, "kind", "left").select("position", "kind", z("main").alias("main"), z("side").alias("side"), (z("main") + z("side")).alias("total"))


def file_view(targets: DataFrame) -> DataFrame:
    """Reads and writes by where they went, calls without a path beside the three places: (op, place, position, count, pathless)."""
    places = ("skillRefs", "workspace", "otherAbsolute")
    rows = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(k).alias("position"), F.col(p).alias("count")) for k, p in enumerate(places)))
    return targets.select("op", F.explode(rows).alias("x"), "pathless").select("op", "x.*", "pathless")


def health_view(experiments: DataFrame) -> DataFrame:
    """Segments of an experiment's health, each known or with its own reason: (id, segment, value, reason).

    experiments: id and, for each segment, its value and, where that is null, a reason in `<segment>_reason`.
    """
    segments = ("cache", "truncation", "sidechain", "self_report", "timeouts")
    rows = F.array(*(F.struct(F.lit(s).alias("segment"), F.col(s).cast("double").alias("value"), F.when(F.col(s).isNull(), reason_word(F.col(f"{s}_reason"))).alias("reason")) for s in segments))
    return experiments.select("id", F.explode(rows).alias("x")).select("id", "x.*")


def stats_state(experiments: DataFrame) -> DataFrame:
    """Adds `state` (legacy, full, error) and `badge` (embedded, backfill or null).  Columns: stats, error, authority."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("authority").isNotNull() | F.col("stats").isNotNull(), "full").otherwise("legacy")
    badge = F.when(F.col("authority").isin("embedded", "authoritative-embedded"), "embedded").when(F.col("authority").isNotNull(), "backfill")
    return experiments.withColumn("state", state).withColumn("badge", badge)


def status_word(status: Column) -> tuple[Column, Column]:
    """(word, tone) of a block's status; statuses to come pass as they are."""
    tone = F.when(status.isin("suspect", "held-out-unknown"), "warn").when(status == "ok", "ok").otherwise("dim")
    return status, tone


def skill_card(installed: DataFrame, triggered: DataFrame, statuses: DataFrame) -> DataFrame:
    """Skills of each experiment: (id, installed, triggered, ratio, never_triggered, not_exercised); the ratio of nothing is null.

    installed, triggered: id, skill; statuses: id, skill, status as of `coverage.untriggered`.
    """
    i, t = installed.select("id", "skill").distinct(), triggered.select("id", "skill").distinct().withColumn("_t", F.lit(1))
    counts = i.join(t, ["id", "skill"], "left").groupBy("id").agg(F.count("*").alias("installed"), F.count("_t").alias("triggered"))
    listed = lambda s: F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("skill"))))
    rest = statuses.groupBy("id").agg(listed("neverTriggered").alias("never_triggered"), listed("notExercised").alias("not_exercised"))
    empty = F.array().cast("array<string>")
    out = counts.join(rest, "id", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select("id", z("installed").alias("installed"), z("triggered").alias("triggered"), ratio(F.col("triggered"), F.col("installed")).alias("ratio"), F.coalesce("never_triggered", empty).alias("never_triggered"), F.coalesce("not_exercised", empty).alias("not_exercised"))


def ref_card(experiments: DataFrame, skills: DataFrame, shared: DataFrame) -> DataFrame:
    """References of each experiment: (id, unknown, reason, shipped, read, unread, shared_reads).

    experiments: id, status, reason and known (whether rows by skill exist at all); skills: id, shipped (null without an
    inventory), read, unread; shared: id, ref of shared fragments that were read.  Without an inventory the number of
    shipped references stays null, however few rows there are, and shared fragments count as read.
    """
    g = skills.groupBy("id").agg(F.sum("shipped").alias("_s"), F.count_if(F.col("shipped").isNull()).alias("_u"), F.sum("read").alias("_r"), F.sum(F.coalesce("unread", F.lit(0))).alias("_d"))
    s = shared.groupBy("id").agg(F.count_distinct("ref").alias("_h"))
    out = experiments.join(g, "id", "left").join(s, "id", "left")
    backfill = F.col("status") == "none-backfill"
    z = lambda c: F.coalesce(c, F.lit(0))
    known = F.col("known")
    shipped = F.when(known & ~backfill & (z("_u") == 0), z("_s"))
    return out.select("id", (~known).alias("unknown"), F.when(~known | backfill, F.col("reason")).alias("reason"), shipped.alias("shipped"), F.when(known, z("_r") + F.when(backfill, z("_h")).otherwise(0)).alias("read"), F.when(known, z("_d")).alias("unread"), F.when(known, z("_h")).alias("shared_reads"))


def ref_rows(coverage: DataFrame, triggers: DataFrame) -> DataFrame:
    """References beside how often they were read where their skill triggered, as x of y cases: (skill, ref, bytes, reads_cases, x, y, blocked).

    coverage: rows of `coverage.ref_coverage`; triggers: case_id, skill.
    """
    y = triggers.groupBy("skill").agg(F.count_distinct("case_id").alias("y"))
    return coverage.join(y, "skill", "left").select("skill", "ref", "bytes", "reads_cases", F.col("cases_co_triggered").alias("x"), F.coalesce("y", F.lit(0)).alias("y"), "blocked")


def top_edges(edges: DataFrame, limit: int = 8) -> DataFrame:
    """The surest directed edges of a proximity matrix: highest confidence, then closeness, then by name."""
    return edges.orderBy(F.desc("confidence"), F.desc("closeness"), "from_type", "from_id", "to_type", "to_id").limit(limit)


def edge_charts(edges: DataFrame) -> dict[str, DataFrame]:
    """Chart data of a proximity matrix: `nodes` (type, id), `cells` (from, to, closeness) and `links` (from, to, confidence, lift)."""
    name = lambda side: F.concat_ws(":", f"{side}_type", f"{side}_id")
    ends = [name("from").alias("from"), name("to").alias("to")]
    nodes = edges.select(F.col("from_type").alias("type"), F.col("from_id").alias("id")).union(edges.select("to_type", "to_id")).distinct()
    return {"nodes": nodes, "cells": edges.select(*ends, "closeness"), "links": edges.select(*ends, "confidence", "lift")}


def graph_charts(nodes: DataFrame, edges: DataFrame, merge: DataFrame, read_rates: DataFrame, owners: DataFrame) -> dict[str, DataFrame]:
    """Chart data of a dependency graph: nodes, edges with `merge` where both ends are in one group, flows, signals.

    nodes: skill, trigger_rate; edges: a, b, rate; merge: component, members; read_rates: ref, numer, advice; owners: ref, skill.
    """
    member = merge.select("component", F.explode("members").alias("skill"))
    a, b = (member.select(F.col("component").alias(f"c{x}"), F.col("skill").alias(x)) for x in ("a", "b"))
    marked = edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", "rate", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("merge"))
    flows = owners.select("ref", "skill").distinct().join(read_rates.filter("numer > 0"), "ref").select(F.col("skill").alias("source"), F.col("ref").alias("target"), F.col("numer").alias("value"))
    signals = merge.select(F.lit("merge").alias("kind"), F.array_join("members", ",").alias("subject"))
    signals = signals.unionByName(read_rates.filter("advice is not null").select(F.col("advice").alias("kind"), F.col("ref").alias("subject")))
    return {"nodes": nodes, "edges": marked, "flows": flows, "signals": signals}

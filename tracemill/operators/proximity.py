"""Order-based mining over runs: temporal proximity, adjacent n-grams, loops."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import PROBES, PROXIMITY
from tracemill.functions.num import js_round
from tracemill.functions.scan import ordered, segment_of


def matrix(events: DataFrame, window: int = PROXIMITY["window"], min_cases: int = PROXIMITY["min_pair_cases"]) -> DataFrame:
    """Directed proximity between nodes of runs: closeness, confidence, lift.

    `events` has run_id, case_id, type, id, ordinal and pos (the order among equal ordinals).  The self-join is an
    equi-join on run and bin of `window + 1` ordinals (each event meets its own and the next bin), so a long run is no
    quadratic group.  Probabilities count distinct cases, so repeats of a case don't inflate them.
    """
    e = events.select("run_id", "case_id", "type", "id", "ordinal", "pos")
    bin_ = F.floor(F.col("ordinal") / (window + 1)).cast("long")
    left = e.select("run_id", F.col("case_id").alias("case_a"), F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.col("ordinal").alias("oa"), F.col("pos").alias("pa"), F.explode(F.array(bin_, bin_ + 1)).alias("bin"))
    right = e.select("run_id", F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.col("ordinal").alias("ob"), F.col("pos").alias("pb"), bin_.alias("bin"))
    after = (F.col("ob") > F.col("oa")) | ((F.col("ob") == F.col("oa")) & (F.col("pb") > F.col("pa")))
    near = left.join(right, ["run_id", "bin"]).filter(after & (F.col("ob") - F.col("oa") <= window) & ~((F.col("from_id") == F.col("to_id")) & (F.col("from_type") == F.col("to_type"))))
    ends = ["from_type", "from_id", "to_type", "to_id"]
    # one pass over the pairs: counts by gap for each run, then everything else from those; gaps are integers, so the
    # weight doesn't depend on the order of rows
    by_gap = [F.count_if(F.col("ob") - F.col("oa") == g).alias(f"_g{g}") for g in range(window + 1)]
    per_run = near.groupBy(*ends, "case_a", "run_id").agg(*by_gap)
    total = per_run.groupBy(*ends).agg(*(F.sum(f"_g{g}").alias(f"_g{g}") for g in range(window + 1)), F.count_distinct("case_a").alias("pair_cases"), F.count_distinct("run_id").alias("runs"))
    weight = sum((F.col(f"_g{g}") / (g + 1.0) for g in range(window + 1)), F.lit(0.0))
    sets = total.select(*ends, weight.alias("weight"), "pair_cases", "runs")
    nodes = e.groupBy("type", "id").agg(F.count("*").alias("occ"), F.count_distinct("case_id").alias("cases"))
    n = e.agg(F.count_distinct("case_id").alias("n_cases"))
    a = nodes.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.col("occ"), F.col("cases").alias("cases_a"))
    b = nodes.select(F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.col("cases").alias("cases_b"))
    out = sets.join(a, ["from_type", "from_id"]).join(b, ["to_type", "to_id"]).crossJoin(F.broadcast(n))  # n: one row
    pa, pb, pab = (F.col(c) / F.col("n_cases") for c in ("cases_a", "cases_b", "pair_cases"))
    lift = F.when((F.col("pair_cases") >= min_cases) & (pa > 0) & (pb > 0), js_round(pab / (pa * pb), 4))
    return out.select(*ends, js_round(F.col("weight") / F.col("occ"), 4).alias("closeness"), js_round(F.when(F.col("cases_a") > 0, F.col("pair_cases") / F.col("cases_a")), 4).alias("confidence"), lift.alias("lift"), "pair_cases", "runs")


def top_pairs(events: DataFrame, window: int = PROXIMITY["window"], limit: int = 8) -> DataFrame:
    """The ordered pairs of nodes that follow each other within `window` ordinals of a run most often: (from_id, to_id, n).

    `events` has run_id, id and ordinal.  Pairs meet through bins of `window + 1` ordinals, as in `matrix`.
    """
    bin_ = F.floor(F.col("ordinal") / (window + 1))
    left = events.select("run_id", F.col("id").alias("from_id"), F.col("ordinal").alias("_a"), F.explode(F.array(bin_, bin_ + 1)).alias("_bin"))
    right = events.select("run_id", F.col("id").alias("to_id"), F.col("ordinal").alias("_b"), bin_.alias("_bin"))
    near = left.join(right, ["run_id", "_bin"]).filter((F.col("_b") - F.col("_a")).between(1, window) & (F.col("from_id") != F.col("to_id")))
    return near.groupBy("from_id", "to_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_id", "to_id").limit(limit)


def ngrams(commands: DataFrame, lengths: tuple[int, ...] = (2, 3), min_cases: int = PROBES["min_cases"]) -> DataFrame:
    """Adjacent command sequences seen in at least `min_cases` distinct cases: (n, seq, distinct_cases, runs).

    `commands` has run_id, case_id, cmd and ord (a total order within the run).  The key is the array of commands.
    """
    w = W.partitionBy("run_id").orderBy("ord")
    parts = commands.select("run_id", "case_id", "cmd", *(F.lead("cmd", k).over(w).alias(f"_{k}") for k in range(1, max(lengths))))
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.array("cmd", *(f"_{k}" for k in range(1, n))).alias("seq")) for n in lengths))
    rows = parts.select("run_id", "case_id", F.explode(grams).alias("g")).filter(~F.exists("g.seq", lambda x: x.isNull()))
    found = rows.groupBy("g.n", "g.seq").agg(F.count_distinct("case_id").alias("distinct_cases"), F.count_distinct("run_id").alias("runs"))
    return found.filter(F.col("distinct_cases") >= min_cases)


def loops(calls: DataFrame, least: int = 4) -> DataFrame:
    """Runs of one tool with equal inputs, or inputs that extend the first: (run_id, type, tool, first_ord, count).

    `calls` has run_id, ord (a whole number), tool, input, is_error.  Equality with the first input of the current island
    depends on where the island began, so calls are folded in order, but only within a stretch of one tool that has `least`
    calls.  Stretches come from a scan in segments; each is sorted within its task and streams by in batches, of which only
    the open island is kept.  Repeated errors of one tool are islands of equal tool and outcome.
    """
    calls = calls.select("run_id", "ord", "tool", F.coalesce("input", F.lit("")).alias("input"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    segment, order = segment_of(F.col("ord")), ["ord"]
    marks = ordered(calls.select("run_id", "ord", "tool", "is_error"), ["run_id"], order, segment, before={"_tool": "tool", "_error": "is_error"})
    turn = F.coalesce(F.col("_tool") != F.col("tool"), F.lit(True))
    marks = marks.withColumn("_t", turn.cast("int")).withColumn("_c", (turn | F.coalesce(F.col("_error") != F.col("is_error"), F.lit(True))).cast("int"))
    marks = ordered(marks, ["run_id"], order, segment, sums={"_s": "_t", "_i": "_c"})
    long = marks.groupBy("run_id", "_s").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    placed = marks.join(long.select("run_id", "_s"), ["run_id", "_s"], "left_semi").select("run_id", "ord", "_s")
    stretches = calls.select("run_id", "ord", "tool", "input").join(placed, ["run_id", "ord"])
    kind = calls.schema["run_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = tool = first = ids = None
        begun = n = 0
        for batch in batches:
            out: list[tuple] = []
            ids = batch.schema.field(0).type
            for run, stretch, at, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (run, stretch) == where and text.startswith(first):
                    n += 1
                    continue
                if n >= least:
                    out.append((where[0], tool, begun, n))
                where, tool, first, begun, n = (run, stretch), name, text, at, 1
            yield from found(out, ids)
        yield from found([(where[0], tool, begun, n)] if n >= least else [], ids)

    def found(rows: list[tuple], ids: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = (ids, pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["run_id", "tool", "first_ord", "count"])

    in_order = stretches.select("run_id", "_s", F.col("ord").cast("long").alias("ord"), "tool", "input").repartition("run_id", "_s").sortWithinPartitions("run_id", "_s", "ord")
    same_input = in_order.mapInArrow(fold, f"run_id {kind}, tool string, first_ord long, count long").select("run_id", F.lit("identical-input").alias("type"), "tool", "first_ord", "count")
    errors = marks.filter("is_error").groupBy("run_id", "_i", "tool").agg(F.min("ord").cast("long").alias("first_ord"), F.count("*").alias("count")).filter(F.col("count") >= least)
    return same_input.unionByName(errors.select("run_id", F.lit("repeated-error").alias("type"), "tool", "first_ord", "count"))

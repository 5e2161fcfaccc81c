"""Why a run's context grew: deltas of the footprint, split over what came in between two rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import js_round


def run_items(rounds: DataFrame, user_events: DataFrame) -> DataFrame:
    """Per round after a run's first: delta, prev_out, tool_res, injected_user, injected_harness, skill_body, other, compaction.

    rounds: run_id, seq, ts, footprint, out, result_chars (of its tool results), compact_before;
    user_events: run_id, ts, pos, chars, src_kind.  Rounds come before events of the same time.
    """
    r = rounds.select("run_id", F.coalesce("ts", F.lit("")).alias("ts"), F.lit(0).alias("kind"), F.col("seq").alias("pos"), "seq", "footprint", "out", "result_chars", "compact_before", F.lit(0).alias("chars"), F.lit(None).cast("string").alias("src_kind"))
    u = user_events.select("run_id", F.coalesce("ts", F.lit("")).alias("ts"), F.lit(1).alias("kind"), F.col("pos"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("footprint"), F.lit(None).cast("long").alias("out"), F.lit(None).cast("long").alias("result_chars"), F.lit(None).cast("boolean").alias("compact_before"), "chars", "src_kind")
    w = W.partitionBy("run_id").orderBy("ts", "kind", "pos")
    items = r.unionByName(u).withColumn("_next", F.sum((F.col("kind") == 0).cast("int")).over(w))
    # events belong to the round that follows them
    slot = F.when(F.col("kind") == 0, F.col("_next")).otherwise(F.col("_next") + 1)
    chars = lambda *kinds: F.sum(F.when((F.col("kind") == 1) & F.coalesce("src_kind", F.lit("user")).isin(*kinds), F.col("chars")).otherwise(0))
    one = lambda c: F.max(F.when(F.col("kind") == 0, F.col(c)))
    by = items.groupBy("run_id", slot.alias("_slot")).agg(
        one("seq").alias("seq"), one("footprint").alias("footprint"), one("out").alias("out"), one("result_chars").alias("result_chars"), one("compact_before").alias("compact_before"),
        chars("user").alias("_user"), chars("attachment", "tool-result-side", "meta-injected").alias("_harness"), chars("skill-body").alias("_body"),
    ).filter("seq is not null")
    v = W.partitionBy("run_id").orderBy("_slot")
    quarter = lambda c: F.floor(c / 4 + 0.5).cast("long")
    out = by.select(
        "run_id", "seq", "footprint", "compact_before",
        (F.col("footprint") - F.lag("footprint").over(v)).alias("delta"), F.lag("out").over(v).alias("prev_out"), quarter(F.lag("result_chars").over(v)).alias("tool_res"),
        quarter(F.col("_user")).alias("injected_user"), quarter(F.col("_harness")).alias("injected_harness"), quarter(F.col("_body")).alias("skill_body"), F.lag("seq").over(v).alias("_prev"),
    )
    out = out.filter("_prev is not null").drop("_prev").withColumn("other", F.col("delta") - F.col("prev_out") - F.col("tool_res") - F.col("injected_user") - F.col("injected_harness") - F.col("skill_body"))
    return out.withColumn("compaction", F.when(F.col("other") < 0, F.when(F.col("compact_before"), "confirmed").otherwise("inferred")))


PARTS = ("prev_out", "tool_res", "injected_user", "injected_harness", "skill_body", "other")


def composition(rounds: DataFrame, items: DataFrame) -> DataFrame:
    """Per run: baseline (first footprint above 0), positive parts, their shares, and what compaction took back."""
    base = rounds.filter("footprint > 0").groupBy("run_id").agg(F.min_by("footprint", "seq").alias("baseline"), F.min("seq").alias("_first"))
    last = rounds.groupBy("run_id").agg(F.max_by("footprint", "seq").alias("final_footprint"), F.count_if(~F.coalesce(F.col("footprint") > 0, F.lit(False))).alias("skipped_rounds")).filter("final_footprint > 0")
    grown = items.join(base.select("run_id", "_first"), "run_id").filter((F.col("footprint") > 0) & (F.col("seq") > F.col("_first")))
    parts = grown.groupBy("run_id").agg(*(F.sum(F.greatest(F.lit(0), F.col(p))).alias(p) for p in PARTS), F.sum(F.greatest(F.lit(0), -F.col("other"))).alias("compaction"))
    out = base.join(last, "run_id").join(parts, "run_id", "left").na.fill(0, [*PARTS, "compaction"])
    out = out.withColumn("denominator", F.col("baseline") + sum((F.col(p) for p in PARTS), F.lit(0)))
    shares = [js_round(F.col(p) / F.col("denominator"), 4).alias(f"share_{p}") for p in ("baseline", *PARTS)]
    return out.select("run_id", "baseline", *PARTS, "compaction", "denominator", "final_footprint", "skipped_rounds", *shares)


def contributions(items: DataFrame) -> DataFrame:
    """The parts of each round's delta, largest first, the residual signed."""
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("tokens")) for p in PARTS))
    return items.select("run_id", "seq", F.array_sort(parts, lambda a, b: F.when(a["tokens"] > b["tokens"], -1).when(a["tokens"] < b["tokens"], 1).when(a["part"] < b["part"], -1).otherwise(1)).alias("parts"))

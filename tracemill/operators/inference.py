"""Statistical comparison: bootstrap intervals, false-discovery control, arms, verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import VERDICT
from tracemill.functions.num import equiv_tokens, js_round, ratio, two_proportion
from tracemill.functions.scan import ordered
from tracemill.storage import written

#: Units whose values may be broadcast (16 bytes each), units of a packed bin, draws of a task.
UNITS, BIN, DRAWS = 8_000_000, 1_000_000, 20_000_000


def placed_units(units: DataFrame, by: list[str], order: str, total: str, count: str) -> DataFrame:
    """(_g, _pos, _t, _c): units with their group's name and their place in its order, from 0.

    Units are dealt by ranges of their order and written once with the number of their range; places within a range and
    the sizes of the ranges before it give places in the group, so no task ranks a whole group.
    """
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    own = units.select(name.alias("_g"), F.col(order).alias("_o"), F.col(total).cast("double").alias("_t"), F.col(count).cast("long").alias("_c"))
    ranged = written(own.repartitionByRange("_g", "_o").withColumn("_part", F.spark_partition_id()), "units")
    return ordered(ranged, ["_g"], ["_o"], F.col("_part"), number="_n").select("_g", (F.col("_n") - 1).alias("_pos"), "_t", "_c")


def bootstrap(units: DataFrame, by: list[str], order: str, total: str, count: str, iters: int = VERDICT["iters"], seed: int = VERDICT["seed"], level: float = VERDICT["level"]) -> DataFrame:
    """Percentile interval of the pooled mean under resampling of units: (by, lo, hi, mean, n).

    A unit carries its sum and count, so single differences (count 1) and clusters are alike.  `order` pins which unit
    a draw means; draw b * n + i + 1 of the generator picks the i-th unit of resample b, and each group restarts it.
    Draws are made from the counter, without state, in the tasks of their resamples, where they are summed; a draw is never
    a row.  Values travel as packed bins of consecutive units: while units number `UNITS` at most they are broadcast; beyond,
    each bin meets each stretch of resamples, whose draws are made once for each bin and counted where they fall into it.
    """
    spark = units.sparkSession
    named = units.select(*by, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_g") if by else F.lit("").alias("_g"), F.col(total).cast("double").alias("_t"), F.col(count).cast("long").alias("_c"))
    sizes = written(named.groupBy("_g", *by).agg(F.count("*").alias("_n"), F.sum("_t").alias("_sum"), F.sum("_c").alias("_cnt")), "sizes")
    placed = placed_units(units, by, order, total, count).withColumn("_bin", F.floor(F.col("_pos") / BIN))

    def pack(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column("_pos").to_numpy())
        t, c = (group.column(k).to_numpy()[at] for k in ("_t", "_c"))
        one = group.slice(0, 1)
        return pa.table({"_g": one["_g"], "_bin": one["_bin"], "_ts": pa.array([t.astype(np.float64).tobytes()], pa.binary()), "_cs": pa.array([c.astype(np.int64).tobytes()], pa.binary())})

    packs = placed.groupBy("_g", "_bin").applyInArrow(pack, "_g string, _bin long, _ts binary, _cs binary")
    few = (sizes.agg(F.sum("_n").alias("n")).first().n or 0) <= UNITS
    # resamples of a task: enough tasks for all cores, but not too many draws for one
    step = F.greatest(F.lit(1), F.least(F.lit(-(-iters // (4 * spark.sparkContext.defaultParallelism))), (F.lit(DRAWS) / F.col("_n")).cast("int")))
    chunks = sizes.select("_g", "_n", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(iters - 1), step)).alias("_from"))
    chunks = chunks.repartition(4 * spark.sparkContext.defaultParallelism, "_g", "_from")
    width = BIN

    def summed(n: int, first: int, last: int, base: int, ts: np.ndarray, cs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of resamples first .. last - 1 over the units from `base` on."""
        sums, counts = np.zeros(last - first), np.zeros(last - first, np.int64)
        rows = max(1, 1_000_000 // n)
        for b in range(first, last, rows):
            top = min(last, b + rows)
            for k in range(b * n, top * n, 4_000_000):
                end = min(top * n, k + 4_000_000)
                x = (np.arange(k + 1, end + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) + np.uint64(seed & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF)
                x ^= x >> np.uint64(16)
                x = (x * np.uint64(0x21F0AAAD)) & np.uint64(0xFFFFFFFF)
                x ^= x >> np.uint64(15)
                x = (x * np.uint64(0x735A2D97)) & np.uint64(0xFFFFFFFF)
                x ^= x >> np.uint64(15)
                pos = np.floor(x / 4294967296.0 * n).astype(np.int64) - base
                own = np.arange(k, end) // n - first
                if base or len(ts) < n:
                    inside = (pos >= 0) & (pos < len(ts))
                    pos, own = pos[inside], own[inside]
                sums += np.bincount(own, ts[pos], last - first)
                counts += np.bincount(own, cs[pos], last - first).astype(np.int64)
        return sums, counts

    out = "_g string, _b int, _s double, _k long"

    def rows(g: str, first: int, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g] * len(sums)), pa.array(np.arange(first, first + len(sums), dtype=np.int32)), pa.array(sums), pa.array(counts)], ["_g", "_b", "_s", "_k"])

    if few:
        held: dict[str, list[tuple[int, bytes, bytes]]] = {}
        for r in packs.collect():  # 16 bytes a unit
            held.setdefault(r["_g"], []).append((r["_bin"], bytes(r["_ts"]), bytes(r["_cs"])))
        shared = spark.sparkContext.broadcast({g: tuple(b"".join(x[k] for x in sorted(v)) for k in (1, 2)) for g, v in held.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, n, each, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ts, cs = shared.value[g]
                    yield rows(g, first, *summed(n, first, min(iters, first + each), 0, np.frombuffer(ts), np.frombuffer(cs, np.int64)))

        parts = chunks.mapInArrow(run, out)
    else:

        def run_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(k, 1) for whole in batches for k in range(whole.num_rows)):
                g, n, each, first, place, ts, cs = (c[0].as_py() for c in batch.columns)
                yield rows(g, first, *summed(n, first, min(iters, first + each), place * width, np.frombuffer(ts), np.frombuffer(cs, np.int64)))

        parts = chunks.join(written(packs, "packs"), "_g").select("_g", "_n", "_step", "_from", "_bin", "_ts", "_cs").mapInArrow(run_bins, out)
    means = parts.groupBy("_g", "_b").agg((F.sum("_s") / F.sum("_k")).alias("_mean"))
    ranked = means.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("_mean")) - 1)  # `iters` rows a group
    alpha = (1 - level) / 2
    low, high = int(alpha * iters + 1e-9), min(iters - 1, int(-(-(1 - alpha) * iters // 1)) - 1)
    pick = lambda at: F.max(F.when(F.col("_r") == at, F.col("_mean")))
    ends = ranked.groupBy("_g").agg(js_round(pick(low)).alias("lo"), js_round(pick(high)).alias("hi"))
    return ends.join(sizes, "_g").select(*by, "lo", "hi", js_round(F.col("_sum") / F.col("_cnt")).alias("mean"), F.col("_n").alias("n"))


def benjamini_hochberg(tests: DataFrame, p: str, q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adds `rejected`: step-up control of the false discovery rate within a family (`by`); null p-values are not rejected.

    Equal p-values are one row with their count.  A running count over bins of values, and one within each bin, rank
    them, so no task sorts a whole family.
    """
    by = by or []
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    values = tests.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_bin", F.floor(F.least(F.lit(1.0), F.col("_p")) * 1024))
    bins = values.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c"))
    before = bins.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(*by, F.lit(0)).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_m", F.sum("_c").over(W.partitionBy(*by, F.lit(0)))).drop("_c")
    within = values.withColumn("_k", F.sum("_c").over(W.partitionBy(*by, "_bin").orderBy("_p")))
    ranked = within.alias("a").join(before.alias("b"), reduce(lambda x, y: x & y, same("a", "b")) & (F.col("a._bin") == F.col("b._bin"))).select(*(F.col(f"a.{c}") for c in by), "_p", (F.col("_k") + F.col("_before")).alias("_k"), "_m")
    cut = ranked.groupBy(*by).agg(F.max(F.when(F.col("_p") <= F.col("_k") / F.col("_m") * q, F.col("_p"))).alias("_cut"))
    joined = tests.alias("a").join(F.broadcast(cut).alias("b"), reduce(lambda x, y: x & y, same("a", "b")), "left")
    return joined.select("a.*", F.coalesce(F.col(f"a.{p}") <= F.col("_cut"), F.lit(False)).alias("rejected"))


def non_inferior(low: Column, delta: float = VERDICT["delta_pp"]) -> Column:
    """Strictly above the margin; unknown fails."""
    return F.coalesce(low > -delta, F.lit(False))


def aggregate_arm(reps: DataFrame, by: list[str]) -> DataFrame:
    """Per arm: quality and cost over non-excluded repeats, incomplete flows over all attempted ones.

    Columns read: excluded, l1_pass, l2_pass, l3_pass, rounds, duration_ms, flow_status, u_in, u_out, u_cache_r, u_cache_w.
    """
    valid = ~F.coalesce("excluded", F.lit(False))
    rate = lambda c: js_round(F.avg(F.when(valid & F.col(c).isNotNull(), F.col(c).cast("int"))))
    tokens = F.when(valid & F.col("u_in").isNotNull(), equiv_tokens(F.col("u_in"), F.col("u_out"), F.col("u_cache_r"), F.col("u_cache_w")))
    incomplete = F.count_if(F.col("flow_status") == "incomplete")
    return reps.groupBy(*by).agg(
        F.count_if(valid).alias("n"),
        F.count("*").alias("attempted"),
        F.count_if(~valid).alias("excluded_repeats"),
        rate("l1_pass").alias("l1_rate"), rate("l2_pass").alias("l2_rate"), rate("l3_pass").alias("l3_rate"),
        js_round(F.avg(F.when(valid, F.col("rounds")))).alias("mean_turns"),
        js_round(F.avg(tokens)).alias("mean_equiv_tokens"),
        js_round(F.avg(F.when(valid, F.col("duration_ms") / 1000.0))).alias("mean_seconds"),
        incomplete.alias("flow_incomplete"),
        js_round(ratio(incomplete, F.count("*"))).alias("flow_rate"),
    )


def compare_flow(x_new: Column, n_new: Column, x_base: Column, n_base: Column, alpha: float = 0.05) -> list[Column]:
    """regressed, delta_rate, z, p_value for incomplete flows; false and nulls if a side has no attempts."""
    z, p = two_proportion(x_new, n_new, x_base, n_base)
    return [
        F.coalesce((z > 0) & (p < alpha), F.lit(False)).alias("regressed"),
        js_round(ratio(x_new, n_new) - ratio(x_base, n_base)).alias("delta_rate"),
        js_round(z).alias("z"),
        p.alias("p_value"),
    ]


def decide(rows: DataFrame) -> DataFrame:
    """Adds `verdict` and `established`: too few pairs, then too many exclusions, then the intent's own rule.

    Columns read: intent, pairs, exclusion_pct, l1_low, l2_low, l3_low, flow_regressed, any_cost_down, any_cost_up,
    l1_up, l2_up, l3_up (significant changes), target (the quality axis to improve, or null).
    """
    quality = (F.col("l1_low").isNull() | non_inferior(F.col("l1_low"))) & (F.col("l2_low").isNull() | non_inferior(F.col("l2_low"))) & (F.col("l3_low").isNull() | non_inferior(F.col("l3_low")))
    flow_ok, down, up = ~F.coalesce("flow_regressed", F.lit(False)), F.coalesce("any_cost_down", F.lit(False)), F.coalesce("any_cost_up", F.lit(False))
    raised = {a: F.coalesce(f"{a}_up", F.lit(False)) for a in ("l1", "l2", "l3")}
    target = F.coalesce("target", F.when(raised["l1"], "l1").when(raised["l2"], "l2").when(raised["l3"], "l3"))
    target_up = F.coalesce(F.when(target == "l1", raised["l1"]).when(target == "l2", raised["l2"]).when(target == "l3", raised["l3"]), F.lit(False))
    held = F.when(F.col("intent") == "cost-opt", quality & flow_ok & down & ~up).when(F.col("intent") == "quality-fix", target_up & ~up & flow_ok).otherwise(quality & flow_ok & ~up)
    few, many = F.col("pairs") < VERDICT["min_pairs"], F.col("exclusion_pct") > VERDICT["tripwire_pct"]
    return rows.withColumn("verdict", F.when(few, "insufficient-data").when(many, "inconclusive").otherwise(F.col("intent"))).withColumn("established", ~few & ~many & held)


def per_skill(units: DataFrame, iters: int = VERDICT["iters"], seed: int = VERDICT["seed"]) -> DataFrame:
    """Per skill from (skill, case_id, delta): cluster bootstrap over cases, badge, and significance after correction."""
    clusters = units.groupBy("skill", "case_id").agg(F.sum("delta").alias("_s"), F.count("delta").alias("_c"))
    sizes = clusters.groupBy("skill").agg(F.count("*").alias("n_cases"), js_round(F.sum("_s") / F.sum("_c")).alias("mean"))
    enough = clusters.join(sizes.filter(F.col("n_cases") >= VERDICT["min_pairs_skill"]).select("skill"), "skill", "left_semi")
    ci = bootstrap(enough, ["skill"], "case_id", "_s", "_c", iters, seed).select("skill", "lo", "hi")
    p = F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), 1.0).otherwise(0.01)
    tested = benjamini_hochberg(ci.withColumn("p_value", p), "p_value").withColumnRenamed("rejected", "significant")
    badge = F.when(F.col("n_cases") < VERDICT["min_pairs_skill"], "insufficient-data").when(F.col("n_cases") <= 7, "reference-only").otherwise("ok")
    return sizes.join(tested, "skill", "left").select("skill", "n_cases", badge.alias("badge"), "mean", "lo", "hi", "p_value", F.coalesce("significant", F.lit(False)).alias("significant"))


def regressed_clusters(cases: DataFrame) -> DataFrame:
    """Regressed cases by skill and category: (cluster, case_ids)."""
    key = F.concat(F.coalesce("skill", F.lit("unknown")), F.lit("×"), F.coalesce("category", F.lit("uncategorized")))
    return cases.filter("regressed").groupBy(key.alias("cluster")).agg(F.sort_array(F.collect_list("case_id")).alias("case_ids"))

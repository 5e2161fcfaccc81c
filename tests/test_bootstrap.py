"""Intervals against a plain resampling, with values broadcast and in bins, and ranks from ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import inference


def draw(k, seed):
    a = (seed + k * 0x9E3779B9) & 0xFFFFFFFF
    t = a ^ a >> 16
    t = t * 0x21F0AAAD & 0xFFFFFFFF
    t ^= t >> 15
    t = t * 0x735A2D97 & 0xFFFFFFFF
    return (t ^ t >> 15) / 4294967296.0


def brute(units, iters, seed):
    """units: (total, count) in order."""
    n = len(units)
    means = []
    for b in range(iters):
        own = [units[int(draw(b * n + i + 1, seed) * n)] for i in range(n)]
        means.append(sum(t for t, _ in own) / sum(c for _, c in own))
    means.sort()
    return means[int(0.025 * iters + 1e-9)], means[min(iters - 1, int(-(-0.975 * iters // 1)) - 1)]


@pytest.mark.parametrize("bounds", [(8_000_000, 1_000_000), (0, 1_000_000), (0, 7), (8_000_000, 7)])
def test_interval(spark, monkeypatch, bounds):
    monkeypatch.setattr(inference, "UNITS", bounds[0])
    monkeypatch.setattr(inference, "BIN", bounds[1])
    rng = random.Random(1)
    groups = {"a": [(rng.randrange(-50, 50), rng.randrange(1, 4)) for _ in range(60)], "b": [(5, 1)], None: [(rng.randrange(9), 1) for _ in range(23)]}
    rows = [(g, f"k{i:03d}", t, c) for g, units in groups.items() for i, (t, c) in enumerate(units)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k string, t long, c long").repartition(3)
    got = {r.g: r for r in inference.bootstrap(df, ["g"], "k", "t", "c", iters=200, seed=77).collect()}
    assert got.keys() == groups.keys()
    for g, units in groups.items():
        lo, hi = brute(units, 200, 77)
        assert (got[g].lo, got[g].hi) == (pytest.approx(lo, abs=6e-4), pytest.approx(hi, abs=6e-4)) and got[g].n == len(units)


def test_places_come_from_ranges(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).alias("o"), F.lit(1).alias("t"), F.lit(1).alias("c"))
    placed = inference.placed_units(df.withColumn("t", F.col("o")), ["g"], "o", "t", "c")
    assert placed.filter("_pos <> cast(_t as long)").count() == 0 and placed.count() == 5000
    for line in placed._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Window [row_number" not in line or "_seg" in line


def test_no_units(spark):
    df = spark.createDataFrame([], "g string, k string, t long, c long")
    assert inference.bootstrap(df, ["g"], "k", "t", "c", iters=10).count() == 0

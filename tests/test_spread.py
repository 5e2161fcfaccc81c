"""A task's share of rows doesn't grow with the table, and dealing rows to more tasks changes no result."""

from pyspark.sql import functions as F

from tracemill.operators import graph
from tracemill.plans import bindings


def test_more_rows_more_tasks_same_rows(spark, sf_dir, monkeypatch):
    before = sorted(map(tuple, bindings.events(spark, sf_dir).select("event_id", "ordinal").collect()))
    n = len(before)
    share = n // (3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(bindings, "TASK_ROWS", share)
    dealt = bindings.events(spark, sf_dir).select("event_id", "ordinal")
    assert dealt.rdd.getNumPartitions() >= n // share
    assert sorted(map(tuple, dealt.collect())) == before


def test_sessions_dealt_once(spark):
    observed = spark.range(60).select((F.col("id") % 5).cast("string").alias("session"), F.concat(F.lit("s"), F.col("id") % 4).alias("skill"), (F.col("id") / 9).cast("int").alias("round"), F.col("id").alias("ordinal"))
    declared = observed.filter("ordinal % 3 = 0").select("session", F.concat(F.lit("d-"), "skill").alias("skill"), "round")
    plain, dealt = graph.session_events(observed, declared), graph.session_events(observed, declared, 7)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert dealt.rdd.getNumPartitions() == 7

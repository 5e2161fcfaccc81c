"""The test tables in the shapes that the operators read, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.storage import written

#: A name that stands for the round half up of both engines: SQL text for floor(x * 10^k + 0.5) / 10^k.
def r(x: str, k: int = 3) -> str:  # noqa: E302
    return f"(floor(CAST({x} AS DOUBLE) * 1e{k} + 0.5) / 1e{k})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table that a task sorts or groups at once, about.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Tasks for so many rows; None where Spark's own number is enough."""
    return -(-rows // TASK_ROWS) if rows > int(spark.conf.get("spark.sql.shuffle.partitions")) * TASK_ROWS else None


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """`df` dealt by `cols` to as many tasks as `rows` ask for, so that a task's share doesn't grow with the table."""
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *cols) if n else df


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a run's tool calls: a run is a user's day."""
    e = table(spark, sf, "events")
    n = e.count()
    e = e.withColumn("run_id", F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    w = W.partitionBy("run_id").orderBy("ts", "event_id")
    return spread(e, n, "run_id").withColumn("ordinal", F.row_number().over(w) - 1)


EVENTS = """ev AS (SELECT *, CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS run_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS ordinal FROM events)"""


def reps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a task's repeats: the customer is the task, the status the outcome."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("task_id"), F.row_number().over(w).alias("repeat"), (F.col("o_orderstatus") == "P").alias("excluded"), ((F.col("o_orderstatus") != "P") & (k % 11 == 0)).alias("failed"),
        (F.col("o_orderstatus") == "F").cast("int").alias("C"), F.when(k % 6 != 0, (k % 9) / 8.0).alias("P"), F.when(k % 4 != 0, (k % 5) / 4.0).alias("H"), F.when(k % 5 != 0, k % 2 == 0).alias("activated"),
        F.when(k % 13 == 0, "incomplete").otherwise("complete").alias("flow_status"), F.when(F.to_date("o_orderdate") < "1998-05-01", "old").otherwise("new").alias("arm"),
        k.alias("order_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
        F.when(k % 8 != 0, k % 3 != 0).alias("l1_pass"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("l2_pass"), F.when(k % 2 == 0, k % 7 != 0).alias("l3_pass"),
        (k % 12 + 1).alias("rounds"), ((k % 1000) * 250).alias("duration_ms"), F.when(k % 9 != 0, k % 500).alias("u_in"), (k % 70).alias("u_out"), ((k % 40) * 10).alias("u_cache_r"), ((k % 30) * 4).alias("u_cache_w"),
    )


REPS = """reps AS (SELECT o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS repeat,
  o_orderstatus = 'P' AS excluded, o_orderstatus <> 'P' AND o_orderkey % 11 = 0 AS failed, CAST(o_orderstatus = 'F' AS INTEGER) AS C,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) / 8 END AS P, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) / 4 END AS H,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS activated, CASE WHEN o_orderkey % 13 = 0 THEN 'incomplete' ELSE 'complete' END AS flow_status,
  CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-05-01' THEN 'old' ELSE 'new' END AS arm, o_orderkey AS order_id, o_orderpriority AS priority, o_orderdate AS created_at, o_totalprice AS price,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 3 <> 0 END AS l1_pass, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS l2_pass, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 <> 0 END AS l3_pass,
  o_orderkey % 12 + 1 AS rounds, (o_orderkey % 1000) * 250 AS duration_ms, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 500 END AS u_in, o_orderkey % 70 AS u_out, (o_orderkey % 40) * 10 AS u_cache_r, (o_orderkey % 30) * 4 AS u_cache_w
  FROM orders)"""

WILSON = lambda s, n: (
    f"CASE WHEN {n} = 0 THEN 0e0 ELSE {r(f'greatest(0e0, (({s}/CAST({n} AS DOUBLE)) + 3.8416e0/(2*CAST({n} AS DOUBLE)) - 1.96e0*sqrt((({s}/CAST({n} AS DOUBLE))*(1-({s}/CAST({n} AS DOUBLE))) + 3.8416e0/(4*CAST({n} AS DOUBLE)))/CAST({n} AS DOUBLE)))/(1+3.8416e0/CAST({n} AS DOUBLE)))')} END",
    f"CASE WHEN {n} = 0 THEN 0e0 ELSE {r(f'least(1e0, (({s}/CAST({n} AS DOUBLE)) + 3.8416e0/(2*CAST({n} AS DOUBLE)) + 1.96e0*sqrt((({s}/CAST({n} AS DOUBLE))*(1-({s}/CAST({n} AS DOUBLE))) + 3.8416e0/(4*CAST({n} AS DOUBLE)))/CAST({n} AS DOUBLE)))/(1+3.8416e0/CAST({n} AS DOUBLE)))')} END",
)


def baskets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sessions: (triggers: session, skill = brand), (reads: session, skill, ref = container-like type)."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("p_partkey"))
    pa = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("skill"), F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("ref"))
    n = li.count()
    # each basket is one row, and a basket's rows meet in one task; the operators read both results several times
    j = spread(li, n, "p_partkey").join(pa, "p_partkey").withColumn("counts", F.col("p_partkey") % 3 != 0).select("session", "skill", "ref", "counts")
    of = written(spread(j, n, "session").groupBy("session", "skill", "ref").agg(F.bool_or("counts").alias("counts")), "baskets")
    of = spread(of, n, "session")
    return of.select("session", "skill").distinct(), of.filter("counts").select("session", "skill", "ref")


BASKETS = """j AS (SELECT l_orderkey AS session, p_partkey, p_brand AS skill, p_brand || '/' || CAST(p_size % 4 AS VARCHAR) AS ref FROM lineitem JOIN part ON l_partkey = p_partkey),
triggers AS (SELECT DISTINCT session, skill FROM j), reads AS (SELECT DISTINCT session, skill, ref FROM j WHERE p_partkey % 3 <> 0)"""

"""Search, trends over time, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(rows: DataFrame, text: str, order: str, query: str, around: int = 40, limit: int = 50) -> DataFrame:
    """Case-insensitive substring search with snippets; queries of one character find nothing; at most `limit`, by `order`."""
    q = query.strip()
    if len(q) < 2:
        return rows.limit(0).withColumn("snippet", F.lit(""))
    at = F.locate(q.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at - 1 + len(q) + around)
    body = F.regexp_replace(F.substring(F.col(text), begin, end - begin + 1), r"\s+", " ")
    snippet = F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return rows.filter(at > 0).withColumn("snippet", snippet).orderBy(order).limit(limit)


def segments(reports: DataFrame) -> DataFrame:
    """Adds `segment`: contiguous stretches of one lineage within a cohort, in order of time.  reports: cohort, lineage, created_at, id."""
    w = W.partitionBy("_c").orderBy("created_at", "id")
    rows = reports.withColumn("_c", F.coalesce("cohort", F.lit("default"))).withColumn("_l", F.coalesce("lineage", F.lit("default")))
    change = F.when(F.lag("_l").over(w) == F.col("_l"), 0).otherwise(1)
    return rows.withColumn("_n", change).withColumn("segment", F.sum("_n").over(w)).drop("_c", "_l", "_n")


def segment_cases(reports: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases present in every report of a segment, with their values in order: (cohort, segment, case_id, deltas).

    reports: cohort, segment, id, created_at; cases: id, case_id, delta.
    """
    n = reports.groupBy("cohort", "segment").agg(F.count_distinct("id").alias("n"))
    points = reports.join(cases, "id").groupBy("cohort", "segment", "case_id").agg(F.count_distinct("id").alias("k"), F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "delta"))), lambda x: x["delta"]).alias("deltas"))
    return points.join(n, ["cohort", "segment"]).filter("k = n").select("cohort", "segment", "case_id", "deltas")


def previous(reports: DataFrame, by: list[str]) -> DataFrame:
    """Adds `prev_id`: the newest earlier report of the same kind."""
    return reports.withColumn("prev_id", F.lag("id").over(W.partitionBy(*by).orderBy("created_at", "id")))


def prune(items: DataFrame, by: list[str], now_ms: int, older_than_ms: int | None = None, most: int | None = None) -> DataFrame:
    """Items to delete: too old, or beyond the newest `most`.  items: id, ts_ms."""
    old = F.lit(False) if older_than_ms is None else F.coalesce((F.lit(now_ms) - F.col("ts_ms")) > older_than_ms, F.lit(False))
    if most is None:
        return items.filter(old)
    # the newest `most` of 64 slices, then of those; what is not among them goes, and no task ranks all items
    newest = [F.desc("ts_ms"), F.asc("id")]
    slice_ = items.select(*by, "id", "ts_ms", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_s"))
    some = slice_.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy(*newest))).filter(F.col("_r") <= most)
    kept = some.withColumn("_r", F.row_number().over(W.partitionBy(*by, F.lit(0)).orderBy(*newest))).filter(F.col("_r") <= most)
    marked = items.join(kept.select("id", F.lit(True).alias("_kept")).distinct(), "id", "left")
    return marked.filter(old | F.col("_kept").isNull()).drop("_kept")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value by key; a change replaces what was there."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)

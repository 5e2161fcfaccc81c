"""Ordered scans in segments: numbers, neighbours and running sums over long groups without a window that spans one.

A window function over a whole group puts it in one task.  Here rows are cut into segments of their order; windows run
within segments, and one row a segment (its count, its first and last values, its sums) carries on what goes from one
segment to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Low bits of an order that one segment spans.
BITS = 12


def segment_of(order: Column, bits: int | None = None) -> Column:
    """The segment of a whole-number order: its high bits."""
    return F.shiftright(order.cast("long"), BITS if bits is None else bits)


def ordered(df: DataFrame, by: list[str], order: list[str], segment: Column, number: str | None = None, after: dict[str, str] | None = None, before: dict[str, str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """`df` with columns over the rows of a group (`by`, nulls are a group) in `order`, which tells them apart.

    `segment` must not fall as the order grows.  `number` names the row's place from 1; `after` and `before` map new
    names to columns whose value in the next or the previous row they hold (null at the ends); `sums` maps new names to
    columns that are added up to and with the row.
    """
    after, before, sums = after or {}, before or {}, sums or {}
    keys = [*by, "_seg"]
    w = W.partitionBy(*keys).orderBy(*order)
    own = df.withColumn("_seg", segment).withColumn("_k", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    for new, of in after.items():
        own = own.withColumn(f"_in_{new}", F.lead(of).over(w))
    for new, of in before.items():
        own = own.withColumn(f"_in_{new}", F.lag(of).over(w))
    for new, of in sums.items():
        own = own.withColumn(f"_in_{new}", F.sum(of).over(w))
    at = F.struct(*order)
    heads = own.groupBy(*keys).agg(
        F.count("*").alias("_n"), *(F.min_by(of, at).alias(f"_x_{new}") for new, of in after.items()), *(F.max_by(of, at).alias(f"_x_{new}") for new, of in before.items()), *(F.sum(of).alias(f"_x_{new}") for new, of in sums.items())
    )
    ws = W.partitionBy(*by).orderBy("_seg")
    earlier = ws.rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(
        *(F.col(c).alias(f"_by_{c}") for c in keys), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        *(F.lead(f"_x_{new}").over(ws).alias(f"_out_{new}") for new in after), *(F.lag(f"_x_{new}").over(ws).alias(f"_out_{new}") for new in before), *(F.sum(f"_x_{new}").over(earlier).alias(f"_out_{new}") for new in sums),
    )
    same = reduce(lambda a, b: a & b, (own[c].eqNullSafe(heads[f"_by_{c}"]) for c in keys))
    out = own.join(heads, same)
    if number:
        out = out.withColumn(number, F.col("_k") + F.col("_off"))
    for new in after:
        out = out.withColumn(new, F.when(F.col("_last"), F.col(f"_out_{new}")).otherwise(F.col(f"_in_{new}")))
    for new in before:
        out = out.withColumn(new, F.when(F.col("_k") == 1, F.col(f"_out_{new}")).otherwise(F.col(f"_in_{new}")))
    for new in sums:
        out = out.withColumn(new, F.coalesce(f"_in_{new}", F.lit(0)) + F.coalesce(f"_out_{new}", F.lit(0)))
    return out.select(*df.columns, *([number] if number else []), *after, *before, *sums)

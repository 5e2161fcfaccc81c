"""Splits of skills by category: the query on tables made by hand, and both forms of the operator."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tracemill.operators import graph
from tracemill.plans import catalogue

NAME = "d9_jaccard_split"


def put(spark, path, suppliers, orders, lines):
    """suppliers (key, nation), orders (key, priority), lines (order, part, supplier)."""
    for name, rows, kind in (
        ("supplier", suppliers, "s_suppkey long, s_nationkey long"),
        ("orders", orders, "o_orderkey long, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long"),
    ):
        pq.write_table(spark.createDataFrame(rows, kind).toArrow(), f"{path}/{name}.parquet")
    return str(path)


def result(spark, sf):
    assert oracle.compare(spark, sf, catalogue.QUERIES[NAME], catalogue.ORACLE_SQL[NAME]) is None
    return {r.skill: r for r in catalogue.QUERIES[NAME](spark, sf).collect()}


def test_every_part_is_a_ref_of_its_own(spark, tmp_path):
    """Parts 1 and 51 are two refs; numbers of parts modulo 50 made all categories of larger tables read the same."""
    orders = [(k, "A" if k < 5 else "B") for k in range(10)]
    apart = [(k, p + (50 if k >= 5 else 0), 1) for k in range(10) for p in (1, 2)]
    half = [(k, p, 2) for k in range(10) for p in ((1, 51) if k < 5 else (1,))]
    got = result(spark, put(spark, tmp_path, [(1, 7), (2, 8)], orders, apart + half))
    assert (got["7"].mean_jaccard, got["7"].status, got["7"].n) == (0.0, "split-candidate", 10)
    assert (got["8"].mean_jaccard, got["8"].status, got["8"].categories) == (0.5, "no-split", 2)


def test_categories_of_the_test_tables_read_different_parts(spark):
    """With parts modulo 50 all 25 skills had 1.0 here."""
    got = {r.mean_jaccard for r in catalogue.QUERIES[NAME](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) > 20 and max(got) < 0.3


@pytest.mark.parametrize("kinds", [1, 2, 5, graph.MASKED, graph.MASKED + 8])
def test_odd_rows(spark, tmp_path, kinds):
    """Unknown parts, suppliers and nations, repeated lines, orders of two priorities, and more categories than bits."""
    orders = [(k, f"c{k % kinds}") for k in range(7 * kinds)] + [(3, f"c{kinds - 1}"), (None, "c0")]
    lines = [(k, (k * k + j) % 97, j % 3) for k in range(7 * kinds) for j in range(6)] * 2
    lines += [(0, None, 0), (1, None, 0), (1, None, 1), (2, 5, None), (None, 5, 0), (9999, 5, 0), (4, 5, 9)]
    got = result(spark, put(spark, tmp_path, [(0, 7), (1, 7), (2, None), (2, 8), (None, 9)], orders, lines))
    assert set(got) == {"7", "8", None}


@pytest.mark.parametrize("lines", [[], [(0, 1, 1)]])
def test_nothing_to_join(spark, tmp_path, lines):
    assert result(spark, put(spark, tmp_path, [(1, 7)], [], lines)) == {}


def test_rows_and_sets_give_the_same(spark):
    cats = [f"c{k}" for k in range(4)]
    rows = spark.range(4000).select(
        (F.col("id") % 3).cast("string").alias("skill"), (F.col("id") % 211).alias("session"), F.when(F.col("id") % 7 != 0, F.pmod(F.hash("id"), F.lit(90))).alias("ref"),
        F.when(F.col("id") % 211 % 5 < 4, F.concat(F.lit("c"), (F.col("id") % 211 % 5).cast("string"))).alias("category"),
    )
    sets = graph.jaccard_split(rows.select("skill", "session", "category").distinct(), rows.select("skill", "session", "ref").distinct())
    masked = graph.jaccard_split_masked(rows.withColumn("bit", graph.category_bit(F.col("category"), [graph.UNCATEGORIZED, *cats])))
    plain = lambda df: sorted((r.skill, r.categories, r.n, round(r.mean_jaccard, 12), r.status, r.reason) for r in df.collect())
    assert plain(masked) == plain(sets) and len(plain(sets)) == 3 and plain(sets)[0][1] == 5

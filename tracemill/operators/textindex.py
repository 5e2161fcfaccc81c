"""A stored index for substring search over texts that grow.

Texts are dealt to blocks by their id; of each block the index keeps the grams (three lower-case characters) that some of its
texts hold.  A search reads the postings of the query's grams, then only the blocks that hold all of them, and verifies
there, so its result is that of a scan.  Adding texts appends to both and reads nothing of what is stored.

Defined results: queries of fewer than two characters find nothing; one of two characters, which has no gram, reads all
blocks; null texts are never found; a text that is added twice is there twice, unless its batch has a number; blocks that
lost a text by `replace` may be read in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import trend
from tracemill.store import KeyedStore

#: Characters of a gram.
GRAM = 3


def grams(text: Column) -> Column:
    """Distinct grams of a text in lower case."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - GRAM + 1)), lambda k: F.substr(low, k, F.lit(GRAM))))


class TextIndex:
    """Texts (id, text, ...) below `path`, whose other columns `more` names in DDL."""

    def __init__(self, spark: SparkSession, path: str, more: str = "", blocks: int = 1024):
        self.spark, self.blocks = spark, blocks
        self.texts = KeyedStore(spark, f"{path}/texts", f"id string, text string, block int{', ' * bool(more)}{more}", ["block"], blocks)
        self.postings = KeyedStore(spark, f"{path}/postings", "gram string, block int", ["gram"], 64)

    def add(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Postings first: a text is found only once its grams are there."""
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int"))
        self.postings.append(dealt.filter("text is not null").select(F.explode(grams(F.col("text"))).alias("gram"), "block").distinct(), batch)
        self.texts.append(dealt, batch)

    def candidates(self, query: str) -> DataFrame | None:
        """(block): blocks that hold all grams of a query; None if it has none, so that all may."""
        own = query.strip()
        if len(own) < GRAM:
            return None
        asked = self.spark.range(1).select(F.explode(grams(F.lit(own))).alias("gram"))
        n = asked.count()
        return self.postings.read(asked).distinct().groupBy("block").count().filter(F.col("count") == n).select("block")

    def search(self, query: str, order: str = "id", around: int = 40, limit: int = 50) -> DataFrame:
        """As `trend.search` over all texts: rows with a snippet, at most `limit`, by `order`."""
        blocks = self.candidates(query)
        rows = self.texts.read() if blocks is None else self.texts.read(blocks)
        return trend.search(rows.drop("block"), "text", order, query, around, limit)

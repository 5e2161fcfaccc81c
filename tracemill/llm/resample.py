"""Quality selection by importance resampling of hashed n-grams.

Two generative models, bags of hashed word unigrams and bigrams with add-one smoothing, are counted: one over target
texts (documents labelled good), one over all raw texts.  A document's log weight is its log likelihood ratio.  Adding
standard Gumbel noise and taking the k largest sums samples k documents without replacement in proportion to their
weights.  The noise is a hash of seed, id and text, so results can be repeated.

The k-th largest key is found exactly: counts in 65,536 bins between the least and largest key tell the bin that holds
it, and the next pass divides that bin; nothing is sorted and no more than the bins reach the driver.

Defined results: null and empty texts have no n-grams and weight 0; null ids are kept; equal rows get equal keys and
stay or go together, so k can be exceeded by ties; with no target rows all weights are 0 and selection is uniform.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, materialize, worker_cache

#: Buckets of the hashed models, and labelled documents that the target model may be fitted on.
BUCKETS, TARGET_DOCS = 1 << 16, 131_072
_SEEN = 400_000


def buckets(text: str | None, seen: dict[str, int]) -> np.ndarray:
    """Bucket of every word and adjacent pair of words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    get, hashes = seen.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = zlib.crc32(w.encode("utf-8", "replace"))
            if len(seen) < _SEEN:
                seen[w] = h
        hashes.append(h)
    one = np.array(hashes, np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xD6E8FEB86659FD93)])
    return (both >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Ratio:
    logs: np.ndarray  # log target probability minus log raw probability, by bucket


def learn(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_docs: int = TARGET_DOCS) -> Ratio:
    """`target_ids` (id): of these at most `target_docs`, those with the smallest hashes, make the target model; all rows the raw one."""
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id")).filter("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(target_docs).withColumn("good", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left")

    def run(batches):
        seen = worker_cache(("resample", "words"), dict)
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1), strict=True):
                b = buckets(text.as_py(), seen)
                n = np.bincount(b, minlength=BUCKETS) if len(b) > 20_000 else None
                for total in (raw, good)[: 1 + is_good.as_py()]:
                    if n is not None:
                        total += n
                    else:
                        np.add.at(total, b, 1)
        own = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(raw[own]), pa.array(good[own])], ["bucket", "raw", "good"])

    counted = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(run, "bucket long, raw long, good long")
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # BUCKETS rows at most
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    if good.sum() == BUCKETS:
        return Ratio(np.zeros(BUCKETS))
    return Ratio(np.log(good / good.sum()) - np.log(raw / raw.sum()))


def weigh(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_grams, log_weight, gumbel_key) for every row."""
    shared = Shared(docs.sparkSession, ratio, "resample")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import xxhash

        seen, logs = worker_cache(("resample", "words"), dict), shared.value.logs
        for batch in batches:
            n, weights, keys = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                b = buckets(text, seen)
                n.append(len(b))
                weights.append(float(logs[b].sum()) if len(b) else 0.0)
                u = (xxhash.xxh64_intdigest(f"{doc_id.as_py()}\x00{text or ''}".encode("utf-8", "replace"), seed) >> 11) + 0.5
                keys.append(weights[-1] - float(np.log(-np.log(u / 2**53))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], [id_col, "n_grams", "log_weight", "gumbel_key"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_grams long, log_weight double, gumbel_key double")


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value of a column of doubles; None if there are fewer rows."""
    if k <= 0:
        return None
    rows = keys.select(F.col(column).alias("x")).filter("x is not null")
    left = k
    stats = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).first()
    if stats.n < k:
        return None
    low, high = stats.a, stats.b
    while low < high:
        width = (high - low) / 65536
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(65535)) if width > 0 else F.lit(0)
        inside = rows.filter((F.col("x") >= low) & (F.col("x") <= high))
        bins = sorted(inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect(), key=lambda r: -r.at)
        for r in bins:
            if r.n >= left:
                break
            left -= r.n
        if (r.a, r.b) == (low, high):  # too close for a finer division: a few distinct values
            return _among(inside, left)
        low, high = r.a, r.b
    return low


def _among(rows: DataFrame, k: int) -> float:
    for r in sorted(rows.groupBy("x").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.x):
        k -= r.n
        if k <= 0:
            return r.x
    raise ValueError("fewer rows than k")


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = 0.5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_grams, log_weight, gumbel_key, selected) for every row; `selected` are the ceil(fraction * rows) largest keys."""
    weighed = materialize(weigh(docs, learn(docs, target_ids, id_col, text_col), id_col, text_col, seed), "weighed")
    k = int(np.ceil(fraction * weighed.count()))
    cut = kth_largest(weighed, "gumbel_key", k)
    selected = F.lit(k > 0) if cut is None else F.col("gumbel_key") >= F.lit(cut)
    return weighed.withColumn("selected", selected)

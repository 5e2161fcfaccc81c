"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Vectors are cut into blocks.  A block's index keeps, for each dimension, the rows ordered by value and cut into
segments of like (quantised) value.  For a query, a segment's impact is the largest contribution that it can make
beyond the least that its dimension gives to anybody; segments are processed by descending impact, adding exact
contributions to accumulators.  What is still unprocessed bounds each row's final score from above, so once the rows
that could reach the k-th best lower bound are few, the bound proves all others out; the possible members are then
rescored exactly.  Without such a proof all segments are processed.  A segment's rows are read once for some dozens of
queries, each of which takes it at its own turn.

A block's index is built once for each batch of queries, which is large; blocks hold rows dealt by id, vector and a number
among equal rows, so neither a repeated id nor a repeated vector gathers in one of them.  Of equal rows k are kept, for no
query can have more of them among its k best.  What deals rows is their content alone: a task that is done again after a
lost executor deals them alike.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do null ids; only
vectors of a query's own dimension are its candidates; rows with the query's own id are not; ties go to the smaller
id; fewer candidates than k give fewer rows.  Rows of a repeated id are candidates each; as a query the id is answered
once, for the smallest of its vectors of a dimension.  Components and scores beyond a long's range are clipped to it;
sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block, queries of a batch, segments of a dimension, queries that are answered together; parts of a query's segments after which a proof is tried.
BLOCK, BATCH, SEGMENTS, TOGETHER, PROOFS = 8_192, 4_096, 8, 64, (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)
_LONG = 2**63 - 1


class ImpactIndex:
    """The index of one block: `ids` (n) and integer `vectors` (n x d)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments: int = SEGMENTS):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        self.rows, self.values, self.cuts = [], [], []
        self.most = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
        self.begin = self.served = 0  # the proof that is tried first: that which was enough for half the queries before, at times the one before it
        for k in range(d if self.most < 2**31 else 0):  # larger ones are compared plainly
            order = np.argsort(vectors[:, k], kind="stable")
            value = vectors[order, k]
            # a segment ends where the quantised value changes; equal values never part
            step = max(1, int(value[-1] - value[0] + 1) // segments + 1) if n else 1
            level = (value - (value[0] if n else 0)) // step
            cut = np.concatenate([[0], np.nonzero(np.diff(level))[0] + 1, [n]])
            self.rows.append(order)
            self.values.append(value)
            self.cuts.append(cut)
        # least and largest value of each segment; those that a dimension doesn't have aren't real
        self.least, self.largest, self.real = (np.zeros((len(self.cuts), max(map(len, self.cuts), default=2) - 1), t) for t in (np.int64, np.int64, bool))
        for k, (value, cut) in enumerate(zip(self.values, self.cuts, strict=True)):
            if n:
                self.least[k, : len(cut) - 1], self.largest[k, : len(cut) - 1], self.real[k, : len(cut) - 1] = value[cut[:-1]], value[cut[1:] - 1], True
        self.tables: dict[type, np.ndarray] = {}

    def table(self, kind: type) -> np.ndarray:
        """Two lines a segment: how far its rows' values are above their dimension's least, and 1 at its rows."""
        if kind not in self.tables:
            self.tables[kind] = np.zeros((2, int(self.real.sum()), len(self.ids)), kind)
            for line, (dim, s) in enumerate(np.argwhere(self.real)):
                a, b = self.cuts[dim][s], self.cuts[dim][s + 1]
                self.tables[kind][0, line, self.rows[dim][a:b]] = self.values[dim][a:b] - self.values[dim][0]
                self.tables[kind][1, line, self.rows[dim][a:b]] = 1
        return self.tables[kind]

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows whose id isn't `own`, by score, then id."""
        return self.search_all(query[None], k, [own])[0]

    def search_all(self, queries: np.ndarray, k: int, owns: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The answers to many queries; `TOGETHER` of them have a line of accumulators each, so a segment's rows are read once for them."""
        n, d = self.vectors.shape
        out: list = [None] * len(queries)
        fits = []
        for i, query in enumerate(queries):
            top = 4 * self.most * max(1, d) * int(np.abs(query.astype(object)).max(initial=0))
            if self.most >= 2**31 or top >= _LONG:
                out[i] = self._plain(query, k, owns[i])
            else:
                fits.append((i, top))
        for part in (fits[j : j + TOGETHER] for j in range(0, len(fits), TOGETHER)):
            which = [i for i, _ in part]
            most = max(top for _, top in part)
            kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # whole numbers, all sums are exact
            for i, members in zip(which, self._members(queries[which], k, [owns[i] for i in which], kind), strict=True):
                ids, scores = self.ids[members], self.vectors[members] @ queries[i]
                order = np.lexsort((ids, -scores))[:k]
                out[i] = ids[order], scores[order]
        return out

    def _members(self, queries: np.ndarray, k: int, owns: list[int | None], kind: type) -> list[np.ndarray]:
        """Rows that can be among the k best of each query, after its segments of highest impact or, without a proof, all."""
        n, m = len(self.ids), len(queries)
        q = queries[:, : len(self.cuts), None]
        span = (self.largest.max(1, initial=-_LONG, where=self.real) - self.least.min(1, initial=_LONG, where=self.real))[:, None] if n else np.zeros((len(self.cuts), 1), np.int64)
        # a contribution beyond its dimension's least is q times what the value is above the least one, plus `lift`; a segment's
        # impact is the largest, `place` its place among its query's segments
        lift = np.where(q < 0, -q * span, 0)
        above = np.where(q > 0, self.largest, self.least) - self.least.min(1, initial=_LONG, where=self.real)[:, None]
        real = self.real & (q != 0)
        gain = np.where(real, q * np.where(self.real, above, 0) + lift, -1)
        order, place = np.argsort(-gain.reshape(m, -1), axis=1, kind="stable"), np.empty((m, gain[0].size), np.int64)
        np.put_along_axis(place, order, np.arange(gain[0].size)[None], axis=1)
        place, total = place.reshape(gain.shape), real.sum((1, 2))
        # acc: a row's contributions so far, so it is a lower bound of their sum
        acc, done = np.zeros((m, n), kind), np.zeros(gain.shape, bool)
        found: list = [None] * m
        proven = np.full(m, len(PROOFS))
        for proof in range(self.begin if n > 4 * k else len(PROOFS), len(PROOFS) + 1):
            todo = np.array([i for i in range(m) if found[i] is None])
            new = real[todo] & ~done[todo] & (place[todo] < np.floor(total[todo] * (*PROOFS, 1)[proof])[:, None, None])
            done[todo] |= new
            for line, weight in zip(self.table(kind), (q[todo], lift[todo]), strict=True):
                acc[todo] += np.where(new, weight, 0)[:, self.real].astype(kind) @ line
            # the most that the unprocessed segments can still add to any row
            bound = np.where(real & ~done, gain, 0).max(2, initial=0).sum(1)
            for i in todo.tolist():
                members = self._possible(acc[i], int(bound[i]), k, owns[i])
                if proof == len(PROOFS) or len(members) * 20 <= n:
                    found[i], proven[i] = members, proof
            if all(f is not None for f in found):
                break
        self.begin = max(0, int(np.median(proven)) - (self.served % 8 == 0))
        self.served += 1
        return found

    def _plain(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers of any size, for components that 64 bits cannot multiply and add."""
        scores = [max(-_LONG - 1, min(_LONG, s)) for s in (self.vectors.astype(object) @ query.astype(object)).tolist()]
        best = sorted((-s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != own)[:k]
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)

    def _possible(self, acc: np.ndarray, bound: int, k: int, own: int | None) -> np.ndarray:
        """Rows that can still be among the k best: the others' upper bound is below the k-th best lower bound."""
        free = np.arange(len(acc)) if own is None else np.nonzero(self.ids != own)[0]
        if len(free) <= k:
            return free
        kth = np.partition(acc[free], len(free) - k)[len(free) - k]
        return free[acc[free] + bound >= kth]


def quantised(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null unless all components are finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(column.isNotNull() & ~bad, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where `is_query` holds.

    Blocks of rows and batches of queries meet in pairs; a task holds one of each.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter("id is not null and v is not null").withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).collect()  # a row for each length of vectors
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # equal rows, of which a query can have k among its best, are told apart by a number
    rows = rows.groupBy("id", "v", "dim").agg(F.bool_or("q").alias("q"), F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k))))).drop("n")
    counts = F.broadcast(spark.createDataFrame([(r.dim, -(-r.n // BLOCK), -(-r.nq // BATCH)) for r in sizes], "dim int, blocks int, batches int"))
    rows = rows.join(counts, "dim")

    def packed(own: DataFrame, parts: str) -> DataFrame:
        """One row a part: ids and components as bytes."""

        def pack(group: pa.Table) -> pa.Table:
            ids = group.column("id").combine_chunks().to_numpy(zero_copy_only=False)
            v = group.column("v").combine_chunks()
            one = group.slice(0, 1)
            return pa.table({"dim": one["dim"], "part": one["part"], "other": one["other"], "ids": pa.array([ids.tobytes()], pa.binary()), "vs": pa.array([v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())})

        other = "batches" if parts == "blocks" else "blocks"
        own = own.select("dim", F.pmod(F.xxhash64("id", "v", "copy"), F.col(parts)).cast("int").alias("part"), F.col(other).alias("other"), "id", "v")
        return own.groupBy("dim", "part", "other").applyInArrow(pack, "dim int, part int, other int, ids binary, vs binary")

    blocks = packed(rows, "blocks").filter("other > 0").select("dim", F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("batch"), F.lit(0).alias("side"), "ids", "vs")
    batches = packed(rows.filter("q").groupBy("id", "dim", "blocks", "batches").agg(F.min("v").alias("v")).withColumn("copy", F.lit(1)), "batches").select("dim", F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("block"), F.col("part").alias("batch"), F.lit(1).alias("side"), "ids", "vs")

    def search(group: pa.Table) -> pa.Table:
        sides = {s: (np.frombuffer(i, np.int64), np.frombuffer(v, np.int64)) for s, i, v in zip(*(group.column(c).to_pylist() for c in ("side", "ids", "vs")), strict=True)}
        found: list[tuple[int, int, int]] = []
        if len(sides) == 2:
            (ids, vs), (qids, qs) = sides[0], sides[1]
            index = ImpactIndex(ids, vs.reshape(len(ids), -1))
            answers = index.search_all(qs.reshape(len(qids), -1), k, qids.tolist())
            for qid, answer in zip(qids.tolist(), answers, strict=True):
                found.extend((qid, i, s) for i, s in zip(*(x.tolist() for x in answer), strict=True))
        return pa.table({c: pa.array([f[n] for f in found], pa.int64()) for n, c in enumerate(("query_id", "vec_id", "score"))})

    found = blocks.unionByName(batches).groupBy("dim", "block", "batch").applyInArrow(search, out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Small gradient-boosted trees for binary labels, fitted on counted rows in Spark.

Features are whole numbers, cut into at most 32 bins at quantiles of all rows; rows that are equal then are one row with a
count.  Each tree is grown level by level on logistic-loss gradients: tasks sum the gradients of their rows by node, feature
and bin, Spark sums these over tasks, and the driver, which gets sums only, picks the splits.  Up to `FEW` distinct rows are
summed on the driver, with the same code and the same result: gradients are added as whole multiples of 1 / `UNIT`, so
their order doesn't matter and fitting is deterministic.  Leaves are multiples of 1 / `STEP`, so rows have few distinct
margins, and calibration sees all rows by counts of these.  Prediction is vectorised and needs only the plain arrays in
`Trees`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bins of a feature; fractions of gradients and of leaves; distinct rows that the driver sums itself.
BINS, UNIT, STEP, FEW = 32, 2**20, 2**12, 65_536


@dataclass
class Trees:
    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, b: np.ndarray) -> np.ndarray:
        """Of rows that are given as bins."""
        out = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            out += value[_node(b, feature, cut, int(np.log2(len(value)))) - len(feature)]
        return out

    def scaled(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _logistic(a * margin + b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by a logistic fit on rows that the trees have not seen."""
        return self.scaled(self.margin(self.bins(x)))


@dataclass
class Margins:
    """Counts of rows, and of those with label 1, by kind and margin; margins descend."""

    kind: np.ndarray
    margin: np.ndarray
    n: np.ndarray
    hits: np.ndarray

    def of(self, kind: int) -> Margins:
        own = self.kind == kind
        return Margins(self.kind[own], self.margin[own], self.n[own], self.hits[own])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _node(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of a tree that rows come to after so many levels."""
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(levels):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    return node


def _packed(column, kind: str, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, features)


def edges_of(rows: DataFrame, features: int, total: int) -> list[np.ndarray]:
    """Quantiles of every feature of (x, n), each a value that occurs."""

    def run(batches):
        for batch in batches:
            x, n = _packed(batch.column(0), "<u2", features), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(features):
                values, at = np.unique(x[:, k], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.astype(np.int32)), pa.array(np.bincount(at, n, len(values)).astype(np.int64))], ["k", "value", "n"])

    upto = F.sum("n").over(W.partitionBy("k").orderBy("value"))
    values = rows.select("x", "n").mapInArrow(run, "k int, value int, n long").groupBy("k", "value").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    places = F.array(*(F.lit(q * (total - 1) // BINS) for q in range(1, BINS)))
    found = values.filter(F.exists(places, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).select("k", "value").collect()
    return [np.array(sorted(r.value for r in found if r.k == k)) for k in range(features)]


def sums(b: np.ndarray, y: np.ndarray, n: np.ndarray, model: Trees, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """(2, nodes of the level x features x bins): gradients and their derivatives, in units."""
    p = _logistic(model.margin(b))
    node = _node(b, feature, cut, level) - (2**level - 1)
    at = ((node[:, None] * b.shape[1] + np.arange(b.shape[1])) * BINS + b).ravel()
    return np.stack([np.bincount(at, np.repeat(np.rint(w * UNIT) * n, b.shape[1]), 2**level * b.shape[1] * BINS) for w in (p - y, p * (1 - p))]).astype(np.int64)


def fit(rows: DataFrame, features: int, total: int, hits: int, few: int = FEW, rounds: int = 30, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> tuple[Trees, DataFrame]:
    """Trees from rows (kind, x, y, held, n) that aren't held, and all rows with bins instead of x.

    x holds `features` numbers of 16 bits; `total` and `hits` count the rows that aren't held, and those with label 1.
    """
    model = Trees(edges_of(rows.filter("not held"), features, total))
    share = min(max(hits / total, 1e-3), 1 - 1e-3)
    model.base = round(float(np.log(share / (1 - share))) * STEP) / STEP

    def run(batches):
        for batch in batches:
            b = model.bins(_packed(batch.column(1), "<u2", features)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary()), *batch.columns[2:]], ["kind", "x", "y", "held", "n"])

    binned = rows.select("kind", "x", "y", "held", "n").mapInArrow(run, "kind int, x binary, y int, held boolean, n long")
    binned = materialize(binned.groupBy("kind", "x", "y", "held").agg(F.sum("n").alias("n")), "binned")
    own = binned.filter("not held").select("x", "y", "n")
    arrays = lambda t: (_packed(t.column(0), np.uint8, features).astype(np.int64), *(t.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
    held_here = arrays(own.toArrow()) if own.count() <= few else None

    def level_sums(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        if held_here:
            return sums(*held_here, model, feature, cut, level)

        def run(batches):
            found = 0
            for batch in batches:
                found = found + sums(*arrays(batch), model, feature, cut, level)
            if isinstance(found, np.ndarray):
                cell = np.nonzero(found[1])[0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(found[0][cell]), pa.array(found[1][cell])], ["cell", "g", "h"])

        out = np.zeros((2, 2**level * features * BINS), np.int64)
        for r in own.mapInArrow(run, "cell int, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r.cell] = r.g, r.h
        return out

    inner = 2**depth - 1
    for _ in range(rounds):
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            g, h = (level_sums(feature, cut, level) / UNIT).reshape(2, width, features, BINS).cumsum(3)
            gt, ht = g[..., -1:], h[..., -1:]
            gain = (g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)).reshape(width, -1)
            top = gain.argmax(1)
            better = gain[np.arange(width), top] > 1e-9
            feature[first : first + width][better], cut[first : first + width][better] = top[better] // BINS, top[better] % BINS
        # the leaves' sums are those on either side of the last level's cuts; without a cut all rows are on the left
        at = np.arange(width), feature[first:], np.minimum(cut[first:], BINS - 1)
        left = np.stack([g[at], h[at]])
        both = np.stack([left, np.stack([g[at[:2]][:, -1], h[at[:2]][:, -1]]) - left], axis=2).reshape(2, -1)
        model.trees.append((feature, cut, np.rint(-rate * both[0] / (both[1] + l2) * STEP) / STEP))
    return model, binned


def margins(rows: DataFrame, model: Trees) -> Margins:
    """Counts of (kind, x as bins, y, n) by margin."""
    features = len(model.edges)

    def run(batches):
        for batch in batches:
            steps = np.rint(model.margin(_packed(batch.column(1), np.uint8, features)) * STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps), *batch.columns[2:]], ["kind", "step", "y", "n"])

    found = rows.select("kind", "x", "y", "n").mapInArrow(run, "kind int, step long, y int, n long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hits")).collect()
    found.sort(key=lambda r: (-r.step, r.kind))
    return Margins(np.array([r.kind for r in found], int), np.array([r.step for r in found], float) / STEP, np.array([r.n for r in found], float), np.array([r.hits for r in found], float))


def calibrate(model: Trees, m: np.ndarray, n: np.ndarray, hits: np.ndarray, steps: int = 50) -> None:
    """Platt scaling by Newton steps on held-back rows, counted by margin, with smoothed targets."""
    if hits.sum() in (0, n.sum()):
        return
    high, low = (hits.sum() + 1) / (hits.sum() + 2), 1 / (n.sum() - hits.sum() + 2)
    t = hits * high + (n - hits) * low
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _logistic(a * m + b)
        w = n * (p * (1 - p) + 1e-9)
        grad = np.array([((n * p - t) * m).sum() + 1e-3 * (a - 1), (n * p - t).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = max(0.05, a - step[0]), b - step[1]
    model.scale = (float(a), float(b))

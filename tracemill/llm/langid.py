"""Language identification by rank-order profiles (out-of-place distance).

A document's most frequent letter n-grams (n = 1 to 3 over lower-cased letters, words padded by one blank) are ranked
by frequency, ties by n-gram.  Each language's profile is the ranking over its training documents.  The distance is
the sum of rank differences, with the profile's length for an n-gram that the profile lacks.

Defined results: null text, empty text and text without a letter give `und` with score 0; ties between languages go
to the smaller name; with no training rows everything is `und`; repeated rows are predicted each on its own; the
columns `lang`, `source` and the id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, fold, released, worker_cache

UND = "und"
#: N-grams in a profile, and letters in one stretch of counting (the longest key list held at once).
PROFILE, STRETCH = 400, 1 << 20
#: Rows that a worker predicts and gives back at once.
ROWS = 512


def _letters() -> np.ndarray:
    """Code point to lower-case letter; 0 for everything else.  Points beyond the basic plane stay as they are."""
    out = np.zeros(0x10000, np.uint64)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys (21 bits a character) and their counts; empty if the text has no letter."""
    table = worker_cache(("langid", "letters"), _letters)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = table[np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        low[far] = [ord(chr(c)) if chr(c).isalpha() else 0 for c in points[far].tolist()]
    if not low.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.concatenate([np.zeros(1, np.uint64), low, np.zeros(2, np.uint64)])
    a[a == 0] = 1  # the blank
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for k in range(0, len(low) + 1, STRETCH):
        x, y, z = a[k : k + STRETCH + 2][: len(a) - k - 2], a[k + 1 : k + STRETCH + 3], a[k + 2 : k + STRETCH + 4]
        n = min(STRETCH, len(low) + 1 - k, len(x), len(y), len(z))
        x, y, z = x[:n], y[:n], z[:n]
        two = (x << np.uint64(21)) | y
        three = (two << np.uint64(21)) | z
        # a blank may stand at either end of an n-gram, never alone or in its middle
        found = np.concatenate([y[y > 1], two[(x > 1) | (y > 1)], three[y > 1]])
        part, many = np.unique(found, return_counts=True)
        keys, counts = (part, many) if not len(keys) else merged(keys, counts, part, many)
    return keys, counts


def merged(k1: np.ndarray, c1: np.ndarray, k2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k1, k2]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c1, c2]), len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The `size` most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]
    keys: np.ndarray  # all languages' n-grams, sorted
    ranks: np.ndarray  # by key and language; `size` where a profile lacks the n-gram
    size: int

    @staticmethod
    def of(profiles: dict[str, list[int]], size: int) -> Profiles:
        names = tuple(sorted(profiles))
        keys = np.unique(np.concatenate([np.array(profiles[n], np.uint64) for n in names] or [np.zeros(0, np.uint64)]))
        ranks = np.full((len(keys), len(names)), size, np.int64)
        for k, n in enumerate(names):
            ranks[np.searchsorted(keys, np.array(profiles[n], np.uint64)), k] = np.arange(len(profiles[n]))
        return Profiles(names, keys, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return UND, 0.0
        own = ranked(*grams(text), self.size)
        if not len(own):
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        place = np.arange(len(own))
        distance = np.abs(self.ranks[at[known]] - place[known, None]).sum(0) + self.size * int((~known).sum())
        best = int(distance.argmin())  # names are sorted: the first of equals
        return self.names[best], float(1 - distance[best] / (self.size * len(own))) if distance[best] < self.size * len(own) else 0.0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows of `docs` with a language.

    Each task sums its own counts by language before the shuffle; the driver gets `size` n-grams a language.
    """

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                waiting.setdefault(lang.as_py(), []).append(grams(text.as_py()))
                own = waiting[lang.as_py()]
                if len(own) >= 256:
                    waiting[lang.as_py()] = [_sum(own)]
            for lang, own in waiting.items():
                held[lang] = _sum([*own, held[lang]] if lang in held else own)
            if sum(len(k) for k, _ in held.values()) > 1_000_000:
                yield from rows()
        yield from rows()

    counts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col).mapInArrow(released(run), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # first the best of each of 16 slices of a language, then the best of those: no task gathers a language's n-grams
    total = total.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(16)))
    order = [F.desc("n"), F.asc("gram")]
    total = total.withColumn("r", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("r") <= size)
    best = total.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in best.select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(profiles, size)


def _sum(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in own]), len(keys)).astype(np.int64)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of `docs`, plus the prediction and its score, under names that `docs` must not have."""
    shared = Shared(docs.sparkSession, profiles, "langid")
    at, names = docs.columns.index(text_col), docs.columns
    schema = docs.select("*").schema.add(pred_col, "string").add(score_col, "double")

    def run(batches):
        p = shared.value
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            found = [p.predict(t.as_py()) for t in batch.column(at)]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, pred_col, score_col])

    return docs.mapInArrow(released(run), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~fold(F.col(id_col), 4, 2))

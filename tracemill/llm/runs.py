"""Periodic runs of words, by the harmonic grid.

A run is a stretch of words with smallest period q and at least max(`MIN_WORDS`, `MIN_PERIODS` * q) words that no
neighbouring word extends.  For each period p, places are p words apart: j*p, (j+1)*p, ...  A run of period p holds at
least three of them, so forward and backward longest common extensions (LCE) between j*p and (j+1)*p find all of it.
Extensions come from suffix arrays of the words and of the reversed words with range minima over their LCP arrays.  The
sum of n / p places over all periods is n log n.

Queries that cannot give a run are left out exactly: a run that holds j*p, (j+1)*p and (j+2)*p has equal words there,
and equal words half a period further on.  A document where no query is left needs no suffix array.

Defined results: null and empty texts have no word and no run; ties of the highest exponent go to the smallest start,
then the smallest period; repeated rows are answered each; columns other than the two named are not read.  Memory is
linear in the words of a document, and one document is at a time in work.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import worker_cache

MIN_WORDS, MIN_PERIODS = 24, 3
#: Words up to which the grid of all periods is kept ready, LCE queries that are answered at once, values of a block of range minima.
READY, QUERIES, BLOCK = 8_192, 65_536, 16


class RangeMin:
    """Minima of ranges in constant time and linear memory: blocks of `BLOCK` values, a sparse table over their minima."""

    def __init__(self, values: np.ndarray):
        padded = np.full(-(-max(1, len(values)) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        rows = padded.reshape(-1, BLOCK)
        self.values = padded
        self.head = np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 ** len(self.table) <= len(rows):
            last, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low .. high], both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.tail[low], self.head[high])
        one = np.nonzero(a == b)[0]
        if len(one):
            at = low[one, None] + np.arange(BLOCK)
            inside = at <= high[one, None]
            out[one] = np.where(inside, self.values[np.minimum(at, len(self.values) - 1)], np.iinfo(np.int32).max).min(axis=1)
        size = b - a - 1  # whole blocks between
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]):
            at = np.nonzero((size > 0) & (level == k))[0]
            mid = np.minimum(self.table[k][a[at] + 1], self.table[k][b[at] - 2**k])
            out[at] = np.minimum(out[at], mid)
        return out


class Extensions:
    """Longest common extensions of the suffixes of an array of small integers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        rank, k = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            own = key[order]
            rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        self.rank = rank
        self.least = RangeMin(self._lcp(words.tolist(), order.tolist(), rank.tolist()))

    @staticmethod
    def _lcp(words: list, order: list, rank: list) -> np.ndarray:
        """Words that a suffix has in common with the one before it in order; each suffix starts from what the one before it in the text had."""
        n, h = len(words), 0
        lcp = [0] * n
        for i in range(n):
            r = rank[i]
            if r:
                j = order[r - 1]
                most = n - max(i, j)
                while h < most and words[i + h] == words[j + h]:
                    h += 1
                lcp[r] = h
                if h:
                    h -= 1
            else:
                h = 0
        return np.array(lcp, np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j (other than i) on."""
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, jp, (j+2)p) of all periods with three places below n, by the last place."""
    ps = [np.full(max(0, -(-n // p) - 2), p, np.int32) for p in range(1, n // 2 + 1)]
    at = [np.arange(len(x), dtype=np.int32) * p for p, x in enumerate(ps, 1)]
    p, a = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (ps, at))
    order = np.argsort(a + 2 * p, kind="stable")
    return p[order], a[order], (a + 2 * p)[order]


def _asked(ids: np.ndarray, p, a: np.ndarray) -> np.ndarray:
    """Which of the places a with period p can lie in a run of that period."""
    keep = np.nonzero((ids[a] == ids[a + p]) & (ids[a] == ids[a + 2 * p]))[0]
    p, a = (p[keep] if isinstance(p, np.ndarray) else p), a[keep]
    return keep[ids[a + p // 2] == ids[a + p + p // 2]]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word numbers, by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    found: dict[tuple[int, int], int] = {}  # the smallest period of a stretch; a multiple of it gives the same stretch
    lce: list[Extensions] = []

    def query(p: np.ndarray, a: np.ndarray) -> None:
        if not lce:
            lce.extend((Extensions(ids), Extensions(ids[::-1])))
        for k in range(0, len(a), QUERIES):
            q, x = p[k : k + QUERIES].astype(np.int64), a[k : k + QUERIES].astype(np.int64)
            ahead, back = lce[0](x, x + q), np.zeros(len(x), np.int64)
            inner = np.nonzero(x > 0)[0]
            back[inner] = lce[1](n - x[inner], n - x[inner] - q[inner])
            start, end = x - back, x + q + ahead
            good = np.nonzero(end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * q))[0]
            for s, e, period in np.unique(np.stack([start[good], end[good], q[good]], axis=1), axis=0).tolist():
                found[s, e] = min(period, found.get((s, e), period))

    if n <= READY:
        ps, at, last = worker_cache(("runs", "grid", READY), lambda: grid(READY))
        m = int(np.searchsorted(last, n))
        p, a = ps[:m], at[:m]
        keep = _asked(ids, p, a)
        if len(keep):
            query(p[keep], a[keep])
    else:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        long: list[tuple[int, int, int]] = []  # known runs that places of a larger period can lie in
        for p in range(1, n // MIN_PERIODS + 1):
            a = np.arange(0, n - 2 * p, p)
            a = a[_asked(ids, p, a)]
            long = [x for x in long if x[1] - x[0] >= MIN_PERIODS * p]
            for s, e, q in long:
                if p % q == 0 and len(a):
                    a = a[(a < s) | (a + 2 * p >= e)]  # the others would find this run again
            if len(a):
                held.append((np.full(len(a), p), a))
                size += len(a)
            if size and (size >= QUERIES or p < 16 or p == n // MIN_PERIODS):
                before = set(found)
                query(*(np.concatenate(x) for x in zip(*held, strict=True)))
                long += [(s, e, q) for (s, e), q in found.items() if (s, e) not in before]
                held, size = [], 0
        if size:
            query(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared as whole numbers; `runs` are by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document with repeats put in by rule: for a tenth of the ids the words from some place on repeat the first of them."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None, full: bool = True) -> DataFrame:
    """A row for each document: id, n_runs, its strongest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    With `full` also `runs`, all runs in order, and `collapsed`, the text with each run cut to its first period.
    `change(id, words)` may give other words to look at.  No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    best = ("start", "length", "period", "exponent_milli")
    schema = f"`{id_col}` {id_type}, n_runs long, {', '.join(f'{c} long' for c in best)}, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * full

    def run(batches):
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                words = change(own, words) if change else words
                runs = find_runs(numbered(words))
                top = strongest(runs)
                if runs:
                    words = [w for w, kept in zip(words, kept_words(len(words), runs).tolist(), strict=True) if kept]
                text_out = b" ".join(words)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                row = [len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text_out).hexdigest()]
                rows.append(row + [[dict(zip(best, r, strict=False)) for r in runs], text_out.decode()] * full)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in best[:3]])), pa.string()] * full
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_runs", *best, "runs_sha256", "collapsed_sha256", *["runs", "collapsed"] * full])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

"""Ranked lexical search with an impact-ordered, score-at-a-time index and whole-number scores.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased.  A document's
impact for a term is a whole number of its occurrences and the document's length, a term's weight one of the documents
that hold it, so scores are exact and sums do not depend on their order.

Documents become rows of (term, occurrences) for the terms that some item asks for, written once to the shared folder.
Tasks read these rows in blocks.  A block's index keeps each term's postings in groups of exactly equal impact, the highest
first.  For an item, groups are processed by descending contribution, and what the next group of every term could add
bounds all that is unprocessed.  Once few documents can reach the k-th best lower bound (of this block or of the blocks
before it in the task), the bound proves all others out and the scores of those few are completed from their own rows;
without such a proof all groups are processed.  No posting and no text is shuffled, only a task's best documents are.

Defined results: null texts have no terms and count in no statistic; items without a term have no rows; an id that
several items have is answered once, for the smallest of its texts; rows of a repeated document id are documents each;
equal scores go to the smaller id, null ids last; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, discard, materialize

#: Postings and documents of a block, items whose texts the driver holds at once, members whose scores are completed.
POSTINGS, DOCUMENTS, ITEMS, MEMBERS = 1_500_000, 32_768, 2_048, 256
#: Slices in which an item's candidates are ranked before all of them are.
SLICES = 32
_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward_rows(docs: DataFrame, vocabulary: Shared, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): all terms of a document with repeats, and the occurrences of those in the vocabulary."""

    def run(batches):
        known = vocabulary.value.get
        for batch in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                own = [(t, c) for t, c in ((known(w), c) for w, c in Counter(words).items()) if t is not None]
                terms.extend(t for t, _ in own)
                tfs.extend(c for _, c in own)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


class ImpactBlock:
    """Postings of some documents: `ids` and `n` by document, `owner` (non-decreasing), `terms` and `tfs` by posting."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.no_id = ids, no_id
        length = 75 + (25 * n * n_docs) // max(1, n_terms)
        tfs = tfs.astype(np.int64)
        self.own_terms, self.own_impacts = terms, (1_000_000_000 * tfs) // (1000 * tfs + 12 * length[owner])
        self.own_starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        order = np.argsort((terms.astype(np.int64) << 20) + (1_000_000 - self.own_impacts))  # impacts are below a million
        self.docs, self.impacts = owner[order], self.own_impacts[order]
        self.descending = -self.impacts
        by_term = terms[order]
        first = np.nonzero(np.diff(by_term, prepend=-1))[0]
        self.starts = dict(zip(by_term[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(by_term)], strict=True), strict=True))

    def search(self, asked: list[tuple[int, int]], k: int, floor: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best: of `asked`, (term, weight times repeats in the item).

        `floor` is a score that k documents of other blocks reach; `scratch` is zero for every term, before and after.
        """
        lists = [(w, *self.starts[t]) for t, w in asked if w > 0 and t in self.starts]
        nobody = np.zeros(0, np.int64)
        if not lists:
            return nobody, nobody
        at = [a for _, a, _ in lists]
        tops = [w * int(self.impacts[a]) for w, a, _ in lists]
        rest, level = sum(tops), max(tops)
        least = min(w * int(self.impacts[b - 1]) for w, _, b in lists)
        if rest < floor:
            return nobody, nobody
        acc, kth = np.zeros(len(self.ids), np.int64), floor
        while rest:
            # the groups down to this level, whole: a contribution is reached if its impact is at least level / weight
            level = 0 if level <= least else int(level * 0.7)
            rest = 0
            for x, (w, _, end) in enumerate(lists):
                a = at[x]
                if a == end:
                    continue
                b = end if level == 0 else a + int(np.searchsorted(self.descending[a:end], -(-(-level // w)), side="right"))
                if b > a:
                    acc[self.docs[a:b]] += w * self.impacts[a:b]
                    at[x] = b
                if b < end:
                    rest += w * int(self.impacts[b])
            if len(acc) > k:
                kth = max(kth, int(np.partition(acc, len(acc) - k)[len(acc) - k]))
            if rest and kth > rest:  # otherwise a document that nothing is known of may still be a member
                members = np.nonzero(acc + rest >= kth)[0]
                if len(members) <= MEMBERS:
                    return self._complete(members, asked, scratch)
        members = np.nonzero((acc > 0) & (acc >= kth))[0]
        return members, acc[members]

    def _complete(self, members: np.ndarray, asked: list[tuple[int, int]], scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole scores, from the documents' own rows."""
        terms = [t for t, _ in asked]
        scratch[terms] = [w for _, w in asked]
        a, size = self.own_starts[members], self.own_starts[members + 1] - self.own_starts[members]
        end = np.cumsum(size)
        places = np.repeat(a - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        sums = np.concatenate([[0], np.cumsum(scratch[self.own_terms[places]] * self.own_impacts[places])])
        scratch[terms] = 0
        return members, sums[end] - sums[end - size]


def _blocks(batches, n_docs: int, n_terms: int):
    """Blocks of whole rows of a task's batches."""
    held: list[pa.RecordBatch] = []
    postings = rows = 0

    def block() -> ImpactBlock:
        t = pa.Table.from_batches(held).combine_chunks()
        lists, counts = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        ids = t.column("id").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        return ImpactBlock(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t.column("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), counts.flatten().to_numpy(), n_docs, n_terms)

    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            held.append(batch)
            postings += len(batch.column(2).flatten())
            rows += batch.num_rows
            if postings >= POSTINGS or rows >= DOCUMENTS:
                yield block()
                held, postings, rows = [], 0, 0
    if held:
        yield block()


def best_of_tasks(forward: DataFrame, queries: Shared, k: int) -> DataFrame:
    """(item_id, doc_id, score): of every item the k best documents of each task."""

    def run(batches):
        n_docs, n_terms, size, items = queries.value  # items: [(id, [(term, weight)])]
        scratch = np.zeros(size, np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        for block in _blocks(batches, n_docs, n_terms):
            for x, (_, asked) in enumerate(items):
                ids, no_id, scores = best[x]
                members, own = block.search(asked, k, int(scores[-1]) if len(scores) == k else 0, scratch)
                if len(members):
                    ids, no_id, scores = (np.concatenate(p) for p in ((ids, block.ids[members]), (no_id, block.no_id[members]), (scores, own)))
                    order = np.lexsort((ids, no_id, -scores))[:k]
                    best[x] = ids[order], no_id[order], scores[order]
        for (item, _), (ids, no_id, scores) in zip(items, best, strict=True):
            keep = scores > 0
            if keep.any():
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(ids[keep], pa.int64(), mask=no_id[keep]), pa.array(scores[keep], pa.int64())], ["item_id", "doc_id", "score"])

    return forward.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above zero for every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("text is not null").groupBy("item").agg(F.min("text").alias("text"))
    parts = max(1, -(-asked.count() // ITEMS))
    found = None
    for part in range(parts):  # one, unless there are very many items
        own = [(r.item, Counter(terms_of(r.text))) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, c in own for t in c}))}
        forward = materialize(forward_rows(docs, Shared(spark, vocabulary, "lexical"), id_col, text_col), "forward")
        totals = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r.t: r.n for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # the items' terms at most
        w = {t: weight(totals.docs, df[n]) for t, n in vocabulary.items() if n in df}
        shared = Shared(spark, (totals.docs, totals.terms, len(vocabulary), [(i, [(vocabulary[t], w[t] * c) for t, c in sorted(terms.items()) if t in w]) for i, terms in own]), "lexical")
        rows = materialize(best_of_tasks(forward, shared, k), "best")
        discard(forward)
        found = rows if found is None else found.union(rows)
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = W.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return found.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

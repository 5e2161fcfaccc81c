"""Ranked lexical search and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_contracts import documents, edge, empty, place  # noqa: F401  fixtures
from tracemill.llm import lexical, queries, runs


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(t, texts.get(i, t))
    out = Counter()
    for item, text in texts.items():
        found = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, no_id, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if no_id else i, -score] += 1
    return out


def test_op12(spark, place):  # noqa: F811
    items = [tuple(r) for r in spark.read.parquet(f"{place}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op12_lexical(spark, place).collect())
    assert got == brute_search(documents(spark, place), items) and got


def test_op12_ties_repeated_ids_and_extra_columns(spark):
    """Ties beyond the k-th place, a hot document id, repeated items, and columns named like an output."""
    docs = [(k % 50, "tie of many words") for k in range(100)] + [(None, "tie of many words"), (7, None), (8, "UPPER Kelvin ärger 12-34")]
    items = [(1, "tie"), (1, "many tie tie"), (2, "upper 34 kelvin ÄRGER"), (3, None), (None, "words"), (4, "nothing here is found x")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int").repartition(5)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert Counter(tuple(r) for r in lexical.search(d, i).collect()) == brute_search(docs, items)


def test_op12_items_in_parts_and_blocks_with_proofs(spark, sf_dir, monkeypatch):
    """Small blocks and many parts of items give the same, and proofs end searches early."""
    docs, items = documents(spark, sf_dir), [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    monkeypatch.setattr(lexical, "ITEMS", 7)
    got = lexical.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items)

    rng = np.random.default_rng(3)
    n = 4000
    owner, words = np.repeat(np.arange(n), 30), rng.zipf(1.3, n * 30) % 500
    pairs = Counter(zip(owner.tolist(), words.tolist(), strict=True))
    owner, words, tfs = (np.array(x) for x in zip(*sorted((o, t, c) for (o, t), c in pairs.items()), strict=True))
    block = lexical.ImpactBlock(np.arange(n), np.zeros(n, bool), np.full(n, 30), owner, words.astype(np.int32), tfs.astype(np.int32), n, 30 * n)
    completed = []
    plain = lexical.ImpactBlock._complete
    monkeypatch.setattr(lexical.ImpactBlock, "_complete", lambda self, members, *a: completed.append(len(members)) or plain(self, members, *a))
    for asked in ([(400, 9000)], [(3, 500), (77, 8000), (401, 9500)], [(t, 1000 + t) for t in range(0, 500, 9)]):
        members, scores = block.search(asked, 5, 0, np.zeros(500, np.int64))
        want = defaultdict(int)
        for t, w in asked:
            for d, c in zip(owner[words == t].tolist(), tfs[words == t].tolist(), strict=True):
                want[d] += w * ((10**9 * c) // (1000 * c + 12 * 100))
        best = sorted((-s, d) for d, s in want.items())[:5]
        assert sorted(zip((-scores).tolist(), members.tolist(), strict=True))[:5] == best
    assert completed and max(completed) <= lexical.MEMBERS


def test_new_queries_on_empty_tables(spark, empty):  # noqa: F811
    for name in ("op12_lexical", "op13_periodic"):
        assert queries.QUERIES[name](spark, empty).count() == 0


def brute_runs(words):
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        same = [words[i] == words[i + p] for i in range(n - p)]
        i = 0
        while i < n - p:
            j = i
            while j < n - p and same[j]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_of_arrays(monkeypatch):
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randrange(260), rng.choice([1, 2, 3, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n + 1), rng.randrange(1, 14)
            for i in range(a + p, min(n, a + rng.randrange(10, 110))):
                w[i] = w[i - p]
        for ready in (8192, 16):  # the prepared grid, and period by period
            monkeypatch.setattr(runs, "READY", ready)
            assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w)


def test_extensions():
    rng = random.Random(6)
    w = [rng.randrange(2) for _ in range(300)] + [0] * 200 + [1, 0] * 100
    lce = runs.Extensions(np.array(w))
    pairs = [(rng.randrange(700), rng.randrange(700)) for _ in range(3000)]
    pairs = [(i, j) for i, j in pairs if i != j]
    got = lce(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (i, j), n in zip(pairs, got.tolist(), strict=True):
        k = 0
        while max(i, j) + k < 700 and w[i + k] == w[j + k]:
            k += 1
        assert n == k


def op13_rows(docs):
    out = Counter()
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = 0 if i is None else zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute_runs(words)
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        dropped = {k for s, m, p in found for k in range(s + p, s + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        out[i, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_op13(spark, place):  # noqa: F811
    docs = documents(spark, place)
    docs = [(i, t) for i, t in docs if len(t or "") < 40_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    got = Counter(tuple(r) for r in runs.periodic_runs(frame.select("doc_id", "text"), change=runs.planted, full=False).collect())
    assert got == op13_rows(docs)
    assert queries.op13_periodic(spark, place).count() == spark.read.parquet(f"{place}/documents.parquet").count()


@pytest.mark.parametrize("full", [True, False])
def test_runs_keep_their_own_interface(spark, full):
    docs = [(1, "a b c " * 10 + "end"), (2, None), (3, ""), (None, "x " * 30), (1, "a b c " * 10 + "end"), (4, "one " * 30_000)]
    frame = spark.createDataFrame([(*r, "n") for r in docs], "doc_id long, text string, n_runs string")
    rows = runs.periodic_runs(frame, full=full).collect()
    assert len(rows) == 6 and ("runs" in rows[0].asDict()) == full
    if full:
        by = {r.doc_id: r for r in rows}
        assert by[1].collapsed == "a b c end" and [tuple(x) for x in by[1].runs] == [(0, 30, 3)] and by[None].collapsed == "x"
        assert by[4].length == 30_000 and by[4].exponent_milli == 30_000_000 and by[2].collapsed == by[3].collapsed == ""

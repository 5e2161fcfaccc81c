"""Keyed stores, journals and the text index."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import textindex, trend
from tracemill.store import Journal, KeyedStore


def rows(store):
    return sorted(map(tuple, store.read().collect()), key=str)


def test_upsert_replace_and_batches(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "k string, v long", ["k"], buckets=4)
    df = lambda *r: spark.createDataFrame(r, "k string, v long")
    assert rows(store) == []
    assert store.append(df(("a", 1), ("a", 2), (None, 3)), ("w", 1)) and not store.append(df(("a", 9)), ("w", 1))
    assert store.upsert(df(("a", 5), ("b", 6)), ("w", 2))
    assert rows(store) == sorted([("a", 5), ("b", 6), (None, 3)], key=str)
    store.replace(df((None, 4)), of=df(("b", 0)))
    assert rows(store) == sorted([("a", 5), (None, 4)], key=str)
    assert [tuple(r) for r in store.read(df((None, 0), ("z", 0))).collect()] == [(None, 4)]
    before = rows(store)
    store.compact(0)
    assert rows(store) == before and store.vacuum(1) > 0 and rows(store) == before


def test_only_touched_buckets_are_written_and_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, f"{tmp_path}/s", "k long, v long", ["k"], buckets=16)
    store.append(spark.range(200).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")))
    before, old = store.manifest()["files"], rows(store)
    monkeypatch.setattr(store, "_commit", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([(1, 1)], "k long, v long"))
    monkeypatch.undo()
    assert rows(store) == old
    store.upsert(spark.createDataFrame([(1, 1)], "k long, v long"))
    after = store.manifest()["files"]
    assert sum(after[b] != before[b] for b in before) == 1 and len(rows(store)) == 200
    # another writer that was first: the change starts again from its state
    late, tries = KeyedStore(spark, f"{tmp_path}/s", "k long, v long", ["k"], buckets=16), []
    real = KeyedStore._commit
    monkeypatch.setattr(late, "_commit", lambda m: (tries.append(m["version"]), store.upsert(spark.createDataFrame([(2, 2)], "k long, v long")) if len(tries) == 1 else None, real(late, m))[2])
    late.upsert(spark.createDataFrame([(3, 3)], "k long, v long"))
    assert len(tries) == 2 and {(1, 1), (2, 2), (3, 3)} <= set(rows(store))


def test_journal(spark, tmp_path):
    journal = Journal(spark, f"{tmp_path}/j", "identity string, task_id string, repeat int, passed boolean", buckets=2)
    df = lambda *r: spark.createDataFrame(r, "identity string, task_id string, repeat int, passed boolean")
    assert journal.append(df(("e1", "a", 1, False), ("e1", "b", 1, True)), "run", 1)
    assert not journal.append(df(("e1", "a", 1, True)), "run", 1)
    assert journal.append(df(("e1", "a", 1, True), ("e2", "a", 1, True)), "run", 2)
    assert sorted(map(tuple, journal.read().collect())) == [("e1", "a", 1, True), ("e1", "b", 1, True), ("e2", "a", 1, True)]
    planned = spark.createDataFrame([("e1", "a", 1), ("e1", "a", 2), ("e3", "a", 1)], "identity string, task_id string, repeat int")
    assert sorted(map(tuple, journal.missing(planned).collect())) == [("e1", "a", 2), ("e3", "a", 1)]
    journal.clear(spark.createDataFrame([("e1",)], "identity string"))
    assert [tuple(r) for r in journal.read().collect()] == [("e2", "a", 1, True)]


def test_index_finds_what_a_scan_finds_and_reads_fewer_blocks(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text", "source")
    docs = docs.unionByName(spark.createDataFrame([("n", None, "x"), ("o", "An ODD needle-in here", "x"), ("e", "", "x")], docs.schema))
    index = textindex.TextIndex(spark, f"{tmp_path}/i", "source string", blocks=32)
    index.add(docs, ("load", 1))
    index.add(docs, ("load", 1))
    for query in ("needle-IN", "an", "x", "no such words at all"):
        want = trend.search(docs, "text", "id", query)
        assert sorted(map(str, index.search(query).select("id", "source", "snippet").collect())) == sorted(map(str, want.select("id", "source", "snippet").collect())), query
    assert index.candidates("needle-in").count() == 1 and index.candidates("no such words at all").count() == 0

"""Helpers shared by the corpus operators: the shared folder, written intermediates, shared values, worker caches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of runs that a worker process keeps at most.
KEPT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset on one machine (tests) a temporary
    folder is made and remembered in the session; a cluster without the setting is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracemill.shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.tracemill.shared", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; the file system drops it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath.getParent())
    fs.deleteOnExit(jpath.getParent())
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracemill_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete intermediates of `materialize` that no plan needs any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tracemill_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Shared:
    """A value that workers read, broadcast as bytes in which its classes go by value: workers need no copy of this package."""

    def __init__(self, spark: SparkSession, value, owner: str):
        self.key = (owner, "shared", uuid.uuid4().hex)
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return worker_cache(self.key, lambda: pickle.loads(self._bytes.value))


def release() -> None:
    """Give what was freed back to the system; else Python, Arrow and the C library keep it for as long as the process lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


def released(run):
    """`run`, for mapInArrow, with `release` after each task: a worker that waits counts in its executor's memory."""

    def task(batches):
        yield from run(batches)
        release()

    return task


def worker_cache(key: tuple, make):
    """One value per Python worker process; it outlives tasks, because Spark reuses workers.

    The key begins with the operator that owns the value.  A worker that turns to another operator drops the values of
    the one before, and of values that belong to one run (the key's second part is "shared") keeps the latest `KEPT`.
    """
    store = sys.__dict__.setdefault("_tracemill_worker_cache", {})
    if key not in store:
        own = [k for k in store if k[:2] == (key[0], "shared")]
        olds = [k for k in store if k[0] != key[0]] + (own[: 1 - KEPT] if key[1] == "shared" else [])
        for old in olds:
            del store[old]
        if olds:
            release()
        store[key] = make()
    return store[key]


def fold(id_col: Column, modulus: int, held: int) -> Column:
    """True for rows of the held-out fold: crc32(id as text) mod `modulus` = `held`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))

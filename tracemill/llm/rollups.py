"""Token counts kept as additive totals by source, language and tokenizer version.

Changes come as batches of signed rows: an insert adds a document's counts, a delete takes them back, a revision is
both at once.  A batch is reduced to one signed row per group and written to a folder of its own; the commit record,
written last, names that folder and makes it count.  A record is created once, so of several writers of one batch one
counts, and a batch that has been committed is never applied again: replays and retries after lost executors change
nothing.  Totals are the sum over committed batches; `compact` folds them into one, and their ids into one table.

Defined results: null source and language are groups of their own; null text has zero tokens; a delete that cancels
an insert leaves no group behind; an empty batch commits and changes nothing; repeated rows count each; a record that
its writer left empty does not count, and the batch can be applied again.  `count_tokens` refuses rows that have a column
named like one that it adds.

A record is created without overwriting, which file systems like HDFS do in one step.  Object stores may let two writers
of one batch both create it; there a batch must have one writer at a time.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import worker_cache

GROUP = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"
SALTS = 32
#: The batch that `compact` makes; a caller's batch can't have this name.
COMPACTED = "compacted"


class Rollup:
    """Totals under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _records(self) -> dict[str, str]:
        """Folder of each batch by its id; records without one don't count."""
        where, out = self._at("commits"), {}
        for s in self._fs.listStatus(where) if self._fs.exists(where) else ():
            if s.getLen():
                stream = self._fs.open(s.getPath())
                out[s.getPath().getName()] = stream.readUTF()
                stream.close()
        return out

    def _folded(self) -> DataFrame:
        """Ids of batches that totals of an earlier time hold."""
        schema = "id string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/folded") if self._fs.exists(self._at("folded")) else self.spark.createDataFrame([], schema)

    def committed(self) -> list[str]:
        return sorted(self._records())

    def _done(self, batch_id: str) -> bool:
        where = self._at("commits", batch_id)
        there = self._fs.exists(where) and self._fs.getFileStatus(where).getLen() > 0
        return there or not self._folded().filter(F.col("id") == batch_id).isEmpty()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of (source, lang, tokenizer_version, sign, tokens); False if it was committed before."""
        if batch_id == COMPACTED or "/" in batch_id:
            raise ValueError(f"{batch_id!r} can't name a batch")
        if self._done(batch_id):
            return False
        # salted, then summed: a source that holds a third of all rows is no single task
        part = changes.withColumn("salt", F.pmod(F.xxhash64("sign", "tokens"), F.lit(SALTS)))
        part = part.groupBy(*GROUP, "salt").agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        total = part.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        folder = f"{batch_id}-{uuid.uuid4().hex}"
        total.coalesce(1).write.parquet(f"{self.path}/deltas/{folder}")
        return self._commit(batch_id, folder)

    def _commit(self, batch_id: str, folder: str) -> bool:
        where = self._at("commits", batch_id)
        empty = self._fs.exists(where) and not self._fs.getFileStatus(where).getLen()
        self._fs.mkdirs(where.getParent())
        try:
            stream = self._fs.create(where, empty)  # fails if another writer was first
        except Exception:  # noqa: BLE001  the JVM's error for a file that exists
            if self._done(batch_id):
                return False
            raise
        stream.writeUTF(folder)
        stream.close()
        return True

    def totals(self) -> DataFrame:
        folders = sorted(self._records().values())
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/deltas/{n}" for n in folders))
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self, path: str) -> Rollup:
        """The totals as one batch in a new folder, with the ids of the batches that it holds still known there."""
        new = Rollup(self.spark, path)
        ids = self.spark.createDataFrame([(n,) for n in self.committed()], "id string")
        self._folded().union(ids).distinct().coalesce(1).write.parquet(f"{new.path}/folded")
        self.totals().coalesce(1).write.parquet(f"{new.path}/deltas/{COMPACTED}")
        new._commit(COMPACTED, COMPACTED)
        return new


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, version: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, plus tokenizer_version and tokens, by a byte-level BPE vocabulary file."""
    if taken := {"tokenizer_version", "tokens"} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} would be there twice")
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # the size of a vocabulary
    at, names = docs.columns.index(text_col), docs.columns
    schema = docs.select("*").schema.add("tokenizer_version", "string").add("tokens", "long")

    def encoder():
        import tiktoken

        ranks, pattern = shared.value
        return tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def run(batches):
        encode = worker_cache(("rollups", "encoder", version, len(shared.value[0])), encoder).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], [*names, "tokenizer_version", "tokens"])

    return docs.mapInArrow(run, schema)


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(1).alias("sign"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))

"""Tables that change by key: rows in hash buckets, whose files a manifest names.

A change writes new files for the buckets that it touches and then one new manifest, created without overwriting, which is
what makes it count.  Readers see the newest manifest, so a failed write leaves the old state and a change is seen whole.
A writer may number its batches; a batch that the manifest holds already is skipped, so deliveries can be repeated.

`append` adds files to buckets and reads nothing; `upsert` and `replace` rewrite the touched buckets only.  What a change
costs is in proportion to what it touches.  Manifests hold a few names a bucket and are read on the driver.

Defined results: rows of a null key are in a bucket of their own key like any other; an empty change commits nothing but its
batch number; of two writers of one version one counts, the other starts again from the new state.  File systems must create
a file in one step only if it isn't there (HDFS and local ones do); on object stores a table must have one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Changes that are tried again after another writer was first; files that a bucket's rows are dealt to by their content, so that a key with most rows is no single task.
TRIES, FILES = 5, 4
PLAIN = ("string", "long", "integer", "double", "boolean", "timestamp", "date")


class KeyedStore:
    """Rows of `schema` below `path`, a folder that driver and executors share, by the columns `keys`."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        # by its text, so that any column may hold nulls
        self.schema = spark.createDataFrame([], schema.simpleString() if isinstance(schema, StructType) else schema).schema
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # the manifest

    def _versions(self) -> list[int]:
        where = self._jvm.Path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(where) if s.getLen()] if self._fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> dict:
        """{version, files: {bucket: [folder]}, batches: {writer: number}}"""
        versions = self._versions()
        if not versions:
            return {"version": 0, "files": {}, "batches": {}}
        stream = self._fs.open(self._jvm.Path(f"{self.path}/manifests/{versions[-1]}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"version": versions[-1]}

    def _commit(self, manifest: dict) -> bool:
        where = self._jvm.Path(f"{self.path}/manifests/{manifest['version'] + 1}")
        self._fs.mkdirs(where.getParent())
        body = bytearray(json.dumps({k: manifest[k] for k in ("files", "batches")}).encode())
        # written beside and renamed, so that nobody reads a half of it; a rename onto a file fails
        beside = self._jvm.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(body)
        stream.close()
        if self._fs.exists(where) or not self._fs.rename(beside, where):
            self._fs.delete(beside, False)
            return False
        return True

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders by bucket."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("_bucket", self._bucket())
        dealt.repartition("_bucket", F.pmod(F.xxhash64(*(f.name for f in self.schema.fields if f.dataType.typeName() in PLAIN)), F.lit(FILES))).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        out = {}
        for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/{name}")):
            part = s.getPath().getName()
            if part.startswith("_bucket="):
                out[part.removeprefix("_bucket=")] = [f"{name}/{part}"]
        return out

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the keys in `of`, for which only their buckets are read."""
        files = self.manifest()["files"]
        if of is None:
            return self._read([f for own in files.values() for f in own])
        keys = of.select(*self.keys).distinct()
        touched = [str(r.b) for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets at most
        return _of(self._read([f for b in touched for f in files.get(b, [])]), keys, self.keys, "left_semi")

    def _change(self, make, batch: tuple[str, int] | None) -> bool:
        for _ in range(TRIES):
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            changed = make(now["files"])
            new = {"version": now["version"], "files": {**now["files"], **changed}, "batches": {**now["batches"], **({batch[0]: batch[1]} if batch else {})}}
            new["files"] = {b: f for b, f in new["files"].items() if f}
            if self._commit(new):
                return True
        raise RuntimeError(f"{self.path}: other writers were first {TRIES} times")

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows; False if the batch (writer, number) was there before."""

        def make(files: dict) -> dict:
            return {b: [*files.get(b, []), *own] for b, own in self._write(rows).items()}

        return self._change(make, batch)

    def replace(self, rows: DataFrame, of: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Put `rows` in the place of all rows of their keys, and of the keys in `of`, which may have none now."""
        from tracemill.storage import written

        rows = written(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)), "change")
        keys = rows.select(*self.keys) if of is None else rows.select(*self.keys).unionByName(of.select(*self.keys))
        keys = written(keys.distinct(), "keys")
        touched = [str(r.b) for r in keys.select(self._bucket().alias("b")).distinct().collect()]

        def make(files: dict) -> dict:
            old = _of(self._read([f for b in touched for f in files.get(b, [])]), keys, self.keys, "left_anti")
            return {b: [] for b in touched} | self._write(old.unionByName(rows))

        return self._change(make, batch)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """One row a key: a change takes the place of what was there."""
        return self.replace(rows, batch=batch)

    def compact(self, most: int = 16) -> int:
        """Rewrite buckets of more than `most` folders, as appending leaves them; the number of buckets rewritten."""
        many = [b for b, f in self.manifest()["files"].items() if len(f) > most]

        def make(files: dict) -> dict:
            return {b: [] for b in many} | self._write(self._read([f for b in many for f in files.get(b, [])]))

        if many:
            self._change(make, None)
        return len(many)

    def vacuum(self, keep: int = 2) -> int:
        """Delete files that none of the newest `keep` manifests names, and older manifests; the number of folders deleted."""
        versions = self._versions()
        named: set[str] = set()
        for v in versions[-keep:]:
            stream = self._fs.open(self._jvm.Path(f"{self.path}/manifests/{v}"))
            named |= {f for own in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["files"].values() for f in own}
            stream.close()
        gone = 0
        where = self._jvm.Path(f"{self.path}/data")
        for change in self._fs.listStatus(where) if self._fs.exists(where) else ():
            for part in self._fs.listStatus(change.getPath()):
                name = part.getPath().getName()
                if name.startswith("_bucket=") and f"data/{change.getPath().getName()}/{name}" not in named:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            self._fs.delete(self._jvm.Path(f"{self.path}/manifests/{v}"), False)
        return gone


def _of(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """Rows whose key is, or isn't, among `keys`; nulls are equal."""
    right = keys.select(*(F.col(k).alias(f"_key_{k}") for k in names))
    same = F.lit(True)
    for k in names:
        same = same & rows[k].eqNullSafe(right[f"_key_{k}"])
    return rows.join(right, same, how)


class Journal:
    """Repeats of experiments, appended as they end; of several rows of one (identity, task, repeat) the last written counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.store = KeyedStore(spark, path, f"{schema}, _batch long", ["identity"], buckets)

    def append(self, rows: DataFrame, writer: str, number: int) -> bool:
        """Add a writer's batch of rows (identity, task_id, repeat, ...); a batch written twice counts once."""
        order = self.store.manifest()["version"] + 1
        return self.store.append(rows.withColumn("_batch", F.lit(order).cast("long")), (writer, number))

    def read(self, identities: DataFrame | None = None) -> DataFrame:
        from tracemill.streaming.tail import last_writes

        return last_writes(self.store.read(identities), ["identity", "task_id", "repeat"], "_batch").drop("_batch")

    def missing(self, planned: DataFrame) -> DataFrame:
        """Of planned (identity, task_id, repeat) those that have no row yet: what is left to do after a stop."""
        return planned.join(self.read(planned).select("identity", "task_id", "repeat"), ["identity", "task_id", "repeat"], "left_anti")

    def clear(self, identities: DataFrame) -> bool:
        """Forget experiments."""
        return self.store.replace(self.store.read(identities).limit(0), of=identities)

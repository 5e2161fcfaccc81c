"""Intermediates that cut a plan's lineage: Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracemill.shared", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.tracemill.shared", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read again; the file system drops it when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath.getParent())
    fs.deleteOnExit(jpath.getParent())
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

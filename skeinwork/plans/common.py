"""Helpers of the query plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or the one that spark.checkpoint.dir names. One
    of our own is made on a single machine only, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinwork-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, worked out once; the table goes at the end of the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drop cached tables and what the session has cut, as after a run of queries whose results are no longer needed."""
    spark.catalog.clearCache()
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        at = spark._jvm.org.apache.hadoop.fs.Path(have.get())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

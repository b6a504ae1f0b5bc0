"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; every other character belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on a single machine
    (tests), and an error on a cluster, whose executors would each write to a disk that no other reads."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skeinwork-")
        sc.setCheckpointDir(named)
    return named


#: Folders of the stages that scopes will remove, innermost scope last.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the stage tables that were written within it; whatever is still needed must be written elsewhere before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, batch: int | None = None, keep: bool = False) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation.
    batch: rows of an Arrow batch while df is worked out, for wide rows. The table is removed with the scope around it,
    unless it is to be kept, and at the end of the session at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if _scopes and not keep:
        _scopes[-1].append(path)
    try:
        if batch:
            spark.conf.set(key, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df doesn't have, one for each of `bases`."""
    return [free_name(df, b) for b in bases]


def bounded(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """About `most` of rows, or all if there are fewer: those whose hash `by` is lowest, as a filter at a rate from the
    count, so that nothing is sorted or gathered. The same rows on every run; rows of equal hash go together."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(by, F.lit(1 << 40)) < int((1 << 40) * most / n))


def bitmap(keys: DataFrame, column: Column, bits: int) -> np.ndarray:
    """Which of 2^bits places the values of `column`, as place numbers, take; the driver gets a row of 4 KB for every
    32,768 places, whatever the number of rows."""
    at = keys.select((column + 1).alias("at")).select(F.expr("bitmap_bucket_number(at)").alias("bucket"), F.expr("bitmap_bit_position(at)").alias("bit"))
    out = np.zeros(1 << bits, bool)
    for r in at.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect():
        part = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little")
        first = (r["bucket"] - 1) * len(part)
        held = part[: max(0, len(out) - first)]
        out[first : first + len(held)] = held
    return out

"""The sink and source of family datasets: tables of text columns, as CSV with a header or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(rows: DataFrame, path: str, kind: str = "csv") -> str:
    """Write rows to a folder, in parts; texts with commas are quoted. An existing folder is replaced."""
    out = rows.write.mode("overwrite")
    if kind == "csv":
        out = out.option("header", True).option("quoteAll", True)
    out.format(kind).save(path)
    return path


def read(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """What write wrote; the columns of a CSV are texts."""
    return spark.read.option("header", True).format(kind).load(path)

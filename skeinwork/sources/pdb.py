"""Protein structures in the fixed-width PDB format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_code(code: Column) -> tuple[Column, Column]:
    """(structure, chain) of codes such as 5osqA: four characters in upper case, and the rest or null. Shorter codes are
    null in both."""
    ok = F.length(code) >= 4
    return F.when(ok, F.upper(F.substring(code, 1, 4))), F.when(ok, F.nullif(F.substring(code, 5, 1 << 20), F.lit("")))


def alpha_carbons(lines: DataFrame, chain: str, model: int = 0) -> DataFrame:
    """(i, res_seq, res_name, x, y, z) of one chain of lines(value, n), n the line's place in the file: alpha carbons of
    standard residues (ATOM records), the first of each residue, numbered from 1 along the chain. Lines before any MODEL
    record belong to model 0."""
    v = F.col("value")
    cut = lambda a, n: F.trim(F.substring(v, a, n))
    rows = lines.where(v.startswith("ATOM") | v.startswith("MODEL"))
    # MODEL records are few; files without any need no running count
    rows = rows.withColumn("model", F.greatest(F.sum(F.when(v.startswith("MODEL"), 1).otherwise(0)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 1, F.lit(0)))
    rows = rows.where(v.startswith("ATOM") & (F.col("model") == model) & (F.substring(v, 22, 1) == chain) & (cut(13, 4) == "CA"))
    got = rows.select("n", cut(23, 4).cast("int").alias("res_seq"), cut(27, 1).alias("icode"), cut(18, 3).alias("res_name"), cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"), cut(47, 8).cast("double").alias("z"))
    first = got.groupBy("res_seq", "icode").agg(F.min_by(F.struct("n", "res_name", "x", "y", "z"), "n").alias("a")).select("res_seq", "a.*")
    return first.select(F.row_number().over(Window.orderBy("n")).cast("bigint").alias("i"), "res_seq", "res_name", "x", "y", "z")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(value, n) of a PDB file; n orders its lines by split and place."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))


def theta_arcs(ca: DataFrame, pieces: list[tuple[int, int, int, int]]) -> DataFrame:
    """(g, seq, x, y, z): arcs as runs of residues. pieces: (arc, order, first, last), run upwards or downwards."""
    spark = ca.sparkSession
    spec = spark.createDataFrame(pieces, "g long, ord int, a int, b int")
    runs = spec.select("g", "ord", F.posexplode(F.expr("sequence(a, b, if(b >= a, 1, -1))")).alias("k", "i"))
    w = Window.partitionBy("g").orderBy("ord", "k")
    return runs.join(ca.select("i", "x", "y", "z"), "i").select("g", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "x", "y", "z")

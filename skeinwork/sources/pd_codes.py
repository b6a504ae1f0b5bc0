"""Planar-diagram strings: V[...] and X[...] joined by semicolons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(rows: DataFrame) -> DataFrame:
    """rows(code_id, code) as (code_id, pos, kind, place, label, bad): one row per label, one with null label for an empty
    bracket; blanks between tokens are skipped, and a token off the grammar has bad true."""
    tokens = rows.select("code_id", F.posexplode(F.split("code", ";")).alias("pos", "raw")).select("code_id", "pos", F.trim("raw").alias("token")).where("token <> ''")
    bad = ~F.col("token").rlike(r"^[VX]\[[0-9]*(,[0-9]+)*,*\]$")
    inner = F.regexp_extract("token", r"\[([0-9,]*)\]", 1)
    labels = F.filter(F.split(F.when(bad, "").otherwise(inner), ","), lambda x: x != "")
    got = tokens.select("code_id", "pos", F.substring("token", 1, 1).alias("kind"), bad.alias("bad"), F.posexplode_outer(labels).alias("place", "label"))
    return got.select("code_id", "pos", "kind", "place", F.col("label").cast("bigint").alias("label"), "bad")


def validate(parsed: DataFrame) -> DataFrame:
    """(code_id, labels, wrong, ok): every label must occur exactly twice, and no token may be bad."""
    counts = parsed.where("label IS NOT NULL").groupBy("code_id", "label").agg(F.count("*").alias("n"))
    sums = counts.groupBy("code_id").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") != 2, 1).otherwise(0)).alias("wrong"))
    bad = parsed.groupBy("code_id").agg(F.max("bad").alias("bad"))
    got = bad.join(sums, "code_id", "left")
    return got.select("code_id", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("wrong", F.lit(0)).alias("wrong"), (~F.col("bad") & (F.coalesce("wrong", F.lit(0)) == 0)).alias("ok"))

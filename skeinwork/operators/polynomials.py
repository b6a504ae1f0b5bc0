"""Laurent polynomials as term tables (g, e, coeff) with exact integer coefficients.

Addition is a union with a sum, multiplication a join with a sum, substitution a join on a table of powers; equal
polynomials are equal tables once zero terms are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"


def add(p: DataFrame, q: DataFrame) -> DataFrame:
    return clean(p.unionByName(q))


def clean(p: DataFrame) -> DataFrame:
    """One row per exponent, without zeros."""
    return p.groupBy("g", "e").agg(F.sum("coeff").cast(EXACT).alias("coeff")).where("coeff <> 0")


def multiply(p: DataFrame, q: DataFrame) -> DataFrame:
    b = q.select("g", F.col("e").alias("e2"), F.col("coeff").alias("c2"))
    return clean(p.join(b, "g").select("g", (F.col("e") + F.col("e2")).alias("e"), (F.col("coeff") * F.col("c2")).cast(EXACT).alias("coeff")))


def equal(p: DataFrame, q: DataFrame) -> DataFrame:
    """(g, equal) over the graphs of either."""
    both = clean(p.unionByName(q.select("g", "e", (-F.col("coeff")).cast(EXACT).alias("coeff"))))
    every = p.select("g").unionByName(q.select("g")).distinct()
    return every.join(both.groupBy("g").agg(F.count("*").alias("n")), "g", "left").select("g", F.col("n").isNull().alias("equal"))


def normalise(p: DataFrame) -> DataFrame:
    """Times (-A)^-lowest, so that the lowest exponent is 0."""
    low = p.groupBy("g").agg(F.min("e").alias("low"))
    return p.join(low, "g").select("g", (F.col("e") - F.col("low")).alias("e"), F.when(F.col("low") % 2 == 0, F.col("coeff")).otherwise(-F.col("coeff")).cast(EXACT).alias("coeff"))


def sigma_powers(spark: SparkSession, top: int) -> DataFrame:
    """(k, e, coeff) of (Y + 1 + 1/Y)^k for k up to `top`: exact, built once on the driver; (top + 1)^2 rows."""
    rows, now = [], {0: 1}
    for k in range(top + 1):
        rows += [(k, e, str(c)) for e, c in now.items()]
        nxt: dict[int, int] = {}
        for e, c in now.items():
            for d in (-1, 0, 1):
                nxt[e + d] = nxt.get(e + d, 0) + c
        now = nxt
    return spark.createDataFrame(rows, "k int, e int, coeff string").withColumn("coeff", F.col("coeff").cast(EXACT))


def expand_sigma(p: DataFrame, top: int) -> DataFrame:
    """Terms in sigma as terms in Y, by a join with the powers of Y + 1 + 1/Y."""
    powers = sigma_powers(p.sparkSession, top).select("k", F.col("e").alias("y"), F.col("coeff").alias("c"))
    return clean(p.join(powers, p["e"] == powers["k"]).select("g", F.col("y").alias("e"), (F.col("coeff") * F.col("c")).cast(EXACT).alias("coeff")))


def text(p: DataFrame, name: str = "poly") -> DataFrame:
    """(g, poly): terms as e:coeff by exponent."""
    parts = F.array_sort(F.collect_list(F.struct("e", F.col("coeff").cast("string").alias("c"))))
    return p.groupBy("g").agg(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["e"], x["c"])), " ").alias(name))


def consensus(tries: DataFrame, overlaps: int = 2) -> DataFrame:
    """(g, poly, found_at, status): for tries(g, ord, poly) the polynomial that first comes `overlaps` times, or no_agreement."""
    from pyspark.sql import Window

    run = Window.partitionBy("g", "poly").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    hit = tries.where("poly IS NOT NULL").withColumn("n", F.count("*").over(run)).where(F.col("n") == overlaps)
    first = hit.groupBy("g").agg(F.min(F.struct("ord", "poly")).alias("x")).select("g", F.col("x.poly").alias("poly"), F.col("x.ord").alias("found_at"))
    return tries.select("g").distinct().join(first, "g", "left").select("g", F.coalesce("poly", F.lit("")).alias("poly"), F.coalesce("found_at", F.lit(-1)).alias("found_at"), F.when(F.col("found_at").isNull(), "no_agreement").otherwise("agreed").alias("status"))

"""Momentum grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU_SPAN = ((-math.pi, math.pi),) * 3


def axis(i: Column, span: tuple[float, float], n: int) -> Column:
    lo, hi = span
    return F.lit(lo) + i * F.lit((hi - lo) / (n - 1))


def kgrid(spark: SparkSession, n: int, span=TAU_SPAN, partitions: int | None = None) -> DataFrame:
    """(ix, iy, iz, kx, ky, kz): inclusive steps on each axis, z fastest. One range over all points, so the grid is
    distributed from the start and no axis is ever joined or sent around."""
    i = F.col("id")
    cells = spark.range(0, n**3, 1, partitions) if partitions else spark.range(n**3)
    ijk = cells.select((i / F.lit(n * n)).cast("bigint").alias("ix"), F.expr(f"(id div {n}) % {n}").alias("iy"), F.expr(f"id % {n}").alias("iz"))
    return ijk.select("ix", "iy", "iz", *[axis(F.col(f"i{a}"), s, n).alias(f"k{a}") for a, s in zip("xyz", span)])

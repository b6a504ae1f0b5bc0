"""Slabs: hopping terms of Bloch matrices along one axis, open and periodic matrices, and surface modes.

A model is a finite Fourier sum, a table (i, j, n1, n2, n3, re, im) of the coefficients of exp(i (n1 k1 + n2 k2 + n3 k3))
in matrix entry (i, j). Hoppings along an axis are its rows by shift with the other two momenta put in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: direction: (axis that becomes real space, first and second momentum that stays), in cyclic order.
AXES = {"x": (1, 2, 3), "y": (2, 3, 1), "z": (3, 1, 2)}


def hoppings(fourier: DataFrame, mesh: DataFrame, direction: str) -> DataFrame:
    """(k2, k3, shift, i, j, re, im) over a mesh(k2, k3) of the two other momenta."""
    if direction not in AXES:
        raise ValueError(f"direction must be x, y or z, not {direction!r}")
    a, b, c = AXES[direction]
    t = F.col(f"n{b}") * F.col("k2") + F.col(f"n{c}") * F.col("k3")
    rows = mesh.crossJoin(F.broadcast(fourier))  # a model has a few dozen terms
    re, im = F.col("re") * F.cos(t) - F.col("im") * F.sin(t), F.col("re") * F.sin(t) + F.col("im") * F.cos(t)
    return rows.select("k2", "k3", F.col(f"n{a}").alias("shift"), "i", "j", re.alias("re"), im.alias("im")).groupBy("k2", "k3", "shift", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def matrices(hops: DataFrame, sites: int, bands: int, periodic: bool) -> DataFrame:
    """(k2, k3, row, col, re, im): sum over shifts of S^shift x hop in sparse form; entries that meet are added."""
    n = F.explode(F.sequence(F.lit(0), F.lit(sites - 1)))
    rows = hops.select("*", n.alias("n"))
    to = F.col("n") + F.col("shift")
    rows = rows.withColumn("m", F.pmod(to, F.lit(sites)) if periodic else to).where((F.col("m") >= 0) & (F.col("m") < sites))
    return rows.groupBy("k2", "k3", (F.col("n") * bands + F.col("i")).cast("bigint").alias("row"), (F.col("m") * bands + F.col("j")).cast("bigint").alias("col")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def kron(a: DataFrame, b: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, value) of the Kronecker product of sparse a, b(row, col, value), b being rows x cols."""
    p, q = a.toDF("r1", "c1", "v1"), b.toDF("r2", "c2", "v2")
    return p.crossJoin(q).select((F.col("r1") * rows + F.col("r2")).alias("row"), (F.col("c1") * cols + F.col("c2")).alias("col"), (F.col("v1") * F.col("v2")).alias("value"))


def shift_matrix(spark, n: int, shift: int, periodic: bool) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("row"), (F.col("id") + shift).alias("col"))
    rows = rows.withColumn("col", F.pmod("col", F.lit(n))) if periodic else rows.where((F.col("col") >= 0) & (F.col("col") < n))
    return rows.withColumn("value", F.lit(1.0))


def eigenvalues(entries: DataFrame, size: int) -> DataFrame:
    """(k2, k3, band, re, im): eigenvalues of each mesh point's matrix, one numpy call per point."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((size, size), complex)
        h[pdf["row"], pdf["col"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        e = sorted(np.linalg.eigvals(h), key=lambda z: (round(z.real, 9), round(z.imag, 9)))
        return pd.DataFrame({"k2": pdf["k2"].iloc[0], "k3": pdf["k3"].iloc[0], "band": range(size), "re": [z.real for z in e], "im": [z.imag for z in e]})

    return entries.groupBy("k2", "k3").applyInPandas(run, "k2 double, k3 double, band int, re double, im double")


def surface_modes(values: DataFrame, tolerance: float) -> DataFrame:
    """(k2, k3, modes): eigenvalues with |E| under the tolerance, where there are any."""
    return values.where(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) < tolerance).groupBy("k2", "k3").agg(F.count("*").alias("modes"))

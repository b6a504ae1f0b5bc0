"""Vectors as whole numbers, which the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries beyond this are taken as this, so that they fit a long with an offset added.
MOST = 9.2e18


def integers(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of every entry as long, or null for a vector that is null or holds null or non-finite
    entries."""
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    fit = lambda x: F.least(F.greatest(x.cast("double") * float(scale), F.lit(-MOST)), F.lit(MOST))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(fit(x)).cast("long") + F.lit(offset).cast("long")))


def prevailing(rows: DataFrame, name: str) -> tuple[int, int, int]:
    """(length, rows, largest absolute entry) of the vectors in column `name` that have the most common length, the longer
    one of two that are as common. Lengths are counted, so the driver gets one row."""
    largest = F.max(F.array_max(F.transform(name, lambda x: F.abs(x))))
    found = rows.groupBy(F.size(name).alias("length")).agg(F.count("*").alias("n"), largest.alias("largest"))
    best = found.orderBy(F.desc("n"), F.desc("length")).first()
    return (best["length"], best["n"], best["largest"] or 0) if best else (0, 0, 0)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """An Arrow column of lists of one length, none of them null, as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), length)

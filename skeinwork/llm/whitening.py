"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers x. The fit list is each distinct vector x once. Tasks subtract a shift from x and add up sums and
cross products in whole numbers: vectors are cut into limbs of LIMB bits, so that products of SLICE rows are exact in
floating point, and partial sums leave a task as longs, one row per entry and power of the limb. Spark adds these up as
decimals, and the driver puts the limbs together as integers of any size: a table of length^2 / 2 rows for each of a few
powers, whatever the number of vectors. n X'X - S S' is formed from them without any rounding; only then is it divided by
n^2, converted and decomposed.

Components are numbered by falling eigenvalue. One whose eigenvalue isn't above length * eps times the largest can't be
told from rounding and has no direction of its own: it is left out, as are those beyond `components`.

Null vectors and vectors with null or non-finite entries are dropped, and so are vectors of another length than most have
(the longer of two lengths that are as common). Entries whose scaled value is beyond 9.2e18 count as that. Rows that repeat
and null vec_ids are kept; each row gets its rows of the result, and the fit list counts equal vectors once however many
rows hold them (counted before the shuffle). An empty table, vectors of no entries, and a single distinct vector, which
has no variance, give an empty result. A deviation that no long can hold is null; deviation_exact has it as text. Columns
other than vec_id and embedding aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import integers, matrix, prevailing

#: Bits of a limb; products of SLICE rows of limbs are at most SLICE * 2^(2 LIMB) = 2^52.
LIMB, SLICE = 20, 4096
LONG = 2**63 - 1


@dataclass
class Scatter:
    """n vectors less `shift`: their sums, and the exact n X'X - S S', as Python integers."""

    n: int
    shift: int
    sums: list[int]
    scatter: list[list[int]]


@dataclass
class Model:
    """Components (rows of `axes`) by falling eigenvalue `values` of the covariance, whose trace is `trace`."""

    fit: Scatter
    axes: np.ndarray
    values: np.ndarray
    trace: float


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers as sum of limb_k * 2^(LIMB k), every limb at most 2^LIMB in size, as floats."""
    out, most = [], 1 << LIMB
    while len(x) and (x.max() > most or x.min() < -most):
        out.append((x & (most - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def _partial_sums(length: int, shift: int):
    """Kernel: rows (i, j, power, v): sums of products of entries i <= j, of entry j (i = -1), and the count (i = j = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square: dict[int, np.ndarray] = {}
        added: dict[int, int] = {}
        line: dict[int, np.ndarray] = {}
        upper = np.triu_indices(length)
        n = 0

        def rows(i, j, power, v) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(v), power), pa.int32()), pa.array(v, pa.int64())], ["i", "j", "power", "v"])

        for batch in batches:
            everything = matrix(batch.column("x"), length) - shift
            n += len(everything)
            for at in range(0, len(everything), SLICE):
                parts = limbs(everything[at : at + SLICE])
                for a, p in enumerate(parts):
                    line[a] = line.get(a, 0) + p.sum(0).astype(np.int64)
                    for b, q in enumerate(parts):
                        square[a + b] = square.get(a + b, 0) + (p.T @ q).astype(np.int64)
                        added[a + b] = added.get(a + b, 0) + 1
                for power in [k for k, times in added.items() if times > 900]:  # of 2^52 each: 2^62 at most
                    yield rows(*upper, power, square.pop(power)[upper])
                    del added[power]
        for power, m in square.items():
            yield rows(*upper, power, m[upper])
        for power, s in line.items():
            yield rows(np.full(length, -1), np.arange(length), power, s)
        yield rows([-1], [-1], 0, [n])

    return run


def exact_scatter(distinct: DataFrame, length: int, shift: int) -> Scatter:
    """The scatter of distinct(x), arrays of longs of one length. The driver gets one number for each pair of entries and
    each limb power that occurs."""
    got = distinct.select("x").mapInArrow(_partial_sums(length, shift), "i int, j int, power int, v long")
    total = got.groupBy("i", "j", "power").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    n, sums, products = 0, [0] * length, [[0] * length for _ in range(length)]
    for i, j, power, v in total:
        v = int(v) << (LIMB * power)
        if j < 0:
            n += v
        elif i < 0:
            sums[j] += v
        else:
            products[i][j] += v
    scatter = [[0] * length for _ in range(length)]
    for i in range(length):
        for j in range(i, length):
            scatter[i][j] = scatter[j][i] = n * products[i][j] - sums[i] * sums[j]
    return Scatter(n, shift, sums, scatter)


def decompose(fit: Scatter, components: int) -> Model:
    """The leading components of the covariance, the exact scatter over n^2; integers are divided with one rounding."""
    cov = np.array([[x / fit.n**2 for x in row] for row in fit.scatter]) if fit.n else np.zeros((0, 0))
    if not cov.size:
        return Model(fit, np.zeros((0, len(fit.sums))), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > len(values) * np.finfo(float).eps * values[0]).sum()) if values[0] > 0 else 0
    k = min(k, components)
    return Model(fit, np.ascontiguousarray(vectors[:, :k].T), values[:k], sum(fit.scatter[i][i] for i in range(len(values))) / fit.n**2)


def centred(x: np.ndarray, fit: Scatter) -> np.ndarray:
    """n x - S, exact: longs where they fit, else Python integers."""
    largest = max(int(x.max()) - fit.shift, fit.shift - int(x.min()), 0) if x.size else 0
    if fit.n * largest + max(map(abs, fit.sums), default=0) < LONG:
        return fit.n * (x - fit.shift) - np.array(fit.sums, np.int64)
    return fit.n * (x.astype(object) - fit.shift) - np.array(fit.sums, object)


def whiten(d: np.ndarray, model: Model) -> np.ndarray:
    """Rows n x - S projected on the components, each over its deviation."""
    return (d / model.fit.n).astype(float) @ model.axes.T / np.sqrt(model.values)


def squares(d: np.ndarray) -> list[int]:
    """The sum of squares of every row, exact."""
    largest = max(int(d.max()), -int(d.min()), 0) if d.size else 0
    if d.dtype != object and d.shape[1] * largest**2 < LONG:
        return (d * d).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity. Whitened values are centred
    by the exact sums before they are multiplied; what rounding leaves of their mean is taken off too."""
    k, length = len(model.values), len(model.fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = whiten(centred(matrix(batch.column("x"), length), model.fit), model)
            line, square = line + w.sum(0), square + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i], pa.int32()), pa.array(np.r_[np.arange(k), j], pa.int32()), pa.array(np.r_[line, square[i, j]], pa.float64())], ["i", "j", "v"])

    got = distinct.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / model.fit.n).alias("v")).collect()
    mean = {r["j"]: r["v"] for r in got if r["i"] < 0}
    return max((abs(r["v"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in got if r["i"] >= 0), default=0.0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def whitened(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """One row for each vector of vectors(vec_id, embedding) and component; see the module."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale, offset).alias("x")).where("x IS NOT NULL")
    length, n, _ = prevailing(rows, "x")
    rows = rows.where(F.size("x") == length)
    if not n or not length:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    distinct = stage(rows.select("x").distinct(), "whitening-fit")
    model = decompose(exact_scatter(distinct, length, offset), components)
    k = len(model.values)
    error = identity_error(distinct, model) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = centred(matrix(batch.column("x"), length), model.fit)
            exact = squares(d)
            again = pa.array(np.repeat(np.arange(len(d)), k))
            fixed = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(len(again), np.int64)))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1), len(d)), pa.int32()), fixed(model.fit.n, pa.int64()),
                pa.array([v if v <= LONG else None for v in exact], pa.int64()).take(again), pa.array(whiten(d, model).ravel(), pa.float64()),
                pa.array(np.tile(model.values / model.trace, len(d)), pa.float64()), fixed(error, pa.float64()), pa.array(list(map(str, exact)), pa.string()).take(again),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA) if k else vectors.sparkSession.createDataFrame([], SCHEMA)


def query(vectors: DataFrame) -> DataFrame:
    """The contract of op11: up to 16 rows per vector."""
    return whitened(vectors)

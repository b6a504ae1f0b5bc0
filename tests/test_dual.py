"""Dual numbers against central differences and against closed forms."""

import cmath
import math
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import dual
from skeinwork.operators import fields, models
from skeinwork.sources.grids import kgrid

EXPRESSIONS = {
    "quotient": (lambda x, y, m: dual.sin(x * y) / (m + dual.exp(2j * y)), lambda x, y, m: cmath.sin(x * y) / (m + cmath.exp(2j * y))),
    "powers": (lambda x, y, m: (x - 1j * y) ** 3 - 2 / (3 + x**2) + x**0, lambda x, y, m: (x - 1j * y) ** 3 - 2 / (3 + x**2) + 1),
    "root": (lambda x, y, m: dual.sqrt(dual.cos(x + 1j * y) * m + 4j), lambda x, y, m: cmath.sqrt(cmath.cos(x + 1j * y) * m + 4j)),
    "nested": (lambda x, y, m: -dual.exp(dual.sin(dual.cos(x) - y)) * m, lambda x, y, m: -cmath.exp(cmath.sin(cmath.cos(x) - y)) * m),
}


@pytest.mark.parametrize("name", sorted(EXPRESSIONS))
def test_derivatives_of_expressions(spark, name):
    columns, plain = EXPRESSIONS[name]
    r = random.Random(3)
    rows = [(r.uniform(-2, 2), r.uniform(-2, 2), r.uniform(2, 3)) for _ in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, m double")
    rows, value, parts = dual.derive(df, columns, ["x", "y"], (F.col("m"),))
    h = 1e-5
    for row in rows.select("x", "y", "m", *[c.alias(f"{n}{i}") for i, z in enumerate((value, *parts)) for n, c in zip(("re", "im"), z)]).collect():
        a, b, m = row[:3]
        want = [plain(a, b, m), (plain(a + h, b, m) - plain(a - h, b, m)) / (2 * h), (plain(a, b + h, m) - plain(a, b - h, m)) / (2 * h)]
        assert all(abs(complex(row[f"re{i}"], row[f"im{i}"]) - w) < 1e-6 * (1 + abs(w)) for i, w in enumerate(want))


def test_velocities_are_what_differences_tend_to(spark):
    """A user's model on a fine grid: within h^2 of the gradient by differences, where the band is smooth."""
    def model(kx, ky, kz):
        return dual.sin(kx) * dual.cos(ky) + 3, 0.4j, dual.exp(dual.cos(kz))

    n = 24
    grid = kgrid(spark, n)
    rows = dual.velocities(grid, model)
    h = (2 * math.pi) / (n - 1)
    got = fields.gradient(rows, "e_re", (h, h, h)).where(" AND ".join(f"i{a} BETWEEN 1 AND {n - 2}" for a in "xyz"))
    off = got.agg(*[F.max(F.abs(F.col(f"g{a}") - F.col(f"v{a}_re"))).alias(a) for a in "xyz"]).first()
    assert max(off) < 2 * h * h and "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_values_are_those_of_the_built_in_model(spark):
    def hopf(kx, ky, kz):
        z = dual.sin(kz) + 1j * (dual.cos(kx) + dual.cos(ky) + dual.cos(kz) - 2)
        f = z**2 + (dual.sin(kx) + 1j * dual.sin(ky)) ** 2
        return dual.real_part(f), 0.4j, dual.imaginary_part(f)

    grid = kgrid(spark, 9)
    a = fields.spectrum(grid, models.named("hopf", 0.4)).select("ix", "iy", "iz", "e_re", "e_im")
    b = dual.velocities(grid, hopf).select("ix", "iy", "iz", F.col("e_re").alias("r"), F.col("e_im").alias("i"))
    off = a.join(b, ["ix", "iy", "iz"]).agg(F.max(F.abs(F.col("e_re") - F.col("r"))), F.max(F.abs(F.col("e_im") - F.col("i"))), F.count("*")).first()
    assert max(off[:2]) < 1e-6 and off[2] == 729


def test_roots_at_zero_and_nulls(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 1.0), (None, 1.0, 1.0)], "kx double, ky double, kz double")
    got = dual.velocities(rows, lambda kx, ky, kz: (kx, 0.0, 0.0)).collect()
    assert (got[0]["e_re"], got[0]["vx_re"], got[1]["e_re"], got[1]["vx_re"]) == (0.0, None, None, None)
    assert dual.velocities(rows.limit(0), lambda kx, ky, kz: (kx, 0.0, 0.0)).count() == 0

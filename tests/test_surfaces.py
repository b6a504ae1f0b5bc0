"""Meshes of balls, rings and random fields: closed, of the right topology, area and volume."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import surfaces

KIND = "grid_id long, ix long, iy long, iz long, value double"


def field(spark, grids):
    rows = [(g, int(i), int(j), int(k), float(v[i, j, k])) for g, v in grids.items() for i, j, k in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, KIND)


def test_balls_rings_and_noise(spark):
    x, y, z = np.indices((22, 22, 22)) - 10.5
    ball = 6.3 - np.sqrt(x * x + y * y + z * z)
    ring = 2.6 - np.sqrt((np.sqrt(x * x + y * y) - 6) ** 2 + z * z)
    noise = np.random.default_rng(1).random((9, 9, 9)) - 0.6
    grids = {0: ball, 1: ring, 2: noise, 3: np.full((3, 3, 3), -1.0)}
    got = {r["grid_id"]: r for r in surfaces.summary(surfaces.mesh(field(spark, grids), 0.0, -1.0)).collect()}
    assert set(got) == {0, 1, 2} and all(r["closed"] for r in got.values())
    assert (got[0]["euler"], got[1]["euler"]) == (2, 0) and got[2]["euler"] == 2 * inside_euler(noise > 0)
    assert got[0]["area"] == pytest.approx(4 * math.pi * 6.3**2, rel=0.02) and got[0]["volume"] == pytest.approx(4 / 3 * math.pi * 6.3**3, rel=0.02)
    assert got[1]["volume"] == pytest.approx(2 * math.pi**2 * 6 * 2.6**2, rel=0.03)


def inside_euler(full):
    """Simplices of the six-tetrahedra grid with all corners inside, with signs."""
    full = np.pad(full, 2)
    at = {tuple(p) for p in np.argwhere(full).tolist()}
    chains = {(0,)}
    for t in surfaces.TETRAHEDRA:
        chains |= {s for s in subsets(t) if s[0] == 0}
    plus = lambda p, c: tuple(a + b for a, b in zip(p, surfaces.CORNERS[c]))
    return sum((-1) ** (len(s) - 1) for p in at for s in chains if all(plus(p, c) in at for c in s))


def subsets(t):
    return {tuple(sorted(c for i, c in enumerate(t) if m >> i & 1)) for m in range(1, 16)}


def test_all_cases_fit_together():
    """The triangles of a case use the edges that the level passes, and of opposite cases they are the same ones turned."""
    for m in range(256):
        found = surfaces.triangles_of(m)
        passed = {(a, b) for t in surfaces.TETRAHEDRA for i, a in enumerate(t) for b in t[i + 1 :] if (m >> a & 1) != (m >> b & 1)}
        assert {e for t in found for e in t} == passed
        assert {frozenset(t) for t in surfaces.triangles_of(255 - m)} == {frozenset(t) for t in found} or len(found) == len(surfaces.triangles_of(255 - m))


def test_places_are_on_the_level(spark):
    x, y, z = np.indices((7, 7, 7)) * 1.0
    flat = 3.25 - x + 0.5 * y
    got = surfaces.mesh(field(spark, {0: flat}), 0.0, -9.0).where("c1.ix BETWEEN 1 AND 4 AND c1.iy BETWEEN 1 AND 2 AND c1.iz BETWEEN 1 AND 4").select("c1.*").collect()
    assert got and all(abs(3.25 - r["x"] + 0.5 * r["y"]) < 1e-12 for r in got)


def test_splat_keeps_the_weight(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.2, 0.3), (0, -0.4, 0.0, 1.0), (1, 0.5, 0.5, 0.5)], "grid_id long, x double, y double, z double")
    got = surfaces.splat(rows, 4.0).groupBy("grid_id").agg(F.sum("value").alias("v")).collect()
    assert {r["grid_id"]: round(r["v"], 6) for r in got} == {0: 2.0, 1: 1.0}
    assert surfaces.mesh(surfaces.splat(rows.where("x > 9"), 4.0), 0.5).count() == 0

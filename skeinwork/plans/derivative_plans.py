"""Queries of derivatives by dual numbers at momenta that the embeddings name, with their DuckDB twins.

A vector's first three components, times pi, are a momentum; the fourth and fifth shift the model's mass and offset.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dual

GAMMA = 3.0


def points(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), *[(at(i) * math.pi).alias(f"k{a}") for i, a in enumerate("xyz")], (2 + at(3)).alias("m"), (0.5 + at(4)).alias("c"))


def mirrored(kx, ky, kz, m, c):
    """The mirrored Hopf link as a user would write it."""
    z = dual.cos(2 * kz) + c + 1j * (dual.cos(kx) + dual.cos(ky) + dual.cos(kz) - m)
    w = dual.sin(kx) + 1j * dual.sin(ky)
    f = z**2 - w**2
    return dual.real_part(f), 1j * GAMMA, dual.imaginary_part(f)


def r6(c, name):
    return (F.round(c, 6) + 0.0).alias(name)


def _velocity(spark, d):
    got = dual.velocities(points(spark, d), mirrored, F.col("m"), F.col("c"))
    return got.select("vec_id", *[r6(F.col(c), c) for c in ("e_re", "e_im", "vx_re", "vx_im", "vy_re", "vy_im", "vz_re", "vz_im")])


def _curvature(spark, d):
    got = dual.curvature(points(spark, d), mirrored, F.col("m"), F.col("c"), gamma=GAMMA)
    return got.select("vec_id", *[r6(F.col(c), c) for c in ("bx", "by", "bz")])


# derivatives by hand: f = z^2 - w^2, its parts fr and fi and their slopes
HAND = f"""WITH p AS (SELECT CAST(vec_id AS BIGINT) vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * CAST({math.pi!r} AS DOUBLE) k{a}' for i, a in enumerate('xyz'))}, 2 + CAST(embedding[4] AS DOUBLE) m, CAST(0.5 AS DOUBLE) + CAST(embedding[5] AS DOUBLE) c, CAST({GAMMA!r} AS DOUBLE) g FROM embeddings),
v AS (SELECT *, cos(2 * kz) + c zr, cos(kx) + cos(ky) + cos(kz) - m zi, sin(kx) wr, sin(ky) wi FROM p),
f AS (SELECT *, zr * zr - zi * zi - wr * wr + wi * wi fr, 2 * (zr * zi - wr * wi) fi, 2 * (zi * sin(kx) - wr * cos(kx)) xr, 2 * (-zr * sin(kx) - wi * cos(kx)) xi, 2 * (zi * sin(ky) + wi * cos(ky)) yr, 2 * (-zr * sin(ky) - wr * cos(ky)) yi,
 2 * (-2 * zr * sin(2 * kz) + zi * sin(kz)) tr, 2 * (-zr * sin(kz) - 2 * zi * sin(2 * kz)) ti FROM v)"""
SLOPES = {"x": ("xr", "xi"), "y": ("yr", "yi"), "z": ("tr", "ti")}
VELOCITY = HAND + ", s AS (SELECT *, fr * fr + fi * fi - g * g s FROM f), r AS (SELECT *, sqrt(abs(s)) e FROM s) SELECT vec_id, CASE WHEN s > 0 THEN round(e, 6) ELSE 0 END + 0.0 AS e_re, CASE WHEN s < 0 THEN round(e, 6) ELSE 0 END + 0.0 AS e_im, " + ", ".join(
    f"CASE WHEN s > 0 THEN round((fr * {r} + fi * {i}) / e, 6) WHEN s < 0 THEN 0 END + 0.0 AS v{a}_re, CASE WHEN s < 0 THEN round(-(fr * {r} + fi * {i}) / e, 6) WHEN s > 0 THEN 0 END + 0.0 AS v{a}_im" for a, (r, i) in SLOPES.items()
) + " FROM r"
CROSS = {"x": "yz", "y": "zx", "z": "xy"}
CURVATURE = HAND + ", s AS (SELECT *, g * g - fr * fr - fi * fi s FROM f), r AS (SELECT *, CASE WHEN s > 0 THEN g / (2 * s * sqrt(s)) ELSE 0 END q FROM s) SELECT vec_id, " + ", ".join(
    f"round(q * ({SLOPES[b][1]} * {SLOPES[c][0]} - {SLOPES[c][1]} * {SLOPES[b][0]}), 6) + 0.0 AS b{a}" for a, (b, c) in CROSS.items()
) + " FROM r"


def plans():
    return {"velocity_at_points": (_velocity, VELOCITY), "berry_at_points": (_curvature, CURVATURE)}

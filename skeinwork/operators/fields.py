"""Fields on a momentum grid: spectra, gradients, masks, curvature, volumes and their cell complexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cplx import Z, absolute, sqrt
from .models import Bloch, s2

INDEX = ("ix", "iy", "iz")


def spectrum(grid: DataFrame, d: Bloch) -> DataFrame:
    """grid with e_re, e_im of the upper band, and gap = 2 |E|."""
    e = sqrt(s2(d))
    rows = grid.select("*", e.re.alias("e_re"), e.im.alias("e_im"))
    return rows.withColumn("gap", 2 * absolute(Z(F.col("e_re"), F.col("e_im"))))


def band_gap(ei: Column, ej: Column, mode: str = "abs") -> Column:
    """Gap of two real bands; mode abs, real or imag."""
    diff = ej - ei
    return {"abs": F.abs(diff), "real": F.abs(diff), "imag": F.lit(0.0)}[mode]


def interior(grid: DataFrame, d: Bloch) -> DataFrame:
    """Points at which Re E is 0: d . d is real and not positive. No root is taken, so the test is exact."""
    s = s2(d)
    return grid.where((s.im == 0) & (s.re <= 0))


def gradient(rows: DataFrame, value: str, steps: tuple[float, float, float], edge_order: int = 1, prefix: str = "g") -> DataFrame:
    """rows with <prefix>x, <prefix>y, <prefix>z: central differences, one-sided at the edges (of first or second order).
    Lines along an axis are the window partitions, so no task sees more than its lines."""
    v = F.col(value)
    for a, h in zip("xyz", steps):
        w = Window.partitionBy(*[i for i in INDEX if i != f"i{a}"]).orderBy(f"i{a}")
        b1, f1, b2, f2 = F.lag(v, 1).over(w), F.lead(v, 1).over(w), F.lag(v, 2).over(w), F.lead(v, 2).over(w)
        first, last = (f1 - v) / h, (v - b1) / h
        if edge_order == 2:
            first, last = (-3 * v + 4 * f1 - f2) / (2 * h), (3 * v - 4 * b1 + b2) / (2 * h)
        rows = rows.withColumn(f"{prefix}{a}", F.when(b1.isNull(), first).when(f1.isNull(), last).otherwise((f1 - b1) / (2 * h)))
    return rows


def berry_curvature(rows: DataFrame, gamma: float, steps: tuple[float, float, float], d1: str = "dx_re", d2: str = "dz_re", sign: int = 1) -> DataFrame:
    """rows with bx, by, bz: sign * gamma / (2 eps^3) * (grad d2 x grad d1), eps^2 = gamma^2 - d1^2 - d2^2, and 0 where
    eps^2 isn't positive."""
    rows = gradient(gradient(rows, d1, steps, prefix="_p"), d2, steps, prefix="_q")
    eps2 = F.lit(gamma * gamma) - F.col(d1) * F.col(d1) - F.col(d2) * F.col(d2)
    scale = F.when(eps2 > 0, F.lit(sign * gamma) / (2 * eps2 * F.sqrt(F.greatest(eps2, F.lit(1e-300))))).otherwise(0.0)
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    for a, (b, c) in cross.items():
        rows = rows.withColumn(f"b{a}", F.when(eps2 > 0, scale * (F.col(f"_q{b}") * F.col(f"_p{c}") - F.col(f"_q{c}") * F.col(f"_p{b}"))).otherwise(0.0))
    return rows.drop(*[f"_{k}{a}" for k in "pq" for a in "xyz"])


def volume(grid: DataFrame, d: Bloch, steps: tuple[float, float, float]) -> DataFrame:
    """The volume record: real, imag, gap, es_helper = |Re| - |Im|, the gradient of Im E inside (0 outside), its norm and
    log10(norm + 1). Interior is a column of its own."""
    rows = spectrum(grid, d).withColumn("es_helper", F.abs("e_re") - F.abs("e_im")).withColumn("interior", F.col("e_re") == 0)
    rows = gradient(rows, "e_im", steps, 2, "im_d")
    rows = rows.withColumns({f"im_d{a}": F.when(F.col("interior"), F.col(f"im_d{a}")).otherwise(0.0) for a in "xyz"})
    norm = F.sqrt(sum((F.col(f"im_d{a}") * F.col(f"im_d{a}") for a in "xyz"), F.lit(0.0)))
    return rows.withColumn("im_norm", norm).withColumn("im_log", F.log10(F.col("im_norm") + 1))


def surface_points(rows: DataFrame, value: str) -> DataFrame:
    """(axis, ix, iy, iz, t): where `value` changes sign on the grid edge from a point along an axis; t is the place on
    that edge. A point at exactly 0 counts as positive."""
    out = None
    for k, a in enumerate("xyz"):
        w = Window.partitionBy(*[i for i in INDEX if i != f"i{a}"]).orderBy(f"i{a}")
        got = rows.select(*INDEX, F.col(value).alias("v"), F.lead(value).over(w).alias("n")).where((F.col("v") < 0) != (F.col("n") < 0))
        got = got.select(F.lit(k).alias("axis"), *INDEX, (F.col("v") / (F.col("v") - F.col("n"))).alias("t"))
        out = got if out is None else out.unionByName(got)
    return out


def to_coordinates(rows: DataFrame, spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> DataFrame:
    """rows(ix, iy, iz) with x, y, z in units of the axes."""
    return rows.select("*", *[(F.col(f"i{a}") * F.lit(s) + F.lit(o)).alias(a) for a, s, o in zip("xyz", spacing, origin)])


def silhouettes(points: DataFrame) -> DataFrame:
    """(plane, a, b): distinct projections of points(ix, iy, iz) along each axis."""
    planes = F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), F.col(f"i{p[0]}").alias("a"), F.col(f"i{p[1]}").alias("b")) for p in ("xy", "xz", "yz")]))
    return points.select(planes.alias("s")).select("s.*").distinct()


def euler(voxels: DataFrame) -> DataFrame:
    """(cells, euler) of voxels(ix, iy, iz) as closed cubes: each is exploded to its 27 cells on doubled coordinates, cells
    are deduplicated, and each counts with the sign of its dimension."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1, 2) for b in (0, 1, 2) for c in (0, 1, 2)])
    cells = voxels.select("*", F.explode(offsets).alias("o")).select((2 * F.col("ix") + F.col("o.a")).alias("a"), (2 * F.col("iy") + F.col("o.b")).alias("b"), (2 * F.col("iz") + F.col("o.c")).alias("c")).distinct()
    odd = F.col("a") % 2 + F.col("b") % 2 + F.col("c") % 2
    return cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.when(odd % 2 == 0, 1).otherwise(-1)), F.lit(0)).cast("bigint").alias("euler"))


def neighbours(voxels: DataFrame, half: bool = True) -> DataFrame:
    """(ix, iy, iz, jx, jy, jz): pairs of voxels that share a corner at least; each pair once if `half`."""
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if ((a, b, c) > (0, 0, 0) if half else (a, b, c) != (0, 0, 0))]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", o)]) for o in near])
    moved = voxels.select(*INDEX, F.explode(offsets).alias("o")).select(*INDEX, *[(F.col(f"i{a}") + F.col(f"o.{k}")).alias(f"j{a}") for a, k in zip("xyz", "abc")])
    other = voxels.select(*[F.col(f"i{a}").alias(f"j{a}") for a in "xyz"])
    return moved.join(other, ["jx", "jy", "jz"]).select(*INDEX, "jx", "jy", "jz")


def eigenvalues_2x2(a: Column, c: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    """Ascending eigenvalues of the Hermitian matrix [[a, b], [b*, c]]."""
    root = F.sqrt((a - c) * (a - c) / 4 + b_re * b_re + b_im * b_im)
    return (a + c) / 2 - root, (a + c) / 2 + root


def sample(points: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """points(pid, x, y, z in index units) with the trilinear value of field(ix, iy, iz, value): each point meets the eight
    corners of its cell by an equi-join and adds up their weights. Corners outside the grid count as 0."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    rows = points.select("pid", "x", "y", "z", F.explode(corners).alias("o"))
    for a, k in zip("xyz", "abc"):
        low = F.floor(a)
        rows = rows.withColumn(f"i{a}", low + F.col(f"o.{k}")).withColumn(f"w{a}", F.when(F.col(f"o.{k}") == 1, F.col(a) - low).otherwise(1 - (F.col(a) - low)))
    got = rows.join(field.select(*INDEX, F.col(value).alias("v")), list(INDEX))
    return got.groupBy("pid").agg(F.sum(F.col("wx") * F.col("wy") * F.col("wz") * F.col("v")).alias(value))


def is_hermitian(rows: DataFrame, entries: tuple[Z, Z, Z, Z]) -> DataFrame:
    """One row: whether the 2x2 matrix equals its conjugate transpose at every point."""
    h00, h01, h10, h11 = entries
    off = F.greatest(F.abs(h00.im), F.abs(h11.im), F.abs(h01.re - h10.re), F.abs(h01.im + h10.im))
    return rows.agg((F.max(off) == 0).alias("is_hermitian"))


def is_pt_symmetric(grid: DataFrame, d: Bloch, n: int, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether H(k) = sx conj(H(-k)) sx at every point of a grid that is symmetric about 0. -k is the reflected
    index, so the test is an equi-join of the grid with itself."""
    from .models import on_grid

    cols = [f"d{a}_{p}" for a in "xyz" for p in ("re", "im")]
    rows = on_grid(grid, d).select(*INDEX, *cols)
    other = rows.select(*[(F.lit(n - 1) - F.col(i)).alias(i) for i in INDEX], *[F.col(c).alias(f"m_{c}") for c in cols])
    got = rows.join(other, list(INDEX))
    # sx conj(.) sx keeps dx and dy conjugated, and turns the sign of dz
    off = [F.abs(F.col(f"d{a}_re") - s * F.col(f"m_d{a}_re")) for a, s in (("x", 1), ("y", 1), ("z", -1))]
    off += [F.abs(F.col(f"d{a}_im") + s * F.col(f"m_d{a}_im")) for a, s in (("x", 1), ("y", 1), ("z", -1))]
    return got.agg((F.max(F.greatest(*off)) <= tolerance).alias("is_pt_symmetric"))

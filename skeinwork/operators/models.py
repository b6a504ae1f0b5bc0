"""Band models as complex columns over kx, ky, kz.

A model is a function of a DataFrame's momentum columns that returns its Bloch vector (dx, dy, dz) as complex pairs. The
torus family lifts momentum to two complex numbers z and w and uses Re f and Im f of a polynomial f of them, with a
constant imaginary dy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cplx import Z, add, mul, powi, real, sub

Bloch = tuple[Z, Z, Z]
#: Named torus models: (p, q).
TORUS = {"unknot": (1, 1), "hopf": (2, 2), "trefoil": (2, 3), "cinquefoil": (2, 5), "solomon": (2, 4)}
#: Offsets of the mirrored third component.
MIRROR_C = {"solomon": 0.333, "threelink": 0.333, "awesome": 0.333}


def lift(c: float = 0.0, m: float = 2.0, mirror: bool = False, k=("kx", "ky", "kz")) -> tuple[Z, Z]:
    """(z, w) of a momentum."""
    kx, ky, kz = (F.col(x) for x in k)
    third = (F.cos(2 * kz) if mirror else F.sin(kz)) + F.lit(float(c))
    return Z(third, F.cos(kx) + F.cos(ky) + F.cos(kz) - F.lit(float(m))), Z(F.sin(kx), F.sin(ky))


def _vector(f: Z, gamma: float) -> Bloch:
    return Z(f.re, F.lit(0.0)), Z(F.lit(0.0), F.lit(float(gamma))), Z(f.im, F.lit(0.0))


def torus(p: int, q: int, gamma: float, c: float = 0.0, m: float = 2.0, mirror: bool = False) -> Bloch:
    z, w = lift(c, m, mirror)
    return _vector((sub if mirror else add)(powi(z, p), powi(w, q)), gamma)


def named(name: str, gamma: float, mirror: bool = False, c: float | None = None, m: float = 2.0) -> Bloch:
    """A model of the catalogue: unknot, hopf, trefoil, cinquefoil, solomon, threelink or awesome."""
    if c is None:
        c = MIRROR_C.get(name, 0.5) if mirror else 0.0
    if name in TORUS:
        return torus(*TORUS[name], gamma, c, m, mirror)
    z, w = lift(c, m, mirror)
    if name == "threelink":
        return _vector(mul(sub(powi(z, 2), powi(w, 2)), z), gamma)
    if name == "awesome":
        return _vector(mul(z, add(sub(powi(z, 2), powi(w, 4)), w)), gamma)
    raise ValueError(f"unknown model {name}")


def from_matrix(h00: Z, h01: Z, h10: Z, h11: Z) -> Bloch:
    """Bloch vector of a 2x2 matrix: its components on the Pauli matrices."""
    half = real(0.5)
    i_half = Z(F.lit(0.0), F.lit(0.5))
    return mul(half, add(h01, h10)), mul(i_half, sub(h01, h10)), mul(half, sub(h00, h11))


def to_matrix(d: Bloch) -> tuple[Z, Z, Z, Z]:
    """The traceless 2x2 matrix of a Bloch vector, by rows."""
    i = Z(F.lit(0.0), F.lit(1.0))
    dx, dy, dz = d
    return dz, sub(dx, mul(i, dy)), add(dx, mul(i, dy)), Z(-dz.re, -dz.im)


def on_grid(grid: DataFrame, d: Bloch) -> DataFrame:
    """grid with dx_re, dx_im, dy_re, dy_im, dz_re, dz_im."""
    return grid.select("*", *[c.alias(f"d{a}_{part}") for a, v in zip("xyz", d) for part, c in zip(("re", "im"), v)])


def opaque(grid: DataFrame, function, columns: tuple[str, ...] = ("dx", "dy", "dz")) -> DataFrame:
    """grid with the columns that a user's numpy function of (kx, ky, kz) returns; Arrow batches, for models that have no
    column expression."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.concat([b, pd.DataFrame(dict(zip(columns, function(b.kx.to_numpy(), b.ky.to_numpy(), b.kz.to_numpy()))), index=b.index)], axis=1)

    kinds = ", ".join(f"{n} {t}" for n, t in grid.dtypes) + "".join(f", {c} double" for c in columns)
    return grid.mapInPandas(run, kinds)


def s2(d: Bloch) -> Z:
    """d . d, whose roots are the bands."""
    out = mul(d[0], d[0])
    for x in d[1:]:
        out = add(out, mul(x, x))
    return out


def berry_prerequisites(sampled: DataFrame) -> DataFrame:
    """One row over a sampled Bloch vector (as from on_grid): valid where exactly two components are real throughout and the
    third is one imaginary constant; then gamma, that constant, with its index and those of the real ones, else nulls."""
    stats = []
    for a in "xyz":
        re, im = F.col(f"d{a}_re"), F.col(f"d{a}_im")
        stats += [F.max(F.abs(re)).alias(f"re_{a}"), F.max(F.abs(im)).alias(f"im_{a}"), F.min(im).alias(f"lo_{a}"), F.max(im).alias(f"hi_{a}")]
    row = sampled.agg(*stats)
    is_real = {a: F.col(f"im_{a}") == 0 for a in "xyz"}
    fixed = {a: (F.col(f"re_{a}") == 0) & (F.col(f"im_{a}") > 0) & (F.col(f"lo_{a}") == F.col(f"hi_{a}")) for a in "xyz"}
    reals = F.array_compact(F.array(*[F.when(is_real[a], i) for i, a in enumerate("xyz")]))
    fixes = F.array_compact(F.array(*[F.when(fixed[a], F.struct(F.lit(i).alias("i"), F.col(f"lo_{a}").alias("gamma"))) for i, a in enumerate("xyz")]))
    got = row.select(reals.alias("r"), fixes.alias("f")).withColumn("valid", (F.size("r") == 2) & (F.size("f") == 1))
    when = lambda c: F.when(F.col("valid"), c)
    return got.select("valid", when(F.get("f", F.lit(0))["gamma"]).alias("gamma"), when(F.get("f", F.lit(0))["i"]).alias("gamma_idx"), when(F.get("r", F.lit(0))).alias("d1_idx"), when(F.get("r", F.lit(1))).alias("d2_idx"))


__all__ = ["berry_prerequisites", "Bloch", "TORUS", "from_matrix", "lift", "named", "on_grid", "opaque", "s2", "to_matrix", "torus"]

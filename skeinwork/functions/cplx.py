"""Complex numbers as pairs of columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Z(NamedTuple):
    """A complex column: real and imaginary part."""

    re: Column
    im: Column


def real(x) -> Z:
    return Z(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))


def add(a: Z, b: Z) -> Z:
    return Z(a.re + b.re, a.im + b.im)


def sub(a: Z, b: Z) -> Z:
    return Z(a.re - b.re, a.im - b.im)


def mul(a: Z, b: Z) -> Z:
    return Z(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def powi(a: Z, n: int) -> Z:
    """Whole powers by repeated products, exact in sign where pow() of a negative base is not defined."""
    out = real(1.0)
    for _ in range(n):
        out = mul(out, a)
    return out


def sqrt(a: Z) -> Z:
    """Principal square root; on the cut, where the square is real and negative, the real part is exactly 0."""
    size = F.sqrt(a.re * a.re + a.im * a.im)
    on_cut = (a.im == 0) & (a.re < 0)
    re = F.when(on_cut, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), (size + a.re) / 2)))
    im = F.when(on_cut, F.sqrt(-a.re)).otherwise(F.when(a.im < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.lit(0.0), (size - a.re) / 2)))
    return Z(re, im)


def absolute(a: Z) -> Column:
    return F.sqrt(a.re * a.re + a.im * a.im)

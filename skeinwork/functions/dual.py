"""Derivatives of column expressions by dual numbers.

A dual is a complex value with its derivative along each of some variables. A user writes a model in them with +, -, *, /,
whole powers, sin, cos, exp and sqrt, and gets all first derivatives as columns beside the value: no differences, no grid,
so single points of any table will do, and nothing is shuffled.

Each operation names its results on a tape, and the tape becomes one projection a level, so that a plan grows with the
number of operations and not with the size of the expression written out. Parts that are constants, zeros above all, stay
numbers and make no columns.
"""

from __future__ import annotations

import cmath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cplx
from .cplx import Z

Number = float | Column
Pair = tuple[Number, Number]
ZERO: Pair = (0.0, 0.0)


def _plus(a: Number, b: Number) -> Number:
    if isinstance(a, float) and a == 0:
        return b
    return a if isinstance(b, float) and b == 0 else a + b


def _times(a: Number, b: Number) -> Number:
    for x, y in ((a, b), (b, a)):
        if isinstance(x, float) and x in (0.0, 1.0):
            return y if x else 0.0
    return a * b


def _add(a: Pair, b: Pair) -> Pair:
    return _plus(a[0], b[0]), _plus(a[1], b[1])


def _mul(a: Pair, b: Pair) -> Pair:
    return _plus(_times(a[0], b[0]), _times(-1.0, _times(a[1], b[1]))), _plus(_times(a[0], b[1]), _times(a[1], b[0]))


def _constant(a: Pair) -> bool:
    return all(isinstance(x, float) for x in a)


def _column(x: Number) -> Column:
    return F.lit(x) if isinstance(x, float) else x


class Tape:
    """The named results of operations, by level: those of a level need lower ones only."""

    def __init__(self, taken: list[str]):
        self.levels: list[dict[str, Column]] = []
        self.count, self.prefix = 0, "_d"
        while any(c.lower().startswith(self.prefix) for c in taken):
            self.prefix += "_"

    def note(self, level: int, x: Number) -> Number:
        if isinstance(x, float):
            return x
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.levels[level][name] = x
        return F.col(name)

    def onto(self, df: DataFrame) -> DataFrame:
        """df with all results."""
        for named in self.levels:
            df = df.withColumns(named) if named else df
        return df


class Dual:
    """value and its derivatives, one for each variable."""

    def __init__(self, tape: Tape, level: int, value: Pair, parts: tuple[Pair, ...]):
        note = lambda z: (tape.note(level, z[0]), tape.note(level, z[1]))
        self.tape, self.level, self.value, self.parts = tape, level, note(value), tuple(map(note, parts))

    def _with(self, other: Dual | None, value: Pair, parts: list[Pair]) -> Dual:
        return Dual(self.tape, max(self.level, other.level if other else 0) + 1, value, tuple(parts))

    def chain(self, value: Pair, slope: Pair) -> Dual:
        """A function of this dual that has `value` and `slope` at it."""
        slope = tuple(self.tape.note(self.level + 1, x) for x in slope)
        return Dual(self.tape, self.level + 2, value, tuple(_mul(slope, p) for p in self.parts))

    def of(self, x: Dual | Column | complex | float) -> Dual:
        """A constant, or a real column that doesn't depend on the variables, as a dual."""
        if isinstance(x, Dual):
            return x
        value = (x, 0.0) if isinstance(x, Column) else (float(complex(x).real), float(complex(x).imag))
        return Dual(self.tape, 0, value, (ZERO,) * len(self.parts))

    def __add__(self, x):
        x = self.of(x)
        return self._with(x, _add(self.value, x.value), [_add(p, q) for p, q in zip(self.parts, x.parts)])

    def __neg__(self):
        return self * -1.0

    def __sub__(self, x):
        return self + self.of(x) * -1.0

    def __mul__(self, x):
        x = self.of(x)
        return self._with(x, _mul(self.value, x.value), [_add(_mul(p, x.value), _mul(self.value, q)) for p, q in zip(self.parts, x.parts)])

    def inverse(self) -> Dual:
        """1 / self; null where that is 0."""
        re, im = map(_column, self.value)
        size = F.nullif(re * re + im * im, F.lit(0.0))
        one = self._with(None, (re / size, _times(-1.0, im / size)), [ZERO] * len(self.parts)).value
        at = Dual(self.tape, self.level + 1, ZERO, self.parts)
        return at.chain(one, _mul((-1.0, 0.0), _mul(one, one)))

    def __truediv__(self, x):
        return self * self.of(x).inverse()

    def __rsub__(self, x):
        return self.of(x) - self

    def __rtruediv__(self, x):
        return self.of(x) / self

    __radd__, __rmul__ = __add__, __mul__

    def __pow__(self, n: int) -> Dual:
        """Whole powers from 0, by squares."""
        if n == 0:
            return self.of(1.0)
        half = self ** (n // 2) if n > 1 else None
        return self if half is None else half * half * self if n % 2 else half * half


def _function(x: Dual, plain: Callable, value: Callable, slope: Callable) -> Dual:
    """plain on constants; value and slope make pairs of columns of a pair."""
    if _constant(x.value):
        return x.of(plain(complex(*x.value)))
    return x.chain(value(*x.value), slope(*x.value))


def _sin(a: Number, b: Number) -> Pair:
    if isinstance(b, float) and b == 0:
        return F.sin(a), 0.0
    a, b = _column(a), _column(b)
    return F.sin(a) * F.cosh(b), F.cos(a) * F.sinh(b)


def _cos(a: Number, b: Number) -> Pair:
    if isinstance(b, float) and b == 0:
        return F.cos(a), 0.0
    a, b = _column(a), _column(b)
    return F.cos(a) * F.cosh(b), -F.sin(a) * F.sinh(b)


def _exp(a: Number, b: Number) -> Pair:
    if isinstance(b, float) and b == 0:
        return F.exp(a), 0.0
    a, b = _column(a), _column(b)
    return F.exp(a) * F.cos(b), F.exp(a) * F.sin(b)


def sin(x: Dual) -> Dual:
    return _function(x, cmath.sin, _sin, _cos)


def cos(x: Dual) -> Dual:
    return _function(x, cmath.cos, _cos, lambda a, b: _mul((-1.0, 0.0), _sin(a, b)))


def exp(x: Dual) -> Dual:
    return _function(x, cmath.exp, _exp, _exp)


def sqrt(x: Dual) -> Dual:
    """Principal root; its derivatives are null where it is 0."""
    a, b = map(_column, x.value)
    there = a.isNotNull() & b.isNotNull()
    root = Dual(x.tape, x.level + 1, tuple(F.when(there, c) for c in cplx.sqrt(Z(a, b))), (ZERO,) * len(x.parts))
    slope = root.inverse() * 0.5
    return Dual(x.tape, slope.level + 1, root.value, tuple(_mul(slope.value, p) for p in x.parts))


def real_part(x: Dual) -> Dual:
    """The real part, as a function of real variables."""
    return x._with(None, (x.value[0], 0.0), [(p[0], 0.0) for p in x.parts])


def imaginary_part(x: Dual) -> Dual:
    return x._with(None, (x.value[1], 0.0), [(p[1], 0.0) for p in x.parts])


def variables(tape: Tape, *columns: Column) -> tuple[Dual, ...]:
    """The variables to derive by, from real columns."""
    unit = lambda i: tuple((1.0, 0.0) if i == j else ZERO for j in range(len(columns)))
    return tuple(Dual(tape, 0, (c, 0.0), unit(i)) for i, c in enumerate(columns))


def derive(df: DataFrame, function: Callable[..., Dual], at: list[str], parameters: tuple[Column, ...] = ()) -> tuple[DataFrame, Z, list[Z]]:
    """df with the tape of function(duals of the columns `at`, then of the parameters), its value and its derivatives. Rows
    with a null among these have nulls; no column of df is changed, whatever its name."""
    tape = Tape(df.columns)
    x = variables(tape, *[F.col(c) for c in at])
    got = x[0].of(function(*x, *map(x[0].of, parameters)))
    z = lambda p: Z(*map(_column, p))
    return tape.onto(df), z(got.value), [z(p) for p in got.parts]


#: A model: momenta, then any number of real parameters, all as duals, to a Bloch vector of duals, columns or numbers.
Model = Callable[..., tuple]


def velocities(points: DataFrame, model: Model, *parameters: Column, k: tuple[str, ...] = ("kx", "ky", "kz")) -> DataFrame:
    """points with e_re, e_im of the upper band of a user's model and v<a>_re, v<a>_im, its derivatives along each of the
    momentum columns k; these are null where the band is 0."""

    def band(*x):
        dx, dy, dz = map(x[0].of, model(*x))
        return sqrt(dx * dx + dy * dy + dz * dz)

    rows, e, slopes = derive(points, band, list(k), parameters)
    parts = [c.alias(f"v{a[-1]}_{n}") for a, p in zip(k, slopes) for n, c in zip(("re", "im"), p)]
    return rows.select(*points.columns, e.re.alias("e_re"), e.im.alias("e_im"), *parts)


def curvature(points: DataFrame, model: Model, *parameters: Column, gamma: float | Column, sign: int = 1, k: tuple[str, str, str] = ("kx", "ky", "kz")) -> DataFrame:
    """points with bx, by, bz: the Berry curvature of a user's model with real dx and dz and dy = i gamma:
    sign * gamma / (2 eps^3) * (grad dz x grad dx), eps^2 = gamma^2 - dx^2 - dz^2, and 0 where that isn't positive."""
    # dx and dz, both real, are derived together as one complex function
    rows, f, slopes = derive(points, lambda *x: (lambda d: x[0].of(d[0]) + x[0].of(d[2]) * 1j)(model(*x)), list(k), parameters)
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    eps2 = g * g - f.re * f.re - f.im * f.im
    scale = sign * g / (2 * eps2 * F.sqrt(F.greatest(eps2, F.lit(1e-300))))
    cross = [(slopes[(i + 1) % 3], slopes[(i + 2) % 3]) for i in range(3)]
    return rows.select(*points.columns, *[F.when(eps2 > 0, scale * (b.im * c.re - c.im * b.re)).otherwise(0.0).alias(f"b{a}") for a, (b, c) in zip("xyz", cross)])

"""Scalar, row-wise and curve expressions.

Missing values are NULL after ingest; comparisons with them count as false
(``flag``), and every guarded division answers NULL where it would not be
finite.  Sums and extremes over several columns skip NULL and non-finite
values.  Everything is a built-in Column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Tolerances of approximate equality: absolute, and relative to the second value.
CLOSE_ABS, CLOSE_REL = 1e-8, 1e-5
INF = float("inf")
NULL_TOKEN = "<NA>"


def dbl(x: float) -> Column:
    return F.lit(float(x))


def null() -> Column:
    return F.lit(None).cast("double")


def ok(x: Column) -> Column:
    """Finite; NULL for a missing x.  One comparison, for NaN is larger than anything in Spark's order."""
    return F.abs(x) < INF


def fin(x: Column) -> Column:
    """Present and finite; never NULL."""
    return flag(ok(x))


def finite(x: Column) -> Column:
    """The value if it is finite, else NULL."""
    return F.when(ok(x), x)


def nz(x: Column) -> Column:
    """The value, with 0 for a missing one."""
    return F.coalesce(F.nanvl(x, null()), dbl(0))


def flag(p: Column) -> Column:
    """The predicate, with false for unknown."""
    return F.coalesce(p, F.lit(False))


def bit(p: Column) -> Column:
    """The predicate as 0 or 1."""
    return flag(p).cast("int")


def sdiv(n: Column, d: Column) -> Column:
    """n / d where both are finite and d is not within 1e-6 of zero."""
    return F.when(ok(n) & ok(d) & (F.abs(d) > EPSILON), n / d)


def close(a: Column, b: Column) -> Column:
    return flag(ok(a) & ok(b) & (F.abs(a - b) <= dbl(CLOSE_ABS) + dbl(CLOSE_REL) * F.abs(b)))


def tolerance(least: float, share: float, x: Column) -> Column:
    return F.greatest(dbl(least), dbl(share) * nz(x))


def clamp0(x: Column) -> Column:
    """max(x, 0), NULL for a missing x."""
    return F.when(x.isNotNull(), F.greatest(x, dbl(0)))


def sign_differs(a: Column, b: Column) -> Column:
    return flag((F.signum(nz(a)) != F.signum(nz(b))) & (nz(a) != 0) & (nz(b) != 0))


def bucketize(x: Column, scale: float = 1.0, fill: int = -1, rounded: bool = True) -> Column:
    """Half-even bucket number of x / scale; ``fill`` for a missing x."""
    q = finite(x) / dbl(scale)
    return F.coalesce(F.rint(q) if rounded else q, dbl(fill)).cast("int")


def joined(cols: Sequence[Column], sep: str = "|") -> Column:
    """Strings joined with a token in place of missing ones."""
    return F.concat_ws(sep, *[F.coalesce(c, F.lit(NULL_TOKEN)) for c in cols])


def total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(or_, flags, F.lit(False))


def count_null(cols: Sequence[Column]) -> Column:
    return total([c.isNull().cast("int") for c in cols])


def pattern(cols: Sequence[Column]) -> Column:
    """Bits of missing columns: the i-th weighs 2**i."""
    return total([c.isNull().cast("int") * (1 << i) for i, c in enumerate(cols)])


def row_min(cols: Sequence[Column]) -> Column:
    """The least finite value; ``least`` skips NULL and needs no array."""
    some = [finite(c) for c in cols]
    return F.least(*some) if len(some) > 1 else some[0]


def row_max(cols: Sequence[Column]) -> Column:
    some = [finite(c) for c in cols]
    return F.greatest(*some) if len(some) > 1 else some[0]


def row_mean(cols: Sequence[Column]) -> Column:
    n = total([fin(c).cast("int") for c in cols])
    return F.when(n > 0, total([F.coalesce(finite(c), dbl(0)) for c in cols]) / n)


def spread(cols: Sequence[Column]) -> Column:
    return row_max(cols) - row_min(cols)


def curve_index(x: Column, n: int) -> Column:
    """0-based curve number from a 1-based value; the first where it is missing or outside."""
    i = F.coalesce(finite(x), dbl(1)).cast("long") - 1
    return F.when((i >= 0) & (i < n), i).otherwise(0).cast("int")


def pick(values: Sequence[Column], index: Column) -> Column:
    """The value with a number from 0; NULL for a number outside."""
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def pair_count(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    return total([bit(ok(x) & ok(y)) for x, y in zip(xs, ys, strict=True)])


def reverse_steps(xs: Sequence[Column]) -> Column:
    return total([bit(ok(a) & ok(b) & (b - a < -EPSILON)) for a, b in zip(xs, xs[1:], strict=False)])


def slopes(xs: Sequence[Column], ys: Sequence[Column]) -> list[Column]:
    out = []
    for i in range(len(xs) - 1):
        dx, dy = xs[i + 1] - xs[i], ys[i + 1] - ys[i]
        out.append(F.when(ok(dx) & ok(dy) & (F.abs(dx) > EPSILON), dy / dx))
    return out


def paired(xs: Sequence[Column], ys: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """The points whose two values are finite; NULL in both for the others."""
    both = [ok(a) & ok(b) for a, b in zip(xs, ys, strict=True)]
    return [F.when(p, a) for p, a in zip(both, xs, strict=True)], [F.when(p, b) for p, b in zip(both, ys, strict=True)]


def interpolate(x: Column, xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    """The value at x (finite or NULL) of a curve of :func:`paired` points: the first segment that holds x, else the end value beyond the range, else NULL.

    Below the smaller end the first point's value is taken and above the
    larger end the last point's, also for falling curves.
    """
    parts = []
    for i in range(len(xs) - 1):
        a, b, dx = xs[i], xs[i + 1], xs[i + 1] - xs[i]
        parts.append(F.when((F.abs(dx) > EPSILON) & (((x >= a) & (x <= b)) | ((x >= b) & (x <= a))), ys[i] + (x - a) / dx * (ys[i + 1] - ys[i])))
    (first_x, first_y), (last_x, last_y) = ((F.coalesce(*xs[::d]), F.coalesce(*ys[::d])) for d in (1, -1))
    low = F.when(x <= F.least(first_x, last_x), first_y)
    high = F.when(x >= F.greatest(first_x, last_x), last_y)
    return F.coalesce(*parts, low, high)


def var_pct(var: Column, inj: Column, absorb: Column) -> Column:
    """Reactive power in percent of the limit on its side."""
    return dbl(100) * sdiv(var, F.when(var >= 0, inj).otherwise(absorb))

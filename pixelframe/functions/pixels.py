"""Column functions on pixel values and positions.

Catalyst writes a column's definition into the place where it is used if it
is used once; inside a lambda that would repeat an image's work for each pixel.
`let` binds a value for the time of an expression, and `each_pixel` names the
arrays that it reads twice, so each is worked out once for an image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(v: Column) -> Column:
    return F.rint(v)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def to_byte(v: Column) -> Column:
    """Rounded half to even and clamped to 0..255."""
    return clamp(half_even(v), 0, 255)


def typed(v: Column, dtype: Column) -> Column:
    """v as the image's type stores it: rounded and clamped for 'u8'."""
    return F.when(dtype == "u8", to_byte(v)).otherwise(v)


def reflected(i: Column, n: Column) -> Column:
    """Index with the border mirrored, the edge itself not repeated."""
    m = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
    return F.when(n == 1, F.lit(0)).when(m < n, m).otherwise(2 * (n - 1) - m)


def replicated(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, n - 1))


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def known(expression: Column, *columns: str) -> Column:
    """expression where the columns are not null; the second mention keeps their definitions out of lambdas."""
    there = F.lit(True)
    for c in columns:
        there = there & F.col(c).isNotNull()
    return F.when(there, expression)


def each_pixel(value, h: Column, w: Column, channels: Column, *reads: str) -> Column:
    """An array of value(r, c, ch) for all positions of an image; reads: the array columns that value looks into."""

    def at(i: Column) -> Column:
        p = F.floor(i / channels).cast("int")
        return value(F.floor(p / w).cast("int"), p % w, i % channels)

    return known(F.transform(indices(h * w * channels), at), *(reads or ("data",)))

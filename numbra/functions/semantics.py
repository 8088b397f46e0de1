"""Helpers where plain Spark expressions differ from IEEE or strict SQL semantics.

Spark has one order of doubles (NaN above all and equal to itself, zeros equal), raises on division by zero,
gives null for logarithms outside their domain, rounds decimally and skips nulls in least() and greatest().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def ieee_gt(a: Column, b: Column) -> Column:
    """a > b, false if either is NaN, null if either is null."""
    return (a > b) & _numbers(a, b)


def ieee_ge(a: Column, b: Column) -> Column:
    return (a >= b) & _numbers(a, b)


def ieee_lt(a: Column, b: Column) -> Column:
    return (a < b) & _numbers(a, b)


def ieee_le(a: Column, b: Column) -> Column:
    return (a <= b) & _numbers(a, b)


def ieee_eq(a: Column, b: Column) -> Column:
    return (a == b) & _numbers(a, b)


def ieee_ne(a: Column, b: Column) -> Column:
    """a <> b; true if either is NaN."""
    return (a != b) | ~_numbers(a, b)


def _negative_zero(a: Column) -> Column:
    # 1 / -0.0; power() sees the sign of zero where comparisons do not
    return (a == 0) & (F.pow(a, F.lit(-1.0)) < 0)


def total_lt(a: Column, b: Column) -> Column:
    """The total order: -0.0 before 0.0, NaN after everything."""
    return (a < b) | ((a == 0) & (b == 0) & _negative_zero(a) & ~_negative_zero(b))


def total_gt(a: Column, b: Column) -> Column:
    return total_lt(b, a)


def total_eq(a: Column, b: Column) -> Column:
    return (a == b) & ~total_lt(a, b) & ~total_lt(b, a)


def ieee_div(a: Column, b: Column) -> Column:
    """Division that gives signed infinities and NaN where the divisor is zero."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ieee_ln(a: Column) -> Column:
    """ln with -Infinity at zero and NaN below."""
    return F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log(F.when(a > 0, a)))


def ieee_log2(a: Column) -> Column:
    return F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log2(F.when(a > 0, a)))


def round_scaled(a: Column, digits: int) -> Column:
    """ROUND by scaling: a * 10^digits to the nearest integer, halves away from zero, then back; a itself where that
    overflows. Spark rounds the shortest decimal instead and drops the sign of zero. `a` should be a column, as it is
    read several times."""
    scale = F.lit(10.0**digits)
    scaled = a * scale
    even = F.rint(scaled)
    away = F.when((F.abs(scaled - even) == 0.5) & (F.abs(even) < F.abs(scaled)), even + F.signum(scaled)).otherwise(even)
    return F.when(F.abs(scaled) == float("inf"), a).otherwise(away / scale)


def _strict(columns: tuple[Column, ...], value: Column) -> Column:
    return F.when(reduce(lambda x, y: x & y, (c.isNotNull() for c in columns)), value)


def least_strict(*columns: Column) -> Column:
    """least() that is null if any operand is; NaN loses."""
    return _strict(columns, F.least(*columns))


def greatest_strict(*columns: Column) -> Column:
    """greatest() that is null if any operand is; NaN wins."""
    return _strict(columns, F.greatest(*columns))


def int_div(a: Column, b: Column) -> Column:
    """Integer division toward zero, as an int; raises for a zero divisor under ANSI."""
    return ((a - a % b) / b).cast("int")


def float_sum(value: Column) -> Column:
    """SUM of floats with a float result; Spark adds in double."""
    return F.sum(value).cast("float")

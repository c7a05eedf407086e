"""Column helpers that keep IEEE array semantics under Spark's ANSI and NaN rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def no() -> Column:
    return F.lit(False)


def is_finite(c: Column) -> Column:
    """False for null, NaN and both infinities; never null.  (NaN is the largest value in Spark.)"""
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def np_div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN, instead of an error."""
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a * float("inf")))


def above(c: Column, limit) -> Column:
    """``c > limit`` where NaN never passes."""
    return F.nanvl(c, F.lit(float("-inf"))) > limit


def below(c: Column, limit) -> Column:
    """``c < limit``; NaN sorts above every number and never passes."""
    return c < limit


def clip(c: Column, low: float, high: float) -> Column:
    """For values known not to be NaN."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def nan_min(a: Column, b: Column) -> Column:
    """Smaller value, NaN if either is NaN; greatest() propagates NaN, least() does not."""
    return -F.greatest(-a, -b)


def log2_score(ratio: Column, scale: float) -> Column:
    """``clip(log2(max(ratio, 1)) / scale, 0, 1)`` with NaN counted as 0."""
    inside = F.log2(F.greatest(F.nanvl(ratio, F.lit(1.0)), F.lit(1.0))) / scale
    return F.least(inside, F.lit(1.0))


def edge_score(ratio: Column) -> Column:
    """``clip(|log2 ratio| / 2, 0, 1)``; NaN or missing is 0, a zero or infinite ratio is 1."""
    # log2 of 0 is null in Spark; nanvl and coalesce turn the special ratios into their scores.
    deviation = F.abs(F.log2(F.nanvl(ratio, F.lit(1.0)))) / 2.0
    return F.when(ratio.isNull(), F.lit(0.0)).otherwise(F.least(F.coalesce(deviation, F.lit(1.0)), F.lit(1.0)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def flag_count(flag: Column) -> Column:
    return F.count_if(flag).cast("bigint")


Vec = Sequence[Column]


def vec(prefix: str, suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{axis}{suffix}") for axis in "xyz"]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def add(a: Vec, b: Vec) -> list[Column]:
    return [p + q for p, q in zip(a, b)]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def unit(a: Vec, length: Column) -> list[Column]:
    """``a / length``; NaN where the length is not usable."""
    good = is_finite(length) & (length > 1e-12)
    return [F.when(good, F.try_divide(p, length)).otherwise(nan()) for p in a]

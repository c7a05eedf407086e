"""Vector and IEEE helpers as Spark SQL text.

The neighbourhood frame has several hundred column expressions.  As SQL text a whole stage is one
call into the JVM, so building the plan stays cheap next to running it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

NAN = "double('NaN')"
INF = "double('Infinity')"

Vec = Sequence[str]


def stage(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add new columns given as SQL text; they may not refer to each other."""
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


def vec(prefix: str, suffix: str = "") -> list[str]:
    return [f"{prefix}{axis}{suffix}" for axis in "xyz"]


def add(a: Vec, b: Vec) -> list[str]:
    return [f"({p} + {q})" for p, q in zip(a, b)]


def sub(a: Vec, b: Vec) -> list[str]:
    return [f"({p} - {q})" for p, q in zip(a, b)]


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def norm(a: Vec) -> str:
    return f"sqrt({dot(a, a)})"


def cross(a: Vec, b: Vec) -> list[str]:
    turn = ((1, 2), (2, 0), (0, 1))
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in turn]


def finite(a: str) -> str:
    """False for null, NaN (the largest value in Spark) and both infinities."""
    return f"coalesce(abs({a}) < {INF}, false)"


def div(a: str, b: str) -> str:
    """IEEE division: x/0 is a signed infinity, 0/0 is NaN."""
    return f"coalesce(try_divide({a}, {b}), CASE WHEN {b} = 0 THEN {a} * {INF} END)"


def above(a: str, limit: float | str) -> str:
    """``a > limit``; false for NaN and null."""
    return f"coalesce(nanvl({a}, -{INF}) > {_number(limit)}, false)"


def below(a: str, limit: float | str) -> str:
    return f"coalesce({a} < {_number(limit)}, false)"


def _number(value: float | str) -> str:
    return value if isinstance(value, str) else f"double('{float(value)!r}')"


def unit(a: Vec, length: str) -> list[str]:
    """``a / length``, NaN where the length is not usable."""
    return [f"CASE WHEN {finite(length)} AND {length} > 1e-12D THEN try_divide({p}, {length}) ELSE {NAN} END" for p in a]


def clip_cosine(a: str) -> str:
    return f"least(greatest({a}, -1D), 1D)"


def any_of(flags: Sequence[str]) -> str:
    return "(" + " OR ".join(flags) + ")"


def edge_score(ratio: str) -> str:
    """``clip(|log2 ratio| / 2, 0, 1)``; NaN or missing is 0, a zero or infinite ratio is 1."""
    return (
        f"CASE WHEN {ratio} IS NULL THEN 0D"
        f" ELSE least(coalesce(abs(log2(nanvl({ratio}, 1D))) / 2D, 1D), 1D) END"
    )


def log2_score(ratio: str, scale: float) -> str:
    """``clip(log2(max(ratio, 1)) / scale, 0, 1)`` with NaN counted as 0."""
    return f"least(log2(greatest(nanvl({ratio}, 1D), 1D)) / {_number(scale)}, 1D)"


def number(value: float) -> str:
    return _number(value)

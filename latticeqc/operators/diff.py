"""Comparing two versions of a surface, and cell masks with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import finite_or_null, flag_count, is_finite

KEYS = ("package_id",)


def by_sentinel(vertices: DataFrame) -> DataFrame:
    """Vertices that the comparing tools take as valid: x is not the sentinel."""
    return vertices.where(F.isnan("x") | (F.col("x") != -1))


def _matched(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = before.select(*keys, "row", "col", F.struct("x", "y", "z").alias("p"))
    right = after.select(*keys, "row", "col", F.struct("x", "y", "z").alias("q"))
    return left.join(right, [*keys, "row", "col"], "full_outer")


def surface_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of lost, new and common vertices, and the displacement of common ones (float32 steps)."""
    steps = [
        (F.col(f"q.{a}").cast("float") - F.col(f"p.{a}").cast("float")).cast("double") for a in "xyz"
    ]
    size = F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2])
    pair = _matched(by_sentinel(before), by_sentinel(after), keys).withColumn("d", size)
    p, q, d = F.col("p"), F.col("q"), F.col("d")
    common = p.isNotNull() & q.isNotNull()
    moved = common & (d != 0)
    # Largest finite displacement; the first place in row-major order wins ties.
    top = F.max(F.when(moved & is_finite(d), F.struct(d.alias("d"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))))
    out = pair.groupBy(*keys).agg(
        flag_count(p.isNotNull()).alias("before_valid"),
        flag_count(q.isNotNull()).alias("after_valid"),
        flag_count(common).alias("common"),
        flag_count(p.isNotNull() & q.isNull()).alias("before_only"),
        flag_count(p.isNull() & q.isNotNull()).alias("after_only"),
        flag_count(moved).alias("changed"),
        F.avg(F.when(moved, d)).alias("mean"),
        top.alias("top"),
    )
    return out.select(
        *keys, "before_valid", "after_valid", "common", "before_only", "after_only", "changed",
        finite_or_null(F.coalesce("mean", F.lit(0.0))).alias("mean_displacement"),
        F.coalesce("top.d", F.lit(0.0)).alias("max_displacement"),
        F.coalesce(-F.col("top.r"), F.lit(0)).alias("max_row"),
        F.coalesce(-F.col("top.c"), F.lit(0)).alias("max_col"),
    )


def to_source_grid(local: DataFrame, offset_row: str, offset_col: str) -> DataFrame:
    """Saved grid positions back to source positions: source = local - offset."""
    return local.withColumn("row", F.col("row") - F.col(offset_row)).withColumn("col", F.col("col") - F.col(offset_col))


def aligned_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Like ``surface_diff`` on aligned grids, with double arithmetic and finite-only means."""
    pair = _matched(by_sentinel(before), by_sentinel(after), keys)
    changed, gap = F.lit(False), F.lit(0.0)
    for a in "xyz":
        u, v = F.col(f"p.{a}"), F.col(f"q.{a}")
        # NaN differs from everything, itself included.
        changed = changed | F.isnan(u) | F.isnan(v) | (u != v)
        gap = gap + (v - u) * (v - u)
    p, q = F.col("p"), F.col("q")
    both = p.isNotNull() & q.isNotNull()
    pair = pair.withColumn("d", F.sqrt(gap)).withColumn("changed", both & changed)
    d, moved = F.col("d"), F.col("changed") & is_finite(F.col("d"))
    top = F.max(F.when(moved, F.struct(d.alias("d"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))))
    out = pair.groupBy(*keys).agg(
        flag_count(both).alias("common"),
        flag_count(p.isNotNull() & q.isNull()).alias("before_only"),
        flag_count(p.isNull() & q.isNotNull()).alias("after_only"),
        flag_count(F.col("changed")).alias("changed"),
        flag_count(F.col("changed") & ~is_finite(d)).alias("nonfinite_changed"),
        F.coalesce(F.avg(F.when(moved, d)), F.lit(0.0)).alias("mean_changed"),
        F.coalesce(F.avg(F.when(both & is_finite(d), d)), F.lit(0.0)).alias("mean_common"),
        top.alias("top"),
    )
    return out.select(
        *keys, "common", "before_only", "after_only",
        (F.col("before_only") + F.col("after_only")).alias("symmetric_difference"),
        "changed", "nonfinite_changed", "mean_changed", "mean_common",
        F.coalesce("top.d", F.lit(0.0)).alias("max_displacement"),
        (-F.col("top.r")).alias("max_row"),
        (-F.col("top.c")).alias("max_col"),
    )


def cells_differing(left: DataFrame, right: DataFrame, flag: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells whose flag differs between two masks; a cell that one side lacks counts as false there."""
    at = [*keys, "row", "col"]
    a = left.select(*at, F.col(flag).alias("_a"))
    b = right.select(*at, F.col(flag).alias("_b"))
    no = F.lit(False)
    return a.join(b, at, "full_outer").where(F.coalesce("_a", no) != F.coalesce("_b", no)).select(*at)


def dilate(cells: DataFrame, radius: int, shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells within Chebyshev distance ``radius``, clipped to the ``height`` x ``width`` cell lattice.

    Two one-dimensional passes with a distinct in between copy a cell 2 (2r+1) instead of (2r+1)^2 times.
    """
    if radius < 0:
        raise ValueError("radius must be 0 or more")
    keys = list(keys)
    out = cells.select(*keys, "row", "col").distinct().join(shapes, keys)
    for axis, size in (("col", "width"), ("row", "height")):
        reach = F.sequence(F.greatest(F.col(axis) - radius, F.lit(0)), F.least(F.col(axis) + radius, F.col(size) - 1))
        # A position off the lattice by more than the radius reaches nothing.
        near = (F.col(axis) + radius >= 0) & (F.col(axis) - radius <= F.col(size) - 1)
        out = out.where(near).withColumn(axis, F.explode(reach)).distinct()
    return out.drop("height", "width")

"""Projections between vertices, edges and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import add, flag_count, is_finite, norm, unit, vec
from latticeqc.operators.grid import quad_cells
from latticeqc.functions.sqltext import stage
from latticeqc.operators.tiles import OWN, TILE, neighbour, owned_text, tile

KEYS = ("package_id",)


def _shifted(df: DataFrame, keys: Sequence[str], steps, *columns) -> DataFrame:
    """One row per shift ``(dr, dc)``."""
    moves = F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])
    return df.select(*keys, F.explode(moves).alias("_m"), *columns).select(*keys, "_m.row", "_m.col", *columns)


def inside(df: DataFrame, shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep positions on the cell lattice of their package."""
    on = F.col("row").between(0, F.col("height") - 2) & F.col("col").between(0, F.col("width") - 2)
    return df.join(shapes, list(keys)).where(on).drop("height", "width")


def vertices_to_cells(flagged: DataFrame, shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells with at least one of the given vertices as a corner."""
    moved = _shifted(flagged, keys, [(0, 0), (0, -1), (-1, 0), (-1, -1)])
    return inside(moved, shapes, keys).distinct()


def edges_to_cells(edges: DataFrame, columns: Sequence[str], shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both cells beside each edge, keeping ``columns``; for edges that come from elsewhere than the frame."""
    other = F.when(F.col("direction") == "horizontal", F.struct(F.col("row") - 1, F.col("col"))).otherwise(
        F.struct(F.col("row"), F.col("col") - 1)
    )
    pair = F.array(F.struct("row", "col"), other)
    moved = edges.select(*keys, F.explode(pair).alias("_m"), *columns).select(
        *keys, F.col("_m.row").alias("row"), F.col("_m.col").alias("col"), *columns
    )
    return inside(moved, shapes, keys)


def adjacency_to_cells(pairs: DataFrame, flag: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """A flag between a cell and its right or lower neighbour goes to both cells."""
    step = lambda d: F.when(F.col("direction") == d, 1).otherwise(0)
    both = F.array(
        F.struct(F.col("row").alias("row"), F.col("col").alias("col")),
        F.struct((F.col("row") + step("vertical")).alias("row"), (F.col("col") + step("horizontal")).alias("col")),
    )
    moved = pairs.select(*keys, F.explode(both).alias("_m"), flag).select(*keys, "_m.row", "_m.col", flag)
    return moved.groupBy(*keys, "row", "col").agg(F.bool_or(flag).alias(flag))


def incident_vertices(surf: DataFrame, keys: Sequence[str] = KEYS, size: int = TILE) -> DataFrame:
    """Per vertex: part of a valid cell, and valid without any; one tiled shuffle."""
    keys = list(keys)
    tiled = tile(surf.select(*keys, "row", "col", "valid"), keys, 1, 1, size)
    right, left = neighbour(keys, "col", 1), neighbour(keys, "col", -1)
    down, up = neighbour(keys, "row", 1), neighbour(keys, "row", -1)
    paired = stage(tiled, {"_pair": f"valid AND coalesce({right('valid')}, false)", OWN: owned_text(size)})
    celled = stage(paired, {"_cell": f"_pair AND coalesce({down('_pair')}, false)"})
    high = stage(celled, {"_line": f"_cell OR coalesce({up('_cell')}, false)"})
    touched = stage(high, {"incident": f"_line OR coalesce({left('_line')}, false)"})
    return touched.where(OWN).selectExpr(*keys, "row", "col", "incident", "valid AND NOT incident AS without_face")


def with_shape(df: DataFrame, vertices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    from latticeqc.session import materialize

    shapes = vertices.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return df.join(materialize(shapes), list(keys))


def boundary_cells(vertices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells valid by ``x <> -1`` with their place relative to the last legal row and column."""
    marked = vertices.withColumn("valid", F.isnan("x") | (F.col("x") != -1))
    placed = with_shape(quad_cells(marked, "valid", keys), vertices, keys)
    return placed.withColumns(
        {
            "last_row": F.col("cell_valid") & (F.col("row") + 2 == F.col("height")),
            "last_col": F.col("cell_valid") & (F.col("col") + 2 == F.col("width")),
        }
    )


def boundary_counts(vertices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    x = F.col("x")
    count = vertices.groupBy(*keys).agg(flag_count(F.isnan(x) | (x != -1)).alias("valid_vertices"))
    last_row, last_col = F.col("last_row"), F.col("last_col")
    quads = boundary_cells(vertices, keys).groupBy(*keys, "height", "width").agg(
        flag_count(F.col("cell_valid")).alias("valid_quads"),
        flag_count(last_row | last_col).alias("added_quads"),
        flag_count(last_row).alias("last_row_quads"),
        flag_count(last_col).alias("last_col_quads"),
        flag_count(last_row & last_col).alias("corner_quad"),
    )
    return quads.join(count, list(keys))


def halfopen_counts(df: DataFrame, flag: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Faces and distinct corner vertices when cell origins are limited to rows-2 by cols-2."""
    cells = with_shape(quad_cells(df, flag, keys), df, keys).where(
        "cell_valid AND row < height - 2 AND col < width - 2"
    )
    touched = _shifted(cells, keys, [(0, 0), (0, 1), (1, 0), (1, 1)]).distinct()
    faces = cells.groupBy(*keys).agg((2 * F.count("*")).alias("faces"))
    return faces.join(touched.groupBy(*keys).agg(F.count("*").alias("vertices")), list(keys))


def edge_normals(frame: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unit normal of each supported edge: the direction of the sum of its two vertex normals."""

    def one(direction: str, end: str, ok: str):
        total = add(vec("vn"), vec("vn", end))
        supported = F.col(ok) & F.col("vn_ok") & F.coalesce(F.col(f"vn_ok{end}"), F.lit(False))
        return F.struct(
            F.lit(direction).alias("direction"), supported.alias("supported"), *[c.alias(f"s{a}") for c, a in zip(total, "xyz")]
        )

    pairs = frame.select(*keys, "row", "col", F.explode(F.array(one("horizontal", "01", "h_ok"), one("vertical", "10", "v_ok"))).alias("e"))
    sized = pairs.select(*keys, "row", "col", "e.*").where("supported").withColumn("len", norm(vec("s")))
    return sized.where(is_finite(F.col("len")) & (F.col("len") > 1e-12)).withColumns(
        {f"n{a}": c for a, c in zip("xyz", unit(vec("s"), F.col("len")))}
    )

"""Square tiles with a halo: the layout behind every neighbourhood operator.

A vertex goes to the tile that owns it and, near a tile edge, also to the tiles that need it as
context.  One shuffle on ``(keys, tile)`` then serves every row-wise and column-wise window, because
``(keys, tile)`` is a subset of both window keys.  A tile holds at most (size + halo)^2 vertices, so
a package with a third of all rows spreads over as many tasks as any other data of its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

TILE = 128
TILE_ROW, TILE_COL, OWN = "_tile_row", "_tile_col", "_own"


def tile(df: DataFrame, keys: Sequence[str], before: int = 0, after: int = 1, size: int = TILE) -> DataFrame:
    def spread(position: str) -> str:
        return f"explode(sequence(greatest({position} - {after}, 0) div {size}, ({position} + {before}) div {size}))"

    copies = df.selectExpr("*", f"{spread('row')} AS {TILE_ROW}").selectExpr("*", f"{spread('col')} AS {TILE_COL}")
    return copies.repartition(*keys, TILE_ROW, TILE_COL)


def owned_text(size: int = TILE) -> str:
    """True for the one copy of a vertex that belongs to its tile."""
    return f"(row div {size} = {TILE_ROW} AND col div {size} = {TILE_COL})"


def neighbour(keys: Sequence[str], axis: str, step: int):
    """SQL text of a value one step along a grid line; null where the lattice has no such vertex."""
    line = "row" if axis == "col" else "col"
    over = f"OVER (PARTITION BY {', '.join([*keys, TILE_ROW, TILE_COL, line])} ORDER BY {axis})"
    shift = "lead" if step > 0 else "lag"

    def value(name: str) -> str:
        return f"CASE WHEN {shift}({axis}) {over} = {axis} + {step} THEN {shift}({name}) {over} END"

    return value

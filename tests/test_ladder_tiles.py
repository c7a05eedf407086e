"""The perturbation ladder and the proximity pairs on packed tiles against their row forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import components as C
from latticeqc.operators import grid, proximity
from latticeqc.operators import tile_kernel as K
from latticeqc.operators import tile_tables as T
from latticeqc.plans import perturbation as X
from latticeqc.plans.geometry_report import cell_shapes, tile_references
from latticeqc.session import materialize
from tests.grids import frame, surface

CFG = ReviewConfig()


def rough(r, c):
    rng = random.Random(1000 * r + c)
    return (-1, -1, -1) if (7 * r + 13 * c) % 41 == 0 else (c + 0.1 * rng.random(), r + 0.1 * rng.random(), 100 + 0.6 * rng.random())


@pytest.fixture(scope="module")
def surf(spark):
    # Wider than a tile, with valid vertices that share a place, and a row that occurs twice.
    wide = surface("wide", 14, T.TILE + 20, rough)
    tall = surface("tall", 20, 12, rough, invalid={(3, 3)})
    return frame(spark, wide, tall, tall[24:36]).cache()


def test_moved_tiles_hold_the_rows_of_the_ladder(surf):
    normals = X.averaged_normals(surf).dropDuplicates(["package_id", "row", "col"]).cache()
    seams = X.choose_seam(normals).cache()
    rows = X.offset_ladder(normals, seams, [4.0, 16.0], [1, 4]).drop("orientation", "seam")
    at = [*X.CASE, "tile_row", "tile_col"]
    planes = [F.hex(c).alias(c) if c in "xyz" or c == "state" else F.col(c) for c in T.PLANES if c != "rest"]
    want = sorted(map(tuple, T.surface_tiles(rows, X.CASE).select(*at, *planes).collect()))
    got = sorted(map(tuple, X.ladder_tiles(normals, seams, [4.0, 16.0], [1, 4]).select(*at, *planes).collect()))
    assert got == want and len(got) == 15


@pytest.mark.parametrize("crowd", [100_000, 7])
def test_pairs_of_tiles_are_those_of_rows(surf, monkeypatch, crowd):
    monkeypatch.setattr(proximity, "CROWD", crowd)
    tiles = T.surface_tiles(surf, ["package_id"])
    refs = tiles.select("package_id").distinct().selectExpr("package_id", "1D AS ref_h", "1D AS ref_v")
    columns = ["package_id", "a_row", "a_col", "b_row", "b_col", "distance", "visit"]
    sample = proximity.proximity_sample(proximity.usable_points(surf))
    want = sorted(map(tuple, proximity.proximity_pairs(sample, refs, CFG).select(columns).collect()))
    got = sorted(map(tuple, proximity.tile_pairs(tiles, refs, CFG).select(columns).collect()))
    assert got == want and len(want) > 1000
    assert tiles.agg(F.sum(F.length("rest"))).first()[0] == 12 * K.POINT.itemsize


def test_benchmark_packs_no_rows_of_cases(surf, monkeypatch):
    """Vertices are packed and points dealt once for a package, not once for each of its cases."""
    asked = []

    def noted(fn):
        def wrapped(df, *args, **kwargs):
            asked.append(df.columns)
            return fn(df, *args, **kwargs)

        return wrapped

    monkeypatch.setattr(T, "surface_tiles", noted(T.surface_tiles))
    monkeypatch.setattr(proximity, "proximity_pairs", noted(proximity.proximity_pairs))
    out = X.perturbation_benchmark(surf.dropDuplicates(["package_id", "row", "col"]), [16.0], [1]).collect()
    assert len(out) == 4 and all(r.detected == (r.offset_voxels > 0) for r in out)
    assert asked and not any("offset_voxels" in columns for columns in asked)


def test_no_table_of_cells_or_components_is_broadcast(surf):
    """Files of places and labels are far smaller than the rows in memory, so the size of the files must not decide."""
    at = ["package_id", "row", "col"]
    cells = materialize(grid.quad_cells(surf.dropDuplicates(at)))
    shapes = cell_shapes(surf)
    gaps = materialize(C.label_runs(cells.where("NOT cell_valid"), ["package_id"], 8))
    cues = materialize(cells.selectExpr(*at, "1D AS offset_voxels", "4 AS width_cells", "cell_valid AS cue"))
    marks = materialize(cells.selectExpr(*at, "row % 2 = 0 AS cue"))
    line = cells.where("cell_valid AND row = 5")
    near = X.evaluation_cells(line, cells, shapes)
    made = [near, C.enclosed(gaps, shapes), X.incremental(cues, marks), X.incremental(cues, marks, flags=["cue"])]
    for table in made:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[[^\]]*(row|label)#", plan) and "SortMergeJoin" in plan
    valid = {tuple(r) for r in cells.where("cell_valid").select(*at).collect()}
    seam = {tuple(r) for r in line.select(*at).collect()}
    assert {tuple(r) for r in near.select(*at).collect()} == {(p, r, c) for p, r, c in valid if any((p, 5, c + d) in seam for d in (-1, 0, 1)) and 4 <= r <= 6}
    unmarked = {tuple(r) for r in cells.where("row % 2 = 1").select(*at).collect()}
    want = {(*k, k in valid and k in unmarked) for k in {tuple(r) for r in cells.select(*at).collect()}}
    assert {tuple(r) for r in made[3].select(*at, "incremental_cue").collect()} == want


def test_portals_are_not_broadcast(surf, monkeypatch):
    keys, found = ["package_id"], []
    tiles = T.surface_tiles(surf.dropDuplicates(["package_id", "row", "col"]), keys)
    reviewed = T.review_tiles(tiles, tile_references(tiles, CFG, keys), CFG, keys, values=False)
    monkeypatch.setattr(T, "star_components", lambda edges, by, f=T.star_components: found.append(edges) or f(edges, by))
    parts = T.tile_components(reviewed, keys)
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # The wide surface lies in two tiles and is one piece.
    vertex = parts.where("kind = 'vertex' AND label = row * 2147483648 + lo").groupBy("package_id").count()
    assert {r["package_id"]: r["count"] for r in vertex.collect()} == {"wide": 1, "tall": 1}

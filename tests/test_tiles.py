"""Tile passes against the column stages on surfaces of many tiles, pairs against brute force, bootstrap against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import components as C
from latticeqc.operators import geometry as G
from latticeqc.operators import proximity
from latticeqc.operators import tile_tables as T
from latticeqc.operators.quantiles import summary
from latticeqc.plans.full_review import DOUBLE, SINGLE
from latticeqc.plans.geometry_report import tile_references
from latticeqc.plans.scoring import cluster_bootstrap

CFG = ReviewConfig(normal_step_ratio=0.15)
KEYS = ["package_id"]
SIZE = 8


def spiral(n):
    """A one-cell path that winds to the middle, so that its component runs through every tile many times."""
    grid = np.zeros((n, n), bool)
    r, c, dr, dc = 0, 0, 0, 1
    grid[0, 0] = True
    for _ in range(n * n):
        nr, nc = r + dr, c + dc
        ahead = nr + dr, nc + dc
        blocked = not (0 <= nr < n and 0 <= nc < n) or grid[nr, nc] or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead])
        if blocked:
            dr, dc = dc, -dr
            if grid[(r + dr) % n, (c + dc) % n] or not (0 <= r + dr < n and 0 <= c + dc < n):
                break
            continue
        r, c = nr, nc
        grid[r, c] = True
    return grid


@pytest.fixture(scope="module")
def surf(spark):
    rng = random.Random(11)
    rows = []
    winding = spiral(27)
    for package in (1, 2, 3):
        for r in range(27):
            for c in range(27):
                if package == 2 and (r, c) in ((4, 4), (20, 9)):
                    continue
                x, y, z = c + 0.2 * rng.random(), r + 0.2 * rng.random(), 100 + (3.0 if c > 15 and package == 1 else 0.0) + 0.6 * rng.random()
                odd = rng.random()
                if odd < 0.02:
                    x, y, z = -1.0, -1.0, -1.0
                elif odd < 0.03:
                    x = float("nan")
                elif odd < 0.04:
                    x, y = x - 3, y + 2
                valid = z > 0 and (rng.random() < 0.96 if package < 3 else bool(winding[r, c]))
                rows.append((package, r, c, x, y, z, valid, True if package == 1 else None))
    return spark.createDataFrame(rows, "package_id long, row int, col int, x double, y double, z double, valid boolean, explicit_mask boolean").cache()


@pytest.fixture(scope="module")
def both(spark, surf):
    refs = G.spacing_reference(surf, CFG)
    tiles = T.surface_tiles(surf, KEYS, SIZE)
    reviewed = T.review_tiles(tiles, refs, CFG, KEYS, 5, SIZE)
    return refs, tiles, reviewed, G.surface_frame(surf, refs, CFG).cache()


def near(a, b):
    return a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b)))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_references(surf, both):
    names = ("package_id", "obs_h", "obs_v", "ref_h", "ref_v")
    assert rows_of(tile_references(both[1], CFG, KEYS, SIZE), *names) == rows_of(both[0], *names)


def test_counters(surf, both):
    refs, _, reviewed, frame = both
    got = {r.package_id: r.asDict() for r in T.tile_counters(reviewed, KEYS).collect()}
    for table in (G.cell_counts(frame, CFG), G.vertex_integrity(surf)):
        for r in table.collect():
            for name, value in r.asDict().items():
                mine = got[r.package_id][name]
                assert mine == value or (name == "surface_area" and near(mine, value)), (name, mine, value)


def test_cells(both):
    _, _, reviewed, frame = both
    got = {(r.package_id, r.row, r.col): r for r in T.tile_cells(reviewed, KEYS, SIZE).collect()}
    want = frame.where("cell").select("package_id", "row", "col", "cell_valid", "local_cue", "local_score").collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.package_id, r.row, r.col]
        assert (g.cell_valid, g.local_cue) == (r.cell_valid, r.local_cue)
        assert (g.local_score is None and r.local_score is None) or near(g.local_score, r.local_score)


def test_components_run_through_tiles(surf, both):
    _, _, reviewed, frame = both
    parts = T.tile_components(reviewed, KEYS).cache()
    masks = {"vertex": (surf.where("valid"), 4), "cell": (frame.where("cell_valid"), 4), "gap": (frame.where("cell AND NOT cell_valid"), 8), "step": (frame.where("cell AND step_candidate"), 8)}
    for kind, (cells, reach) in masks.items():
        labelled = C.label_runs(cells.select("package_id", "row", "col"), KEYS, reach).cache()
        counts = {r.package_id: r.n for r in labelled.groupBy("package_id").agg(F.count_distinct("label").alias("n")).collect()}
        got = {r.package_id: r.n for r in T.component_count(parts, KEYS, kind, "n").collect() if r.n}
        assert got == counts, kind
        if kind in ("gap", "step"):
            mine = C.expand_runs(parts.where(F.col("kind") == kind))
            assert rows_of(mine, "package_id", "row", "col", "label") == rows_of(C.expand_runs(labelled), "package_id", "row", "col", "label")


def test_distributions_and_lists(both):
    _, _, reviewed, frame = both
    got = {(r.package_id, list(T.VALUES)[r.metric]): (r.n, r.q) for r in T.value_quantiles(reviewed, KEYS, (0.0, 0.05, 0.5, 0.95, 1.0)).collect()}
    for r in summary(G.metric_rows(frame), KEYS, "metric", "value").collect():
        n, q = got[r.package_id, r.metric]
        assert n == r["count"] and all(map(near, q, (r.min, r.p05, r.p50, r.p95, r.max))), r.metric
    rounded = lambda df: df.withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(F.round("value", 9)))
    columns = ("package_id", "cue", "tag", "row", "col", "rank")
    for cues in (SINGLE, DOUBLE):
        want = G.top_locations(rounded(G.example_candidates(frame, cues, CFG)), 5)
        mine = G.top_locations(rounded(T.tile_candidates(reviewed, KEYS, cues)), 5)
        assert rows_of(mine, *columns) == rows_of(want, *columns)


@pytest.mark.parametrize("crowd", [100_000, 40])
def test_pairs_of_crowded_places(spark, monkeypatch, crowd):
    """Two sheets and a hundred points in one place, with blocks whole and dealt over pairs of parts."""
    monkeypatch.setattr(proximity, "CROWD", crowd)
    monkeypatch.setattr(proximity, "AT_ONCE", 500)
    rng = random.Random(2)
    points = [(7, r, c, c % 12 + 0.1 * rng.random(), float(r), 0.2 * (c // 12)) for r in range(15) for c in range(24)]
    points += [(7, 100 + 6 * i, 0, 3.0, 3.0, 0.05) for i in range(100)]
    sample = spark.createDataFrame(points, "package_id long, row int, col int, x double, y double, z double")
    refs = spark.createDataFrame([(7, 1.0, 1.0)], "package_id long, ref_h double, ref_v double")
    got = sorted((r.a_row, r.a_col, r.b_row, r.b_col) for r in proximity.proximity_pairs(sample, refs, CFG).collect())
    want = []
    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            a, b = sorted((p, q), key=lambda s: s[1:3])
            if max(abs(p[1] - q[1]), abs(p[2] - q[2])) > 4 and math.dist(p[3:], q[3:]) < 0.25:
                want.append((*a[1:3], *b[1:3]))
    assert got == sorted(want) and len(want) > 4_950


def test_bootstrap_draws(spark, monkeypatch):
    from latticeqc.plans import scoring

    monkeypatch.setattr(scoring, "UNIT_CHUNK", 4)
    monkeypatch.setattr(scoring, "DRAWS", 50)
    rows = [(g, f"u{i:02d}", float(i % 4), 1.0 + i % 3) for g, n in (("a", 11), ("b", 1), ("c", 5)) for i in range(n)]
    units = spark.createDataFrame(rows, "g string, unit string, num double, den double")
    got = {r.g: r for r in cluster_bootstrap(units, ["g"], "unit", "s", 40).collect()}
    by = defaultdict(list)
    for g, _, num, den in rows:
        by[g].append((num, den))
    for g, own in by.items():
        rates = []
        for i in range(40):
            drawn = [own[int(hashlib.md5(f"s|{g}|{i}|{d}".encode()).hexdigest()[:15], 16) % len(own)] for d in range(len(own))]
            rates.append(sum(x for x, _ in drawn) / sum(y for _, y in drawn))
        low, high = np.quantile(rates, [0.025, 0.975])
        assert near(got[g].low, low) and near(got[g].high, high) and got[g].units == len(own)
    whole = cluster_bootstrap(units.where("g = 'a'").drop("g"), [], "unit", "s", 10).collect()
    assert len(whole) == 1 and whole[0].units == 11

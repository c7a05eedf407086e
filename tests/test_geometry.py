import math

import pytest

from latticeqc.config import ReviewConfig
from latticeqc.operators import geometry as G
from latticeqc.plans.geometry_report import geometry_report
from tests.grids import changed, cylinder, flat, frame, surface


@pytest.fixture(scope="module")
def report(spark):
    surf = frame(
        spark,
        surface("plane", 6, 7, flat),
        surface("hole", 7, 7, flat, invalid={(3, 3)}),
        surface("fold", 2, 2, changed(flat, {(1, 1): (-1, 1, 10)})),
        surface("touch", 12, 12, changed(flat, {(11, 11): (0.1, 0.1, 10.1)})),
        surface("collapse", 4, 4, changed(flat, {(1, 1): (1, 0, 10)})),
        surface("mirror", 8, 8, lambda r, c: (-c, r, 10)),
        surface("cylinder", 10, 60, cylinder),
        surface("empty", 1, 1, lambda r, c: (-1, -1, -1), invalid={(0, 0)}),
        surface("two", 3, 5, flat, invalid={(0, 2), (1, 2), (2, 2)}),
    )
    return geometry_report(surf)


@pytest.fixture(scope="module")
def summary(report):
    return {r["package_id"]: r for r in report.summary.collect()}


@pytest.fixture(scope="module")
def codes(report):
    found = {}
    for r in report.findings.collect():
        found.setdefault(r["package_id"], set()).add(r["code"])
    return found


def test_plane_is_clean(summary, codes):
    plane = summary["plane"]
    assert (plane["vertex_count"], plane["valid_quads"], plane["surface_area"]) == (42, 30, 30.0)
    assert plane["obs_h"] == plane["obs_v"] == 1.0
    assert "plane" not in codes


def test_hole_is_one_region_apart_from_the_cues(summary, report):
    assert (summary["hole"]["enclosed_regions"], summary["hole"]["enclosed_cells"]) == (1, 4)
    cue = {(r["row"], r["col"]) for r in report.cells.where("package_id = 'hole' AND cue").collect()}
    assert not cue & {(2, 2), (2, 3), (3, 2), (3, 3)}


def test_fold_scores_one(summary, report):
    assert summary["fold"]["folded_quads"] == 1
    assert report.cells.where("package_id = 'fold'").first()["score"] == 1.0


def test_touching_points_are_a_pair(summary, codes):
    assert summary["touch"]["pair_count"] >= 1
    assert "nonlocal-proximity" in codes["touch"]


def test_collapse_has_short_edges_and_degenerate_triangles(summary):
    assert summary["collapse"]["short_edges"] >= 1
    assert summary["collapse"]["degenerate_triangles"] >= 1


def test_reflection_does_not_fold_or_flip(summary):
    assert (summary["mirror"]["folded_quads"], summary["mirror"]["orientation_flips"]) == (0, 0)


def test_cylinder_has_no_jumps(summary):
    assert (summary["cylinder"]["normal_jumps"], summary["cylinder"]["folded_quads"]) == (0, 0)


def test_empty_package_has_zero_counts_and_no_spacing(summary):
    empty = summary["empty"]
    assert (empty["valid_count"], empty["valid_quads"], empty["pair_count"]) == (0, 0, 0)
    assert empty["obs_h"] is None


def test_split_surface_has_two_components(summary, codes):
    assert summary["two"]["vertex_components"] == 2
    assert "disconnected-vertices" in codes["two"]


def test_declared_spacing_gives_drift_only(spark):
    cfg = ReviewConfig(expected_spacing_x=1.0, expected_spacing_y=1.0)
    surf = frame(
        spark, surface("wide", 8, 8, lambda r, c: (1.4 * c, 1.3 * r, 10)), surface("shear", 8, 8, lambda r, c: (c + 3 * r, r, 10))
    )
    refs = G.spacing_reference(surf, cfg)
    wide = G.target_spacing(refs, cfg).where("package_id = 'wide'").first()
    assert wide["isotropic"] == pytest.approx(math.sqrt(1.82))
    assert wide["anisotropy"] == pytest.approx(1.4 / 1.3)
    cells = G.surface_frame(surf, refs, cfg)
    shear = cells.where("cell AND package_id = 'shear'").selectExpr("median(condition_number) AS m", "count_if(high_shear) AS n").first()
    assert shear["m"] > 10 and shear["n"] > 0


def test_unusable_settings_are_rejected():
    with pytest.raises(ValueError):
        ReviewConfig(long_edge_ratio=0.4).check()
    with pytest.raises(ValueError):
        ReviewConfig(shear=1.0).check()
    ReviewConfig(max_proximity_pairs=0).check()

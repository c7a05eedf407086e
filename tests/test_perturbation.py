from latticeqc.plans.perturbation import perturbation_benchmark
from tests.grids import frame, surface


def test_abrupt_offset_is_detected_and_null_case_is_not(spark):
    surf = frame(spark, surface("p", 24, 28, lambda r, c: (c, r, 20)))
    rows = {r["offset_voxels"]: r for r in perturbation_benchmark(surf, [16.0], [1]).collect()}
    assert set(rows) == {0.0, 16.0}
    null, step = rows[0.0], rows[16.0]
    assert not (null["detected"] or null["raw_detected"] or null["step_detected"])
    assert step["detected"] and step["step_detected"] and step["before_detected"]
    # The seam runs through one row of 27 cells and is judged within one cell of it.
    assert step["evaluation_cells"] == 81

"""The layouts that make the operators scale give the same results as plain array code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import components as C
from latticeqc.operators import diff, grid, proximity
from latticeqc.operators import geometry as G
from latticeqc.operators.ordering import evenly_spaced, with_global_position
from latticeqc.operators.quantiles import exact_quantiles
from latticeqc.plans.geometry_report import cell_shapes
from latticeqc.plans.splits import isolated_split


@pytest.fixture(scope="module")
def mask():
    return np.random.default_rng(5).random((150, 140)) > 0.3


@pytest.fixture(scope="module")
def marked(spark, mask):
    rows, cols = np.indices(mask.shape)
    data = pd.DataFrame({"package_id": 1, "row": rows.ravel(), "col": cols.ravel(), "valid": mask.ravel()})
    return spark.createDataFrame(data, "package_id bigint, row int, col int, valid boolean").repartition(5)


def flood(mask, steps):
    label = -np.ones(mask.shape, dtype=int)
    sizes = []
    for start in zip(*np.nonzero(mask)):
        if label[start] >= 0:
            continue
        stack, size = [start], 0
        label[start] = len(sizes)
        while stack:
            r, c = stack.pop()
            size += 1
            for dr, dc in steps:
                q = (r + dr, c + dc)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and label[q] < 0:
                    label[q] = len(sizes)
                    stack.append(q)
        sizes.append(size)
    return sorted(sizes)


FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))


@pytest.mark.parametrize("size", [16, 128, 1024])
def test_quads_do_not_depend_on_the_tile_size(marked, mask, size):
    expected = int((mask[:-1, :-1] & mask[:-1, 1:] & mask[1:, :-1] & mask[1:, 1:]).sum())
    cells = grid.quad_cells(marked, size=size)
    row = cells.agg(F.count("*").alias("n"), F.count_if("cell_valid").alias("v")).first()
    assert (row["n"], row["v"]) == (149 * 139, expected)


@pytest.mark.parametrize("connectivity, steps", [(4, FOUR), (8, EIGHT)])
def test_components_match_flood_fill(marked, mask, connectivity, steps):
    labelled = C.label_runs(marked.where("valid"), ["package_id"], connectivity)
    sizes = sorted(r["size"] for r in C.component_sizes(labelled).collect())
    assert sizes == flood(mask, steps)


def test_frame_uses_one_shuffle_for_all_neighbourhood_stages(spark, marked):
    surf = marked.selectExpr("*", "double(col) AS x", "double(row) AS y", "10D AS z", "CAST(NULL AS BOOLEAN) AS explicit_mask")
    cfg = ReviewConfig()
    refs = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "package_id bigint, obs_h double, obs_v double, ref_h double, ref_v double")
    plan = G.surface_frame(surf, F.broadcast(refs), cfg).select("row", "local_score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(package_id") == 1
    assert "Python" not in plan


def test_frame_does_not_depend_on_partitioning_or_row_order(spark, marked):
    surf = marked.selectExpr("*", "col + 0.2D * sin(row) AS x", "row + 0.1D * cos(col) AS y", "10D + sin(row * col) AS z", "CAST(NULL AS BOOLEAN) AS explicit_mask")
    cfg = ReviewConfig()
    refs = G.spacing_reference(surf, cfg)
    results = [
        G.cell_counts(G.surface_frame(s, refs, cfg), cfg).first().asDict()
        for s in (surf, surf.orderBy(F.desc("col")).repartition(3))
    ]
    area = [r.pop("surface_area") for r in results]
    assert results[0] == results[1] and area[0] == pytest.approx(area[1])


def test_quantiles_of_groups_too_large_for_one_task(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"k": ["a"] * 3000 + ["b"] * 50, "v": np.concatenate([rng.lognormal(0, 3, 2000), np.full(1000, 2.5), rng.random(50)])})
    df = spark.createDataFrame(data)
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs, group_limit=100).collect()}
    for key, part in data.groupby("k"):
        assert got[key] == pytest.approx(np.quantile(part["v"], probs).tolist())


def test_global_position_and_even_selection(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": [f"{i:04d}" for i in range(500)], "w": range(500)})).repartition(7)
    rows = with_global_position(df, ["id"], weight="w").orderBy("id").collect()
    assert [r["pos"] for r in rows] == list(range(500))
    assert [r["running"] for r in rows] == np.cumsum(range(500)).tolist()
    for limit in (1, 7, 64, 500, 900):
        kept = [r["pos"] for r in with_global_position(df, ["id"]).where(evenly_spaced(500, limit, F.col("pos"))).collect()]
        want = set(range(500)) if limit >= 500 else set(np.linspace(0, 499, num=limit, dtype=np.int64).tolist())
        assert set(kept) == want


def test_star_contraction_on_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(path + hub, "u bigint, v bigint").repartition(4)
    labels = {r["node"]: r["label"] for r in C.star_components(edges).collect()}
    assert {labels[i] for i in range(301)} == {0}
    assert {labels[1000 + i] for i in range(400)} == {1000}


def test_dilation_stops_at_the_border(spark):
    lattice = spark.createDataFrame([("p", 7, 8)], "package_id string, height int, width int")
    cells = spark.createDataFrame([("p", 3, 4)], "package_id string, row int, col int")
    assert diff.dilate(cells, 2, lattice).count() == 25
    assert diff.dilate(spark.createDataFrame([("p", 0, 0)], cells.schema), 2, lattice).count() == 9


def test_proximity_sample_is_capped_and_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.random((400, 3)) * 3
    rows = [(1, i // 20, i % 20, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "package_id bigint, row int, col int, x double, y double, z double")
    even = df.where("row % 2 = 0 AND col % 2 = 0")
    sample = proximity.proximity_sample(even, 25)
    assert sample.count() <= 25
    cfg = ReviewConfig(nonlocal_distance_ratio=0.3)
    refs = spark.createDataFrame([(1, 1.0, 1.0)], "package_id bigint, ref_h double, ref_v double")
    got = {((r["a_row"], r["a_col"]), (r["b_row"], r["b_col"])) for r in proximity.proximity_pairs(df, refs, cfg).collect()}
    want = set()
    for i in range(400):
        for j in range(i + 1, 400):
            a, b = divmod(i, 20), divmod(j, 20)
            if max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 4 and np.linalg.norm(points[i] - points[j]) < 0.3:
                want.add((a, b))
    assert got == want and want


def test_split_keeps_components_together(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "d")], "u string, v string")
    dev = spark.createDataFrame([("a",)], "node string")
    roles = {r["node"]: r["role"] for r in isolated_split(nodes, edges, dev, 2, "s").collect()}
    assert roles["a"] == "development" and roles["b"] == "excluded"
    assert roles["c"] == roles["d"] and {roles[n] for n in "cde"} <= {"clean", "holdout"}
    assert sum(role == "holdout" for role in roles.values()) >= 2


def test_cell_lattice_size(marked):
    row = cell_shapes(marked).first()
    assert (row["height"], row["width"]) == (149, 139)


def test_quantiles_have_the_same_bits_in_both_ways(spark):
    values = np.random.default_rng(3).random(1501)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(1501) % 3, "v": values}))
    probs = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    plain = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    narrowed = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs, group_limit=10).collect()}
    assert plain == narrowed


def test_hub_of_a_component_is_split_over_tasks(spark):
    edges = spark.range(60_000).selectExpr("id + 1 AS u", "CASE WHEN id % 10 = 0 THEN id ELSE 0 END AS v").repartition(8)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        star = C._large_star(edges.where("u > v"), [])
        star.collect()
        assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_component_ids_have_one_rule(spark):
    from latticeqc.plans.splits import component_ids

    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, label string")
    first = {r["node"]: r["component_id"] for r in component_ids(labels).collect()}
    again = {r["node"]: r["component_id"] for r in component_ids(labels.repartition(3).orderBy("node", ascending=False)).collect()}
    assert first == again and first["a"] == first["b"] != first["c"]

"""Dual-tree search against brute force, with copies, ties, clusters and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeqc.llm.cover_tree import CoverTree, TopK, exact_top_k
from latticeqc.llm.queries import QUERIES


def brute(rows, is_query, k, scale=256):
    whole = [(n, i, [int(np.floor(scale * x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in whole:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in whole if m != n and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "u") for i, v in rows], "vec_id long, embedding array<float>, uid string")


@pytest.mark.parametrize("options", [TopK(), TopK(k=3, part_rows=60, tree_rows=25, block_queries=7, leaf=3)], ids=["plain", "small parts"])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((4, 6))
    rows = [(int(i), np.float32(middles[i % 4] + 0.1 * rng.standard_normal(6)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[10][1]) for i in range(30)] + [(10, rows[10][1]), (20, None), (30, [1.0, None, 0, 0, 0, 0]), (40, [float("nan")] * 6), (50, [float("inf")] * 6), (None, rows[0][1]), (60, [1.0, 2.0]), (70, []), (80, [])]
    got = sorted(map(tuple, exact_top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, options).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, options.k)


def test_query_and_empty_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(map(tuple, QUERIES["op8_cover_tree_top_k"](spark, "/root/testdata/sf0.001").collect())) == brute(rows, lambda i: i % 50 == 0, 5)
    assert exact_top_k(table.where("false"), F.lit(True)).count() == 0


def test_tree_covers_and_separates():
    points = np.random.default_rng(0).integers(-100, 100, (300, 3)).astype(float)
    tree = CoverTree(points, 1.6, 8)
    assert sorted(tree.order.tolist()) == list(range(300))
    for n in range(len(tree.centre)):
        away = np.linalg.norm(points[tree.members(np.array([n]))] - points[tree.centre[n]], axis=1)
        assert away.max() <= tree.radius[n] + 1e-6
        heads = points[tree.centre[tree.children[n]]]
        for a in range(len(heads)):
            assert all(np.linalg.norm(heads[a] - heads[b]) > tree.radius[n] / 1.6 - 1e-6 for b in range(a))

"""Work that has to stay in proportion: joins without broadcasts of voxels, steps by blocks, digests in arrays, bounded batches."""

import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeqc.operators import volume as V
from latticeqc.operators.tile_tables import surface_tiles
from latticeqc.plans import scoring as S
from latticeqc.queries import all_queries
from latticeqc.session import BATCH_BYTES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rays_broadcast_no_voxels(spark):
    text = plan(all_queries.QUERIES["sample_rays_on_table"](spark, "/root/testdata/sf0.001"))
    # Only shapes, one row per package, may be broadcast; all other joins have several keys.
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*,", text)


def walked(sites, solid, shape, cap):
    """Every step of every site looked up alone."""
    out = {}
    for key, site, z, y, x, *normal in sites:
        if key not in shape:
            continue
        for sign in (1, -1):
            hit = {}
            for d in range(1, cap):
                at = [np.rint(0 if p is None or n is None else p + sign * d * n) for p, n in zip((z, y, x), normal)]
                hit[d] = (key, *[int(min(max(a, 0), size - 1)) for a, size in zip(at, shape[key])]) in solid
            gap = min((d for d in hit if not hit[d]), default=None)
            back = min((d for d in hit if hit[d] and gap is not None and d > gap), default=cap)
            held = out.setdefault((key, site, z, y, x), cap)
            out[key, site, z, y, x] = min(held, back)
    return out


@pytest.mark.parametrize("cap", [40, 5])
def test_spacing_by_blocks(spark, cap):
    rng = random.Random(cap)
    shape = {1: (9, 70, 150), 2: (1, 3, 4)}
    solid = {(k, rng.randrange(d), rng.randrange(h), rng.randrange(w)) for k, (d, h, w) in shape.items() for _ in range(9000 if k == 1 else 5)}
    sites = [(k, i, *[rng.randrange(n) for n in shape.get(k, (1, 1, 1))], *[rng.uniform(-1.6, 1.6) for _ in range(3)]) for i, k in enumerate([1] * 150 + [2] * 20 + [3])]
    sites += [(1, 900, 0, 0, 0, None, 0.0, 1.0), sites[0], (1, 901, 2, 2, 2, 0.0, 0.0, 0.0)]
    got = V.next_sheet_spacing(
        spark.createDataFrame(sites, "package_id long, site long, z int, y int, x int, nz double, ny double, nx double"),
        spark.createDataFrame([*solid, *list(solid)[:9], (1, None, 2, 3)], "package_id long, z int, y int, x int"),
        spark.createDataFrame([(k, *s) for k, s in shape.items()], "package_id long, depth int, height int, width int"), ["package_id"], cap,
    )
    rows = got.collect()
    expected = walked(sites, solid, shape, cap)
    assert len(rows) == len(expected) and {tuple(r)[:5]: r.spacing for r in rows} == expected
    # A site goes to the blocks that its 78 steps meet, not to every step.
    packed = V._packed(spark.createDataFrame(list(solid), "package_id long, z int, y int, x int"), ["package_id"])
    blocks = packed.collect()
    assert len(blocks) <= 3 * 3 * 3 + 1 and sum(bin(w % 2**64).count("1") for b in blocks for w in b.words) == len(solid)


@pytest.mark.parametrize("text, start, stop, n", [("boot-1|holdout", 8, 13, 1234), ("é" * 30, 98, 101, 11), ("", 0, 3, 1), ("x" * 48, 9, 11, 30), ("x" * 60, 9, 11, 30), ("s|1", 995, 1004, 70_000)])
def test_draws_are_the_digests(text, start, stop, n):
    got = list(S.drawn_places(text, start, stop, n))
    assert len(got) == stop - start
    for i, place in zip(range(start, stop), got):
        some = range(n) if n < 2000 else [0, 9, 10, 99, 9_999, 10_000, 32_768, n - 1]
        assert all(place[d] == int(md5(f"{text}|{i}|{d}".encode()).hexdigest()[:15], 16) % n for d in some)


def test_batches_of_tiles_are_cut_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    surf = spark.range(20).selectExpr("1L AS package_id", "int(id div 5) AS row", "int(id % 5) AS col", "double(id) AS x", "1D AS y", "2D AS z", "true AS valid", "CAST(NULL AS BOOLEAN) AS explicit_mask")
    assert surface_tiles(surf, ["package_id"]).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_compared_sides_keep_their_partitions(spark):
    sides = [spark.range(50 + i).selectExpr("id AS k", "sha2('a', 256) AS a") for i in range(2)]
    out = S.expected_vs_actual(*sides, ["k"], ["a"])
    assert plan(out).count("REPARTITION_BY_NUM") == 2
    assert out.where("passed").count() == 50 and out.where(~F.col("passed")).count() == 1

"""Vertices that are close in space but far apart on the grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.numeric import is_finite
from latticeqc.operators import tile_kernel as K
from latticeqc.operators.tiles import TILE
from latticeqc.session import materialize, small_batches, spread

KEYS = ("package_id",)


def usable_points(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    return surf.where(F.col("valid") & finite).select(*keys, "row", "col", "x", "y", "z")


def proximity_sample(points: DataFrame, max_points: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """All points, or with ``max_points`` those on a regular stride; if more than ``max_points`` remain, an evenly spaced subset of them.

    The place of a point in row-major order is the number of points in earlier rows plus its place in
    its own row, so no window covers a whole package.
    """
    keys = list(keys)
    if max_points is None:
        return points.withColumns({"stride": F.lit(1), "capped": F.lit(False)})
    counts = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / float(max_points)))).cast("int")
    strides = materialize(counts.withColumn("stride", stride).drop("_n"))
    strided = points.join(strides, keys).where("row % stride = 0 AND col % stride = 0")
    sizes = materialize(strided.groupBy(*keys).agg(F.count("*").alias("_m")))
    over = sizes.where(F.col("_m") > max_points)
    if over.isEmpty():
        return strided.withColumn("capped", F.lit(False))
    crowded = strided.join(over, keys)
    lines = crowded.groupBy(*keys, "row").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    line = Window.partitionBy(*keys, "row").orderBy("col")
    placed = crowded.join(starts, [*keys, "row"]).withColumn("_i", F.col("_start") + F.row_number().over(line) - 1)
    # Kept places are floor(k * m / max); the k that can hit place i is ceil(i * max / m).
    k = f"(_i * {max_points} + _m - 1) div _m"
    kept = placed.where(f"{k} < {max_points} AND ({k}) * _m div {max_points} = _i")
    rest = strided.join(over, keys, "left_anti").withColumn("capped", F.lit(False))
    return rest.unionByName(kept.withColumn("capped", F.lit(True)).drop("_m", "_start", "_i"))


def proximity_pairs(sample: DataFrame, refs: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every pair once: ``a`` is the earlier vertex in row-major order, ``visit`` the bucket offset order.

    Buckets are as wide as the distance limit. A point goes to the block of BLOCK buckets a side that holds its bucket, and to
    the block beside it only if a bucket next to its own lies there. A block with more than CROWD points is dealt over pairs
    of parts of that size, so that no task holds more than two parts however many points share a place.
    """
    keys = list(keys)
    limit = (cfg.nonlocal_distance_ratio * F.sqrt(F.col("ref_h") * F.col("ref_v"))).alias("limit")
    placed = sample.select(*keys, "row", "col", "x", "y", "z").join(refs.select(*keys, limit), keys).where("limit > 0")
    placed = placed.withColumns({f"b{a}": F.floor(F.col(a) / F.col("limit")) for a in "xyz"})
    for a in "xyz":
        low, high = (F.floor((F.col(f"b{a}") + step) / BLOCK) for step in (-1, 1))
        placed = placed.withColumn(f"k{a}", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    block = [*keys, "kx", "ky", "kz"]
    crowded = materialize(placed.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*block, F.ceil(F.col("n") / CROWD).cast("int").alias("parts")))
    dealt = placed.join(crowded, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row", "col"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"first": F.least("part", "other"), "second": F.greatest("part", "other")}).drop("parts", "other")
    own_kinds = ", ".join(f"`{k}` {sample.schema[k].dataType.simpleString()}" for k in keys)
    uv = cfg.nonlocal_uv_exclusion

    def pairs(group: pa.Table) -> pa.Table:
        column = {n: group[n].to_numpy() for n in group.column_names if n not in keys}
        made = near_pairs(column, uv)
        first = [group[k].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(made["distance"]), np.int64))) for k in keys]
        return pa.Table.from_arrays([*first, *map(pa.array, made.values())], [*keys, *made])

    schema = f"{own_kinds}, a_row int, a_col int, b_row int, b_col int, distance double, visit int"
    group = [*block, "first", "second"]
    return spread(dealt, *group).groupBy(*group).applyInArrow(pairs, schema)


def tile_pairs(tiles: DataFrame, refs: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS, size: int = TILE) -> DataFrame:
    """The pairs of ``proximity_pairs`` among all usable points of packed tiles.

    The points of a tile that go to one block travel as one row, so blocks are met by joining few rows, and the parts of a crowded
    block are dealt as there.
    """
    keys = list(keys)
    spark = tiles.sparkSession
    small_batches(spark)
    limit = (cfg.nonlocal_distance_ratio * F.sqrt(F.col("ref_h") * F.col("ref_v"))).alias("limit")
    limited = tiles.join(refs.select(*keys, limit).where("limit > 0"), keys)
    own_kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys)
    names, uv = ["kx", "ky", "kz"], cfg.nonlocal_uv_exclusion
    columns = [*keys, "limit", *names, "n", "points"]

    def rows(batch: pa.RecordBatch, at: int, made: list[tuple], after: Sequence[str] = ()) -> pa.RecordBatch:
        held = [batch[k].take(pa.array(np.full(len(made), at))) for k in (*keys, "limit")]
        big = [pa.array([m[i] for m in made], pa.int64()) for i in range(4)]
        more = [pa.array([m[5 + i] for m in made], pa.int32()) for i in range(len(after))]
        return pa.RecordBatch.from_arrays([*held, *big, pa.array([m[4] for m in made], pa.binary()), *more], [*columns, *after])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = K.usable_points(row, size)
                made = [(*k, len(p), p.tobytes()) for k, p in blocks(found, row["limit"])]
                if made:
                    yield rows(batch, at, made)

    schema = f"{own_kinds}, limit double, kx bigint, ky bigint, kz bigint, n bigint, points binary"
    pieces = materialize(limited.mapInArrow(cut, schema))
    block = [*keys, *names]
    counted = pieces.groupBy(*block).agg(F.sum("n").alias("m"))
    crowded = materialize(counted.where(F.col("m") > CROWD).select(*block, F.ceil(F.col("m") / CROWD).cast("int").alias("parts")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found, parts = np.frombuffer(row["points"], K.POINT), row["parts"]
                part = part_of(found, parts)
                for mine in range(parts):
                    own = found[part == mine]
                    place = (row["kx"], row["ky"], row["kz"], len(own), own.tobytes())
                    made = [(*place, min(mine, other), max(mine, other), parts) for other in range(parts)]
                    if len(own):
                        yield rows(batch, at, made, ("first", "second", "parts"))

    alone = pieces.join(crowded, block, "left_anti").select(*columns, *[F.lit(n).alias(c) for c, n in (("first", 0), ("second", 0), ("parts", 1))])
    dealt = alone.unionByName(pieces.join(crowded, block).mapInArrow(deal, f"{schema}, first int, second int, parts int"))
    group = [*block, "first", "second"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, first = [], None, None
        for batch in batches:
            places = list(zip(*(batch[c].to_pylist() for c in (*group, "limit", "parts"))))
            for at, (now, blob) in enumerate(zip(places, batch["points"])):
                if now != place:
                    if held:
                        yield from met(place, first, held)
                    held, place, first = [], now, [batch[k].slice(at, 1) for k in keys]
                held.append(np.frombuffer(blob.as_py(), K.POINT))
        if held:
            yield from met(place, first, held)

    def met(place: tuple, first: list[pa.Array], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(held)
        *k, low, high, limit, parts = place[len(keys) :]
        at = {n: found[n] for n in K.POINT.names}
        at.update({f"b{a}": b for a, b in zip("xyz", buckets(found, limit))})
        at.update({f"k{a}": np.full(len(found), v) for a, v in zip("xyz", k)})
        at.update({"limit": np.full(len(found), limit), "first": np.full(len(found), low), "second": np.full(len(found), high), "part": part_of(found, parts)})
        inside = np.logical_and.reduce([at[f"b{a}"] // BLOCK == v for a, v in zip("xyz", k)])
        made = near_pairs(at, uv) if len(found) > 1 and inside.any() else {"distance": ()}
        if len(made["distance"]):
            own = [c.take(pa.array(np.zeros(len(made["distance"]), np.int64))) for c in first]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made.values())], [*keys, *made])

    pair = f"{own_kinds}, a_row int, a_col int, b_row int, b_col int, distance double, visit int"
    return spread(dealt, *group).sortWithinPartitions(*group).mapInArrow(meet, pair)


def buckets(found: np.ndarray, limit: float) -> list[np.ndarray]:
    """Bucket of each point along x, y and z."""
    far = float(1 << 62)
    return [np.clip(np.floor(found[a] / limit), -far, far).astype(np.int64) for a in "xyz"]


def blocks(found: np.ndarray, limit: float) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Blocks with the points that go to each: those inside, and those whose bucket touches one of its buckets."""
    index, ks = np.arange(len(found)), []
    for b in buckets(found, limit):
        low, high = (b - 1) // BLOCK, (b + 1) // BLOCK
        beside = low[index] != high[index]
        ks = [np.concatenate([k, k[beside]]) for k in ks] + [np.concatenate([low[index], high[index[beside]]])]
        index = np.concatenate([index, index[beside]])
    order = np.lexsort(ks)
    ks, index = [k[order] for k in ks], index[order]
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in ks])
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(index)]
    return [(tuple(int(k[lo]) for k in ks), found[index[lo:hi]]) for lo, hi in zip(edges, edges[1:]) if hi > lo]


def part_of(found: np.ndarray, parts: int) -> np.ndarray:
    """Part of a crowded block for each point, by its grid place."""
    mixed = (found["row"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (found["col"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


#: Buckets of a block along each side, points of a part of a crowded block, and candidates that are compared at once.
BLOCK, CROWD, AT_ONCE = 256, 100_000, 2_000_000
#: Buckets to look at from one's own, as (dx, dy, dz from, dz to): one of each pair of opposite ones, and the own one.
LOOKS = ((0, 0, 0, 1), (0, 1, -1, 1), (1, -1, -1, 1), (1, 0, -1, 1), (1, 1, -1, 1))


def near_pairs(at: dict[str, np.ndarray], uv: int) -> dict[str, np.ndarray]:
    """Pairs of one group of ``proximity_pairs``: the point with the smaller bucket belongs to the block, one lies in
    the first and one in the second part, they are more than ``uv`` lines apart and nearer than the limit."""
    lows = [int(at[f"b{a}"].min()) - 1 for a in "xyz"]
    spans = [int(at[f"b{a}"].max()) - low + 2 for a, low in zip("xyz", lows)]
    bucket = [at[f"b{a}"] - low for a, low in zip("xyz", lows)]
    key = (bucket[0] * spans[1] + bucket[1]) * spans[2] + bucket[2]
    order = np.argsort(key, kind="stable")
    at = {n: v[order] for n, v in at.items()}
    bucket, key = [b[order] for b in bucket], key[order]
    mine = np.flatnonzero(np.logical_and.reduce([at[f"b{a}"] // BLOCK == at[f"k{a}"] for a in "xyz"]))
    alone = at["first"][0] == at["second"][0]
    kept: list[tuple[np.ndarray, ...]] = []
    for dx, dy, below, above in LOOKS:
        middle = key[mine] + (dx * spans[1] + dy) * spans[2]
        start, end = np.searchsorted(key, middle + below), np.searchsorted(key, middle + above, "right")
        upto = np.concatenate([[0], np.cumsum(end - start)])
        if not upto[-1]:
            continue
        lo = 0
        while lo < len(mine):
            hi = max(int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1, lo + 1)
            count = end[lo:hi] - start[lo:hi]
            p = np.repeat(mine[lo:hi], count)
            q = np.arange(count.sum()) - np.repeat(upto[lo:hi] - upto[lo], count) + np.repeat(start[lo:hi], count)
            lo = hi
            p_row, p_col, q_row, q_col = at["row"][p], at["col"][p], at["row"][q], at["col"][q]
            first = (p_row < q_row) | ((p_row == q_row) & (p_col < q_col))
            good = np.maximum(np.abs(p_row - q_row), np.abs(p_col - q_col)) > uv
            good &= first | (key[p] != key[q])
            if not alone:
                good &= at["part"][p] != at["part"][q]
            p, q, first = p[good], q[good], first[good]
            gap = np.zeros(len(p))
            for a in "xyz":
                gap = gap + (at[a][q] - at[a][p]) * (at[a][q] - at[a][p])
            distance = np.sqrt(gap)
            good = distance < at["limit"][p]
            p, q, first, distance = p[good], q[good], first[good], distance[good]
            shift = 9 * dx + 3 * dy + (bucket[2][q] - bucket[2][p])
            a, b = np.where(first, p, q), np.where(first, q, p)
            kept.append((at["row"][a], at["col"][a], at["row"][b], at["col"][b], distance, np.where(first, 13 - shift, 13 + shift)))
    kinds = {"a_row": np.int32, "a_col": np.int32, "b_row": np.int32, "b_col": np.int32, "distance": np.float64, "visit": np.int32}
    return {n: np.concatenate(v).astype(k) if kept else np.zeros(0, k) for (n, k), v in zip(kinds.items(), zip(*kept) if kept else [()] * 6)}


def listed_pairs(pairs: DataFrame, max_pairs: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("b_row", "b_col", "visit", "a_row", "a_col")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked if max_pairs is None else ranked.where(F.col("rank") <= max_pairs)


def pair_totals(pairs: DataFrame, max_pairs: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    counted = pairs.groupBy(*keys).agg(F.count("*").alias("pair_count"))
    truncated = F.lit(False) if max_pairs is None else F.col("pair_count") > max_pairs
    return counted.withColumn("truncated", truncated)


def pair_vertices(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    ends = F.array(
        F.struct(F.col("a_row").alias("row"), F.col("a_col").alias("col")),
        F.struct(F.col("b_row").alias("row"), F.col("b_col").alias("col")),
    )
    return pairs.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.row", "_e.col").distinct()

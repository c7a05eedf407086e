"""The review measured tile by tile: one shuffle packs vertices into tiles, Arrow passes over tiles do the rest.

A packed tile holds at most (TILE + halo)^2 vertices, so its arrays are bounded and a package of any size is spread over as many
rows. One pass measures a tile (``operators/tile_kernel``) and writes what the tables of the review read: counters, runs with
their roots inside the tile, links over tile borders, candidates of the example lists, cell planes and the values of the
distributions. Spark joins these small rows; no vertex passes a window or a second shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import tile_kernel as K
from latticeqc.operators.components import star_components
from latticeqc.operators.geometry import EXAMPLES, METRICS
from latticeqc.operators.tiles import TILE, TILE_COL, TILE_ROW, tile
from latticeqc.session import materialize, merged, small_batches, spread

PLACE = ("tile_row int, tile_col int, top int, left int, height int, width int")
#: Columns of the measures behind each metric; edge lengths are NaN where an edge is not usable.
VALUES = {m: [{"h_len_ok": "h_len", "v_len_ok": "v_len"}.get(c, c) for c in ([cols] if isinstance(cols, str) else cols)] for m, cols in METRICS.items()}
ENTRIES = [(cue, tag, flag, value, largest) for cue, listed in EXAMPLES.items() for flag, value, largest, tag in listed]
#: Leading bits of a value that make its bin: sign, exponent and six bits of the fraction.
BIN_BITS = 18


#: Tiles whose measures a worker holds at once.
TILES_AT_ONCE = 16


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def surface_tiles(surf: DataFrame, keys: Sequence[str], size: int = TILE) -> DataFrame:
    """``keys, tile_row, tile_col``, extent, coordinate planes and state bits of every tile with its halo, as binary columns."""
    keys = list(keys)
    small_batches(surf.sparkSession)
    slim = surf.select(*keys, "row", "col", *[F.col(a).cast("double") for a in "xyz"], F.coalesce("valid", F.lit(False)).alias("valid"), F.col("explicit_mask").isNotNull().alias("masked"))
    dealt = spread(tile(slim, keys, K.BEFORE, K.AFTER, size), *keys, TILE_ROW, TILE_COL)
    names = [*keys, "tile_row", "tile_col", *PLANES]

    def pack(group: pa.Table) -> pa.Table:
        at = {c: group[c].to_numpy() for c in ("row", "col", "x", "y", "z", "valid", "masked")}
        first = [group[k].slice(0, 1).combine_chunks() for k in keys]
        place = [group[TILE_ROW][0].as_py(), group[TILE_COL][0].as_py()]
        return pa.Table.from_arrays([*first, *[pa.array([n], pa.int32()) for n in place], *plane_columns([planes(at, place, size)])], names)

    return materialize(dealt.groupBy(*keys, TILE_ROW, TILE_COL).applyInArrow(pack, f"{_ddl(surf, keys)}, {TILE_SCHEMA}"))


PLANES = ("top", "left", "height", "width", "x", "y", "z", "state", "rest")
TILE_SCHEMA = f"{PLACE}, x binary, y binary, z binary, state binary, rest binary"


def planes(at: Mapping[str, np.ndarray], place: Sequence[int], size: int = TILE) -> list:
    """Values of PLANES of the tile at ``place`` from the values of its vertices.

    Of vertices at one grid place the last stays in the planes; ``rest`` keeps the usable others of the tile's own window as POINTs.
    """
    row, col = at["row"], at["col"]
    top, left = int(row.min()), int(col.min())
    shape = int(row.max()) - top + 1, int(col.max()) - left + 1
    spot = (row - top).astype(np.int64) * shape[1] + (col - left)
    made = []
    for name in "xyz":
        plane = np.full(shape[0] * shape[1], np.nan)
        plane[spot] = at[name]
        made.append(plane.tobytes())
    valid = at["valid"].astype(np.uint8)
    state = np.zeros(shape[0] * shape[1], np.uint8)
    state[spot] = K.EXISTS + K.VALID * valid + K.MASKED * at["masked"].astype(np.uint8)
    rest = b""
    if len(row) > np.count_nonzero(state):
        last = np.full(len(state), -1)
        last[spot] = np.arange(len(row))
        other = (last[spot] != np.arange(len(row))) & (valid > 0) & (row // size == place[0]) & (col // size == place[1])
        other &= np.isfinite(at["x"]) & np.isfinite(at["y"]) & np.isfinite(at["z"])
        rest = K.points(*(at[n][other] for n in ("row", "col", "x", "y", "z"))).tobytes()
    return [top, left, *shape, *made, state.tobytes(), rest]


def plane_columns(rows: list[list]) -> list[pa.Array]:
    return [pa.array(values, pa.int32() if n in ("top", "left", "height", "width") else pa.binary()) for n, values in zip(PLANES, zip(*rows))]


def packed_vertices(df: DataFrame, keys: Sequence[str], numbers: Sequence[str], flags: Sequence[str], size: int = TILE) -> DataFrame:
    """``keys, tile_row, tile_col`` and one binary column each for ``row, col``, ``numbers`` and ``flags`` of the tile's vertices, halo included."""
    keys = list(keys)
    small_batches(df.sparkSession)
    slim = df.select(*keys, "row", "col", *[F.col(c).cast("double") for c in numbers], *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    dealt = spread(tile(slim, keys, K.BEFORE, K.AFTER, size), *keys, TILE_ROW, TILE_COL)
    kinds = vertex_kinds(numbers, flags)

    def pack(group: pa.Table) -> pa.Table:
        first = [group[k].slice(0, 1).combine_chunks() for k in (*keys, TILE_ROW, TILE_COL)]
        blobs = [pa.array([group[c].to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in kinds.items()]
        return pa.Table.from_arrays([*first[:-2], *[n.cast(pa.int32()) for n in first[-2:]], *blobs], [*keys, "tile_row", "tile_col", *kinds])

    schema = f"{_ddl(df, keys)}, tile_row int, tile_col int, {', '.join(f'{c} binary' for c in kinds)}"
    return materialize(dealt.groupBy(*keys, TILE_ROW, TILE_COL).applyInArrow(pack, schema))


def vertex_kinds(numbers: Sequence[str], flags: Sequence[str]) -> dict[str, type]:
    return {"row": np.int32, "col": np.int32, **{c: np.float64 for c in numbers}, **{c: np.bool_ for c in flags}}


def _bins(values: np.ndarray) -> np.ndarray:
    """Order-preserving integers of doubles, cut to their leading bits."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> (64 - BIN_BITS)


def _struct_lists(columns: Mapping[str, tuple[pa.DataType, list[np.ndarray]]]) -> pa.Array:
    """One list of structs per tile from each column's array per tile."""
    parts = [len(a) for a in next(iter(columns.values()))[1]]
    offsets = pa.array(np.concatenate([[0], np.cumsum(parts)]).astype(np.int32))
    fields = [pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind) for kind, arrays in columns.values()]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, list(columns)))


def _binned(values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``metric, bin, n`` of the values of one tile, one array of values per metric."""
    found = [np.unique(_bins(v), return_counts=True) for v in values]
    metric = np.repeat(np.arange(len(values)), [len(b) for b, _ in found])
    return [metric, np.concatenate([b for b, _ in found]), np.concatenate([n for _, n in found])]


def _passed(df: DataFrame, keys: Sequence[str], schema: str, measure: Callable[[list[dict]], dict[str, pa.Array]], columns: Sequence[str]) -> DataFrame:
    """``measure`` of the tiles of each Arrow batch, a few at a time; key columns and ``columns`` are passed on."""
    names = [*keys, *columns]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILES_AT_ONCE):
                batch = whole.slice(at, TILES_AT_ONCE)
                made = measure(batch.to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *made.values()], [*names, *made])

    return df.mapInArrow(run, ", ".join([_ddl(df, names), schema]))


PAIRS = "array<struct<metric:bigint,bin:bigint,n:bigint>>"


def edge_values(tiles: DataFrame, keys: Sequence[str], size: int = TILE) -> DataFrame:
    """Usable edge lengths of each tile's window: bins and values, metric 0 along rows, 1 along columns."""

    def measure(rows: list[dict]) -> dict[str, pa.Array]:
        binned, planes, counts = [], [], []
        for row in rows:
            t = K.unpacked(row, size)
            values = [v[t.own] for v in K.edge_lengths(t).values()]
            values = [v[v > 1e-12] for v in values]
            binned.append(_binned(values))
            planes.append(np.concatenate(values).tobytes())
            counts.append([len(v) for v in values])
        return _value_columns(binned, planes, counts)

    return materialize(_passed(tiles, keys, f"bins {PAIRS}, planes binary, sizes array<bigint>", measure, ()))


def _value_columns(binned: list, planes: list[bytes], counts: list) -> dict[str, pa.Array]:
    columns = {n: (pa.int64(), [b[i] for b in binned]) for i, n in enumerate(("metric", "bin", "n"))}
    return {"bins": _struct_lists(columns), "planes": pa.array(planes, pa.binary()), "sizes": pa.array(counts, pa.list_(pa.int64()))}


def value_quantiles(measured: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys, metric, n, q``: exact quantiles, linear between order statistics, of the values of all tiles.

    The bins of all tiles are summed and tell in which bin each wanted order statistic lies and at which place; one more
    pass sends the different values of those bins only (a bin spans a 64th of an octave).
    """
    keys = list(keys)
    group = [*keys, "metric"]
    summed = materialize(measured.select(*keys, F.explode("bins").alias("b")).select(*keys, "b.*").groupBy(*group, "bin").agg(F.sum("n").alias("c")))
    whole = Window.partitionBy(*group)
    below = F.sum("c").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    counted = summed.withColumns({"n": F.sum("c").over(whole), "below": below})
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in ((0, F.floor(at)), (1, F.ceil(at))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (rank.cast("bigint") - F.col("below")).alias("rank")))
    hit = F.filter(F.array(*wanted), lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("c")))
    targets = materialize(counted.withColumn("ranks", hit).where(F.size("ranks") > 0).select(*group, "bin", "n", "ranks"))
    # At most two bins for each metric and probability.
    asked = targets.groupBy(*keys).agg(F.collect_list(F.struct("metric", "bin")).alias("asked"))
    joined = measured.select(*keys, "planes", "sizes").join(asked, keys)

    def pick(rows: list[dict]) -> dict[str, pa.Array]:
        found: list[list[np.ndarray]] = [[], [], [], []]
        for row in rows:
            values = np.frombuffer(row["planes"], np.float64)
            edges = np.concatenate([[0], np.cumsum(row["sizes"])])
            bins = _bins(values)
            ask: dict[int, list[int]] = {}
            for a in row["asked"]:
                ask.setdefault(a["metric"], []).append(a["bin"])
            made = [[], [], [], []]
            for metric, wanted_bins in ask.items():
                part = slice(edges[metric], edges[metric + 1])
                inside = np.isin(bins[part], wanted_bins)
                value, n = np.unique(values[part][inside] + 0.0, return_counts=True)
                for held, new in zip(made, (np.full(len(value), metric), _bins(value), value, n)):
                    held.append(new)
            for held, new in zip(found, made):
                held.append(np.concatenate(new) if new else np.zeros(0))
        kinds = {"metric": pa.int64(), "bin": pa.int64(), "value": pa.float64(), "n": pa.int64()}
        return {"found": _struct_lists({n: (k, [a.astype(k.to_pandas_dtype()) for a in f]) for (n, k), f in zip(kinds.items(), found)})}

    picked = _passed(joined, keys, "found array<struct<metric:bigint,bin:bigint,value:double,n:bigint>>", pick, ())
    values = picked.select(*keys, F.explode("found").alias("f")).select(*keys, "f.*").groupBy(*group, "bin", "value").agg(F.sum("n").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = values.withColumn("upto", upto).join(merged(targets), [*group, "bin"])
    mine = F.filter("ranks", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("c")))
    flat = placed.select(*group, "n", "value", F.explode(mine).alias("w"))
    ends = flat.groupBy(*group, "w.i").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("w.side") == s, F.col("value"))).alias(f"v{s}") for s in (0, 1)])
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("n") - 1)
    between = (F.ceil(at) - at) * F.col("v0") + (at - F.floor(at)) * F.col("v1")
    valued = ends.withColumn("v", F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(between))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return valued.groupBy(*group).agg(F.max("n").cast("bigint").alias("n"), listed.alias("q"))


RUN = "struct<kind:string,row:bigint,lo:bigint,hi:bigint,root:bigint>"
LINK = "struct<kind:string,root:bigint,row:bigint,col:bigint>"
FOUND = "struct<entry:bigint,row:bigint,col:bigint,value:double>"


def review_tiles(tiles: DataFrame, refs: DataFrame, cfg: ReviewConfig, keys: Sequence[str], keep: int = 50, size: int = TILE, values: bool = True) -> DataFrame:
    """``reviewed_tiles``, written."""
    return materialize(reviewed_tiles(tiles, refs, cfg, keys, keep, size, values))


def reviewed_tiles(tiles: DataFrame, refs: DataFrame, cfg: ReviewConfig, keys: Sequence[str], keep: int = 50, size: int = TILE, values: bool = True) -> DataFrame:
    """One row per tile with everything the review reads; ``keep`` bounds the places of an example list.

    Without ``values`` the rows lack the columns of the distributions and example lists, most of their bytes.
    """
    keys = list(keys)
    names = ("obs_h", "obs_v", "ref_h", "ref_v")
    joined = tiles.join(refs.select(*keys, *names), keys, "left")
    entries = [(flag, value, largest) for _, _, flag, value, largest in ENTRIES]
    metrics = list(VALUES.values())

    def measure(rows: list[dict]) -> dict[str, pa.Array]:
        out: dict[str, list] = {n: [] for n in ("counts", "area", "cells", "score", "planes", "sizes", "binned")}
        lists: dict[str, list[list]] = {"runs": [[] for _ in range(5)], "links": [[] for _ in range(4)], "portals": [[] for _ in range(4)], "found": [[] for _ in range(4)]}
        with np.errstate(all="ignore"):
            for row in rows:
                t = K.unpacked(row, size)
                m = K.measured(t, {n: row[n] for n in names}, cfg)
                counts, area = K.counters(t, m)
                out["counts"].append(counts)
                out["area"].append(area)
                out["cells"].append((m["cell"] + 2 * m["cell_valid"] + 4 * m["local_cue"])[t.own].astype(np.uint8).tobytes())
                out["score"].append(np.ascontiguousarray(m["local_score"][t.own]).tobytes())
                if values:
                    found = [np.concatenate([m[c][t.own].ravel() for c in columns]) for columns in metrics]
                    found = [v[np.isfinite(v)] for v in found]
                    out["binned"].append(_binned(found))
                    out["planes"].append(np.concatenate(found).tobytes())
                    out["sizes"].append([len(v) for v in found])
                made = {n: [] for n in lists}
                for kind, mask in K.masks(t, m).items():
                    runs, links, portals = K.components(t, mask, K.REACH[kind])
                    if kind in ("vertex", "cell"):
                        # Only the number of components is asked for, so the first run of each is enough.
                        first = runs[3] == runs[0] * (1 << 31) + runs[1]
                        runs = [a[first] for a in runs]
                    for n, arrays in (("runs", runs), ("links", links), ("portals", [portals[2], portals[0], portals[1]])):
                        made[n].append([np.full(len(arrays[0]), kind, dtype=object), *arrays])
                for e, found in enumerate(K.best_candidates(t, m, entries, keep) if values else ()):
                    made["found"].append([np.full(len(found[0]), e), *found])
                for n, parts in made.items():
                    if n == "found" and not values:
                        continue
                    for held, new in zip(lists[n], zip(*parts)):
                        held.append(np.concatenate(new))
        big, text, real = pa.int64(), pa.string(), pa.float64()
        place = {"kind": text, "root": big, "row": big, "col": big}
        kinds = {"runs": {"kind": text, "row": big, "lo": big, "hi": big, "root": big}, "links": place, "portals": place, "found": {"entry": big, "row": big, "col": big, "value": real}}
        nested = {n: _struct_lists({c: (k, a) for (c, k), a in zip(columns.items(), lists[n])}) for n, columns in kinds.items() if values or n != "found"}
        own = {"counts": pa.array(out["counts"], pa.list_(big)), "area": pa.array(out["area"], pa.float64()), "cells": pa.array(out["cells"], pa.binary()), "score": pa.array(out["score"], pa.binary())}
        return {**own, **(_value_columns(out["binned"], out["planes"], out["sizes"]) if values else {}), **nested}

    schema = f"counts array<bigint>, area double, cells binary, score binary, {f'bins {PAIRS}, planes binary, sizes array<bigint>, ' if values else ''}runs array<{RUN}>, links array<{LINK}>, portals array<{LINK}>"
    if values:
        schema += f", found array<{FOUND}>"
    return _passed(joined, keys, schema, measure, ("tile_row", "tile_col", "top", "left", "height", "width"))


def tile_counters(reviewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """COUNTERS and the surface area per package."""
    sums = [F.sum(F.col("counts")[i]).cast("bigint").alias(n) for i, n in enumerate(K.COUNTERS)]
    return reviewed.groupBy(*keys).agg(*sums, F.sum("area").alias("surface_area"), F.max(F.col("top") + F.col("height")).cast("bigint").alias("height"), F.max(F.col("left") + F.col("width")).cast("bigint").alias("width"))


def tile_components(reviewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, kind, row, lo, hi, label``: runs of gaps and steps, first runs of the others, with the first run of their component."""
    keys = [*keys, "kind"]
    flat = lambda c: reviewed.select(*keys[:-1], F.explode(c).alias("e")).select(*keys[:-1], "e.*")
    beyond = flat("links").withColumnRenamed("root", "u")
    edges = beyond.join(merged(flat("portals").withColumnRenamed("root", "v")), [*keys, "row", "col"]).select(*keys, "u", "v").distinct()
    stars = star_components(edges, keys).select(*keys, F.col("node").alias("root"), "label")
    joined = flat("runs").join(stars, [*keys, "root"], "left")
    return materialize(joined.select(*keys, "row", "lo", "hi", F.coalesce("label", "root").alias("label")))


def component_count(parts: DataFrame, keys: Sequence[str], kind: str, name: str) -> DataFrame:
    """Components of a kind: the runs that are the first of their component."""
    first: Column = (F.col("kind") == kind) & (F.col("label") == F.col("row") * (1 << 31) + F.col("lo"))
    return parts.groupBy(*keys).agg(F.count_if(first).alias(name))


MARK = "struct<row:int,lo:int,hi:int,band:boolean>"


def tile_marks(near: DataFrame, bands: DataFrame, keys: Sequence[str], size: int = TILE) -> DataFrame:
    """``keys, tile_row, tile_col, marks``: the proximity cells and the runs of bands of each tile; a run lies in one tile."""
    keys = list(keys)
    runs = near.select(*keys, "row", F.col("col").alias("lo"), F.col("col").alias("hi"), F.lit(False).alias("band"))
    runs = runs.unionByName(bands.select(*keys, "row", "lo", "hi", F.lit(True).alias("band")))
    mark = F.struct("row", "lo", "hi", "band").cast(MARK).alias("m")
    placed = runs.select(*keys, F.expr(f"CAST(row div {size} AS INT)").alias("tile_row"), F.expr(f"CAST(lo div {size} AS INT)").alias("tile_col"), mark)
    return placed.groupBy(*keys, "tile_row", "tile_col").agg(F.collect_list("m").alias("marks"))


def tile_cells(reviewed: DataFrame, keys: Sequence[str], size: int = TILE, marks: DataFrame | None = None, cued: bool = False) -> DataFrame:
    """``keys, row, col, cell_valid, local_cue, local_score, near, band`` of every cell, or with ``cued`` of the cells that any cue names.

    ``marks`` (see ``tile_marks``) tell ``near`` and ``band``; without them both are false.
    """
    keys = list(keys)
    places = ["tile_row", "tile_col", "top", "left", "height", "width"]
    small_batches(reviewed.sparkSession)
    slim = reviewed.select(*keys, *places, "cells", "score")
    none = F.lit(None).cast(f"array<{MARK}>").alias("marks")
    joined = slim.select("*", none) if marks is None else slim.join(merged(marks), [*keys, "tile_row", "tile_col"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch["marks"].offsets.to_numpy()
            held = [batch["marks"].values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for at, row in enumerate(batch.select(places + ["cells", "score"]).to_pylist()):
                first = [max(row["tile_row"] * size, row["top"]), max(row["tile_col"] * size, row["left"])]
                end = [min((row["tile_row"] + 1) * size, row["top"] + row["height"]), min((row["tile_col"] + 1) * size, row["left"] + row["width"])]
                wide = end[1] - first[1]
                bits = np.frombuffer(row["cells"], np.uint8)
                near, band = np.zeros(len(bits), bool), np.zeros(len(bits), bool)
                if batch["marks"][at].is_valid:
                    r, lo, hi, is_band = (a[offsets[at] : offsets[at + 1]] for a in held)
                    n = hi - lo + 1
                    spot = np.repeat((r - first[0]).astype(np.int64) * wide + lo - first[1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    of_band = np.repeat(is_band.astype(bool), n)
                    near[spot[~of_band]], band[spot[of_band]] = True, True
                there = bits & 1 > 0
                if cued:
                    there &= (bits & 4 > 0) | (near & (bits & 2 > 0)) | band
                there = np.flatnonzero(there)
                bits = bits[there]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[k].take(pa.array(np.full(len(there), at))) for k in keys],
                        pa.array((there // wide + first[0]).astype(np.int32)), pa.array((there % wide + first[1]).astype(np.int32)),
                        pa.array(bits & 2 > 0), pa.array(bits & 4 > 0), pa.array(np.frombuffer(row["score"], np.float64)[there], mask=bits & 2 == 0),
                        pa.array(near[there]), pa.array(band[there]),
                    ],
                    [*keys, "row", "col", "cell_valid", "local_cue", "local_score", "near", "band"],
                )

    schema = f"{_ddl(reviewed, keys)}, row int, col int, cell_valid boolean, local_cue boolean, local_score double, near boolean, band boolean"
    return joined.mapInArrow(run, schema)


def tile_candidates(reviewed: DataFrame, keys: Sequence[str], cues: Sequence[str]) -> DataFrame:
    """``keys, cue, tag, row, col, value, largest`` of the places that can be in the example lists of the cues."""
    names = F.array(*[F.struct(F.lit(c).alias("cue"), F.lit(t).alias("tag"), F.lit(big).alias("largest")) for c, t, _, _, big in ENTRIES])
    rows = reviewed.select(*keys, F.explode("found").alias("f")).select(*keys, names[F.col("f.entry").cast("int")].alias("e"), F.col("f.row").alias("row"), F.col("f.col").alias("col"), "f.value")
    return rows.where(F.col("e.cue").isin(*cues)).select(*keys, "e.cue", "e.tag", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", "e.largest")

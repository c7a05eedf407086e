"""Controlled normal-offset perturbation of surfaces, and what the review finds of it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.sqltext import stage
from latticeqc.operators import diff, grid
from latticeqc.operators import tile_tables as T
from latticeqc.operators.tiles import OWN
from latticeqc.plans.geometry_report import GeometryReport, cell_shapes, geometry_report
from latticeqc.session import materialize, merged, small_batches

KEYS = ("package_id",)
CASE = ("package_id", "offset_voxels", "width_cells")


def averaged_normals(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Vertices with ``vnx, vny, vnz`` and ``movable`` (valid, with a normal)."""
    keys = list(keys)
    frame = grid.normal_columns(grid.cell_normal_columns(grid.corners(surf, keys, after=2, before=1)), keys)
    return frame.where(OWN).selectExpr(
        *keys, "row", "col", "x", "y", "z", "valid", "vnx", "vny", "vnz", "valid AND vn_ok AS movable"
    )


def choose_seam(normals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, orientation, seam, support``: the grid line in the middle half with most supported cells.

    Ties prefer vertical lines, then the lower index.  Surfaces below 4 x 4 vertices or with fewer than
    four supported cells on their best line have no seam.
    """
    keys = list(keys)
    sizes = materialize(normals.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")))
    cells = materialize(grid.quad_cells(normals, "movable", keys).where("cell_valid").select(*keys, "row", "col"))
    lines = cells.groupBy(*keys, (F.col("col") + 1).alias("seam")).agg(F.count("*").alias("support")).withColumn("orientation", F.lit("vertical"))
    flat = cells.groupBy(*keys, (F.col("row") + 1).alias("seam")).agg(F.count("*").alias("support")).withColumn("orientation", F.lit("horizontal"))
    size = F.when(F.col("orientation") == "vertical", F.col("width")).otherwise(F.col("height"))
    ranked = lines.unionByName(flat).join(sizes.where("height >= 4 AND width >= 4"), keys).withColumn("n", size)
    central = ranked.where("seam >= greatest(1, n div 4) AND seam < least(n - 1, 3 * n div 4 + 1)")
    best = F.max(F.struct("support", "orientation", (-F.col("seam")).alias("back")))
    return (
        central.groupBy(*keys).agg(best.alias("b")).where("b.support >= 4")
        .select(*keys, F.col("b.orientation").alias("orientation"), (-F.col("b.back")).cast("int").alias("seam"), F.col("b.support").alias("support"))
    )


def transition(position: str, seam: str, width: str) -> str:
    """Share of the offset at a position: a step for width 1, else a smooth ramp centred on the seam."""
    t = f"least(greatest(({position} - ({seam} - {width} / 2D)) / CAST({width} AS DOUBLE), 0D), 1D)"
    return f"CASE WHEN {width} = 1 THEN CASE WHEN {position} >= {seam} THEN 1D ELSE 0D END ELSE {t} * {t} * (3D - 2D * {t}) END"


def case_list(offsets: Sequence[float], widths: Sequence[int]) -> list[tuple[float, int]]:
    """The null case first, then every offset with every width."""
    return [(0.0, int(widths[0]))] + [(float(o), int(w)) for o in offsets for w in widths]


def ladder(offsets: Sequence[float], widths: Sequence[int]) -> Column:
    """All cases as one array column."""
    return F.array(*[F.struct(F.lit(o).alias("offset_voxels"), F.lit(w).alias("width_cells")) for o, w in case_list(offsets, widths)])


def offset_ladder(normals: DataFrame, seams: DataFrame, offsets: Sequence[float], widths: Sequence[int]) -> DataFrame:
    """Every vertex in every case, moved along its normal; the case is part of the key from here on."""
    cased = normals.join(seams, "package_id").withColumn("_c", F.explode(ladder(offsets, widths)))
    flat = cased.select(*normals.columns, "orientation", "seam", "_c.*")
    position = "CASE WHEN orientation = 'vertical' THEN col ELSE row END"
    placed = stage(stage(flat, {"position": position}), {"share": transition("position", "seam", "width_cells")})
    moved = {
        a: f"CASE WHEN offset_voxels > 0 AND movable THEN CAST(CAST({a} + offset_voxels * share * vn{a} AS FLOAT) AS DOUBLE) ELSE {a} END"
        for a in "xyz"
    }
    return placed.selectExpr(
        *CASE, "row", "col", *[f"{text} AS {a}" for a, text in moved.items()], "valid", "orientation", "seam",
        "CAST(NULL AS BOOLEAN) AS explicit_mask",
    )


def share_of(position: np.ndarray, seam: int, width: int) -> np.ndarray:
    """The values of ``transition``."""
    if width == 1:
        return np.where(position >= seam, 1.0, 0.0)
    t = np.minimum(np.maximum((position - (seam - width / 2.0)) / float(width), 0.0), 1.0)
    return t * t * (3.0 - 2.0 * t)


def ladder_tiles(normals: DataFrame, seams: DataFrame, offsets: Sequence[float], widths: Sequence[int]) -> DataFrame:
    """The surfaces of ``offset_ladder`` as packed tiles (see ``surface_tiles``): vertices are packed once and moved tile by tile for every case."""
    cases, normal = case_list(offsets, widths), ("vnx", "vny", "vnz")
    numbers, flags = ("x", "y", "z", *normal), ("valid", "movable")
    kinds = T.vertex_kinds(numbers, flags)
    small_batches(normals.sparkSession)
    packed = T.packed_vertices(normals.join(seams.select("package_id"), "package_id"), KEYS, numbers, flags)
    placed = packed.join(seams.select("package_id", "orientation", "seam"), "package_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
                at["masked"] = np.zeros(len(at["row"]), bool)
                position, place = at["col" if row["orientation"] == "vertical" else "row"], [row["tile_row"], row["tile_col"]]
                made = []
                for offset, width in cases:
                    moved = dict(at)
                    if offset > 0:
                        step = offset * share_of(position, row["seam"], width)
                        with np.errstate(all="ignore"):
                            moved.update({a: np.where(at["movable"], (at[a] + step * at[n]).astype(np.float32).astype(np.float64), at[a]) for a, n in zip("xyz", normal)})
                    made.append(T.planes(moved, place))
                own = batch["package_id"].take(pa.array(np.full(len(cases), i)))
                tile = [pa.array([n] * len(cases), pa.int32()) for n in place]
                case = [pa.array([o for o, _ in cases], pa.float64()), pa.array([w for _, w in cases], pa.int32())]
                yield pa.RecordBatch.from_arrays([own, *case, *tile, *T.plane_columns(made)], [*CASE, "tile_row", "tile_col", *T.PLANES])

    package = normals.schema["package_id"].dataType.simpleString()
    return materialize(placed.mapInArrow(run, f"package_id {package}, offset_voxels double, width_cells int, {T.TILE_SCHEMA}"))


def moved_control(surf: DataFrame, cases: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per case: ``vertices``, ``moved_vertices`` (finite, a coordinate off by more than ``tolerance``) and ``validity_mismatches``.

    The null case has to move nothing, and no case may change which vertices are valid.
    """
    at = ["package_id", "row", "col"]
    before = surf.select(*at, *[F.col(a).alias(f"_{a}") for a in "xyz"], F.col("valid").alias("_valid"))
    near = " AND ".join(f"abs({a} - _{a}) <= {tolerance!r}D" for a in "xyz")
    finite = " AND ".join(f"abs({a}) < CAST('Infinity' AS DOUBLE)" for a in "xyz")
    return cases.join(before, at).groupBy(*CASE).agg(
        F.count("*").alias("vertices"), F.count_if(F.expr(f"{finite} AND NOT ({near})")).alias("moved_vertices"),
        F.count_if(~F.col("valid").eqNullSafe(F.col("_valid"))).alias("validity_mismatches"),
    )


def seam_cells(cells: DataFrame, seams: DataFrame, width: int) -> DataFrame:
    """Valid cells whose corners get different shares of the offset."""
    joined = cells.where("cell_valid").join(seams, "package_id")
    at = "CASE WHEN orientation = 'vertical' THEN col ELSE row END"
    near, far = (transition(f"({at} + {i})", "seam", str(width)) for i in (0, 1))
    return joined.where(f"abs(({far}) - ({near})) > 1e-12D").select("package_id", "row", "col")


def evaluation_cells(seam: DataFrame, cells: DataFrame, shapes: DataFrame, radius: int = 1) -> DataFrame:
    """Seam cells and their surroundings, valid cells only."""
    at = ["package_id", "row", "col"]
    return diff.dilate(seam, radius, shapes).join(merged(cells.where("cell_valid")), at, "left_semi")


def incremental(cues: DataFrame, baseline: DataFrame, keys: Sequence[str] = CASE, flags: Sequence[str] = ()) -> DataFrame:
    """Cue cells of a case that the unchanged surface does not have.

    With ``flags`` both sides are cells with several cues, and every cell of ``cues`` stays: ``incremental_<flag>`` says whether it has a cue that
    the unchanged surface lacks there. One join then serves all cues.
    """
    at = ["package_id", "row", "col"]
    if not flags:
        return cues.select(*keys, "row", "col").join(merged(baseline.select(*at)), at, "left_anti")
    before = baseline.select(*at, *[F.col(f).alias(f"_{f}") for f in flags])
    joined = cues.join(merged(before), at, "left").withColumns({f"incremental_{f}": F.col(f) & ~F.coalesce(f"_{f}", F.lit(False)) for f in flags})
    return joined.drop(*[f"_{f}" for f in flags])


def perturbation_benchmark(
    surf: DataFrame, offsets: Sequence[float], widths: Sequence[int], cfg: ReviewConfig = ReviewConfig()
) -> DataFrame:
    """One observation per package and case: seam, evaluation cells, cue cells and detections.

    All cases of all packages are reviewed in one job; detections subtract what the unchanged surface shows.
    """
    surf = materialize(surf.drop("explicit_mask").withColumn("explicit_mask", F.lit(None).cast("boolean")))
    normals = materialize(averaged_normals(surf))
    seams = materialize(choose_seam(normals))
    cells = materialize(grid.quad_cells(surf))
    cases = offset_ladder(normals, seams, offsets, widths)
    moved = ladder_tiles(normals, seams, offsets, widths)
    report: GeometryReport = geometry_report(cases.drop("orientation", "seam"), cfg, CASE, tiles=moved, values=False)
    flags = ("cue", "band", "cue_before")
    base = materialize(geometry_report(surf, cfg, values=False).cued.select("package_id", "row", "col", *flags))
    shapes = cell_shapes(surf)
    bands = None
    for width in widths:
        part = evaluation_cells(seam_cells(cells, seams, width), cells, shapes).withColumn("width_cells", F.lit(width))
        bands = part if bands is None else bands.unionByName(part)
    bands = materialize(bands)
    out = report.summary.select(*CASE).join(seams, "package_id")
    sizes = bands.groupBy("package_id", "width_cells").agg(F.count("*").alias("evaluation_cells"))
    out = out.join(merged(sizes), ["package_id", "width_cells"], "left")
    at = ["package_id", "width_cells", "row", "col"]
    seen = incremental(report.cued.select(*CASE, "row", "col", *flags), base, flags=flags)
    seen = seen.join(merged(bands.select(*at).distinct().withColumn("_near", F.lit(True))), at, "left")
    near = F.coalesce("_near", F.lit(False))
    counts = []
    for flag, name in (("cue", "incremental"), ("band", "incremental_step"), ("cue_before", "incremental_before")):
        fresh = F.col(f"incremental_{flag}")
        counts += [F.count_if(fresh).alias(f"{name}_cells"), F.count_if(fresh & near).alias(f"{name}_localized")]
    counts.append(F.count_if(F.col("cue") & near).alias("localized_cue_cells"))
    out = out.join(merged(seen.groupBy(*CASE).agg(*counts)), list(CASE), "left")
    counters = [c for c in out.columns if c.endswith(("_cells", "_localized")) and c not in CASE]
    return out.fillna(0, subset=counters).withColumns(
        {
            "raw_detected": F.col("localized_cue_cells") > 0,
            "detected": F.col("incremental_localized") > 0,
            "step_detected": F.col("incremental_step_localized") > 0,
            "before_detected": F.col("incremental_before_localized") > 0,
        }
    )

"""The geometry review of many packages in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import components as C
from latticeqc.operators import geometry as G
from latticeqc.operators import project, proximity
from latticeqc.operators import tile_kernel as K
from latticeqc.operators import tile_tables as T
from latticeqc.operators.digest import grid_digest
from latticeqc.session import materialize, merged

KEYS = ("package_id",)


def grid_sizes(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return surf.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def cell_shapes(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Size of the cell lattice: one less than the vertex grid in each direction."""
    return materialize(
        grid_sizes(surf, keys).select(*keys, (F.col("height") - 1).alias("height"), (F.col("width") - 1).alias("width"))
    )


def hole_runs(cells: DataFrame, shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of invalid cells enclosed by the surface (8-connected, not touching the lattice border)."""
    empty = cells.where("NOT cell_valid")
    return C.enclosed(C.label_runs(empty, keys, 8), shapes, keys)


def coherent_bands(frame: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of step-candidate cells in 8-connected bands of at least the configured size."""
    candidates = frame.where("cell").select(*keys, "row", "col", "step_candidate")
    return _large_bands(materialize(C.label_runs(materialize(candidates).where("step_candidate"), keys, 8)), cfg, keys)


def _large_bands(labelled: DataFrame, cfg: ReviewConfig, keys: Sequence[str]) -> DataFrame:
    sizes = C.component_sizes(labelled, keys).where(F.col("size") >= cfg.normal_step_min_component_cells)
    return labelled.join(merged(materialize(sizes.drop("size"))), [*keys, "label"], "left_semi")


def final_cells(reviewed: DataFrame, near: DataFrame, bands: DataFrame, keys: Sequence[str] = KEYS, cued: bool = False) -> DataFrame:
    """Cells with both cue masks and the final score; with ``cued`` only those that a cue names.

    ``cue_before`` is the union without the step bands; both it and ``cue`` are kept, as the families overlap.
    """
    cells = T.tile_cells(reviewed, keys, marks=T.tile_marks(near, bands, keys), cued=cued)
    near_valid = F.col("near") & F.col("cell_valid")
    return cells.withColumns(
        {
            "cue_before": F.col("local_cue") | near_valid,
            "cue": F.col("local_cue") | near_valid | F.col("band"),
            "score": F.when(near_valid | F.col("band"), F.lit(1.0)).otherwise(F.col("local_score")),
        }
    ).drop("near")


# Finding code -> (level, predicate over the summary row).
FINDING_RULES = {
    "nonfinite-valid": ("error", "nonfinite_valid > 0"),
    "partial-sentinel": ("error", "partial_sentinel > 0"),
    "mask-coordinate-disagreement": ("error", "mask_disagreement > 0"),
    "disconnected-vertices": ("review", "vertex_components > 1"),
    "enclosed-gaps": ("review", "enclosed_regions > 0"),
    "long-edges": ("review", "long_edges > 0"),
    "short-edges": ("review", "short_edges > 0"),
    "degenerate-triangles": ("review", "degenerate_triangles > 0"),
    "folded-quads": ("review", "folded_quads > 0"),
    "triangulation-sensitive": ("review", "split_sensitive > 0"),
    "normal-jumps": ("review", "normal_jumps > 0"),
    "coherent-normal-step": ("review", "coherent_components > 0"),
    "anisotropic-cells": ("review", "high_condition > 0"),
    "symmetric-stretch": ("review", "high_stretch > 0"),
    "area-distortion": ("review", "area_distortion > 0"),
    "high-shear": ("review", "high_shear > 0"),
    "high-distortion": ("review", "high_dirichlet > 0"),
    "global-spacing-drift": ("review", "abs(isotropic - 1) > 0.15D"),
    "global-spacing-anisotropy": ("review", "anisotropy > 1.25D"),
    "nonlocal-proximity": ("review", "pair_count > 0"),
}


def geometry_findings(summary: DataFrame, keys: Sequence[str] = KEYS, codes: Sequence[str] = tuple(FINDING_RULES)) -> DataFrame:
    """``keys, level, code`` of every rule among ``codes`` that holds."""
    rules = ", ".join(
        f"named_struct('level', '{level}', 'code', '{code}', 'hit', coalesce({hit}, false))"
        for code, (level, hit) in FINDING_RULES.items()
        if code in codes
    )
    return summary.selectExpr(*keys, f"inline(filter(array({rules}), r -> r.hit))").drop("hit")


@dataclass(frozen=True)
class GeometryReport:
    summary: DataFrame
    findings: DataFrame
    frame: DataFrame
    cells: DataFrame
    cued: DataFrame
    pairs: DataFrame
    holes: DataFrame
    bands: DataFrame
    reviewed: DataFrame


FRAME_COLUMNS = [
    "row", "col", "cell", "cell_valid", "h_ok", "h_len", "h_ratio", "v_ok", "v_len", "v_ratio", "area", "sine_a", "sine_b",
    "degenerate_a", "degenerate_b", "near_a", "near_b", "fold_cosine", "alt_fold_cosine", "sensitive_value", "folded",
    "folded_both", "split_sensitive", "condition_number", "symmetric_stretch", "area_ratio", "shear", "symmetric_dirichlet",
    "high_condition", "high_stretch", "low_area", "high_area", "area_distortion", "high_shear", "high_dirichlet",
    "h_jump", "v_jump", "h_flip", "v_flip", "h_angle", "v_angle", "top_step", "left_step", "top_candidate", "left_candidate",
    "step_candidate", "local_cue", "local_score",
]


def tile_references(tiles: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS, size: int = T.TILE) -> DataFrame:
    """``spacing_reference`` from packed tiles of ``size``."""
    medians = T.value_quantiles(T.edge_values(tiles, keys, size), keys, [0.5])
    median = lambda m: F.max(F.when(F.col("metric") == m, F.col("q")[0]))
    wide = medians.groupBy(*keys).agg(median(0).alias("obs_h"), median(1).alias("obs_v"))
    packages = tiles.select(*keys).distinct()
    return G.with_declared(packages.join(merged(wide), list(keys), "left"), cfg, keys)


def _count(df: DataFrame, keys: Sequence[str], name: str, value: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg((F.count("*") if value is None else value).alias(name))


def geometry_report(surf: DataFrame, cfg: ReviewConfig = ReviewConfig(), keys: Sequence[str] = KEYS, keep: int = 50, tiles: DataFrame | None = None, values: bool = True) -> GeometryReport:
    """Summary, findings and detail tables for every package of ``surf`` (see ``load_surface``); ``keep`` places of an example list.

    ``tiles`` are the packed tiles of ``surf`` (see ``surface_tiles``) for a caller that has them; its rows are then read for ``frame`` only,
    and for a limited proximity sample. Without ``values`` nothing is written of the distributions and example lists either: ``reviewed`` has them
    still, but a caller that reads it pays for one more pass over the tiles.
    """
    cfg.check()
    keys = list(keys)
    if tiles is None:
        surf = materialize(surf)
        tiles = T.surface_tiles(surf, keys)
    refs = tile_references(tiles, cfg, keys)
    reviewed = T.review_tiles(tiles, refs, cfg, keys, keep, values=values)
    counts = materialize(T.tile_counters(reviewed, keys))
    shapes = materialize(counts.select(*keys, (F.col("height") - 1).alias("height"), (F.col("width") - 1).alias("width")))
    parts = T.tile_components(reviewed, keys)

    def labelled(kind: str) -> DataFrame:
        return parts.where(F.col("kind") == kind).drop("kind")

    holes = materialize(C.enclosed(labelled("gap"), shapes, keys))
    bands = materialize(_large_bands(labelled("step"), cfg, keys))
    if cfg.max_proximity_points is None:
        rest = tiles.groupBy(*keys).agg(F.sum(F.expr(f"length(rest) div {K.POINT.itemsize}")).alias("_rest"))
        points = F.col("valid_count") - F.col("nonfinite_valid") + F.col("_rest")
        sampled = counts.join(merged(rest), keys).select(*keys, points.alias("sampled_points"), F.lit(1).alias("proximity_stride"), F.lit(False).alias("proximity_capped")).where("sampled_points > 0")
        pairs = materialize(proximity.tile_pairs(tiles, refs, cfg, keys))
    else:
        sample = proximity.proximity_sample(proximity.usable_points(surf, keys), cfg.max_proximity_points, keys)
        sampled = sample.groupBy(*keys).agg(F.count("*").alias("sampled_points"), F.max("stride").alias("proximity_stride"), F.max("capped").alias("proximity_capped"))
        pairs = materialize(proximity.proximity_pairs(sample, refs, cfg, keys))
    near = project.vertices_to_cells(proximity.pair_vertices(pairs, keys), counts.select(*keys, "height", "width"), keys)
    cells, cued = (final_cells(reviewed, near, bands, keys, only) for only in (False, True))
    counted = [
        T.component_count(parts, keys, "vertex", "vertex_components"),
        T.component_count(parts, keys, "cell", "cell_components"),
        C.component_sizes(holes, keys).groupBy(*keys).agg(F.count("*").alias("enclosed_regions"), F.sum("size").alias("enclosed_cells")),
        C.component_sizes(bands, keys).groupBy(*keys).agg(F.count("*").alias("coherent_components"), F.sum("size").alias("coherent_cells")),
        sampled,
        _count(pairs, keys, "pair_count"),
    ]
    # Of the frame nothing is written: a caller that wants values per vertex pays for them.
    frame = G.surface_frame(surf, refs, cfg, keys).select(*keys, *FRAME_COLUMNS)
    summary = counts
    # Merged: as broadcasts all of them would be held by the driver at once.
    for part in (refs, G.target_spacing(refs, cfg, keys), *counted):
        summary = summary.join(merged(part), keys, "left")
    counters = [c for c in summary.columns if c.endswith(("_components", "_regions", "_cells", "_count", "_points"))]
    summary = summary.fillna(0, subset=counters)
    # Surface area against the area of a regular grid of the same number of cells.
    observed = F.col("valid_quads") * F.col("obs_h") * F.col("obs_v")
    summary = materialize(
        summary.withColumns({"observed_grid_area": observed, "area_to_grid": F.try_divide("surface_area", observed)})
    )
    return GeometryReport(summary, geometry_findings(summary, keys), frame, cells, cued, pairs, holes, bands, reviewed if values else T.reviewed_tiles(tiles, refs, cfg, keys, keep))


def signature(report: GeometryReport, keys: Sequence[str] = KEYS) -> DataFrame:
    """What has to stay equal when nothing changed: finding codes, counters and the cue mask digest."""
    codes = report.findings.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    mask = report.cells.select(*keys, "row", "col", F.when(F.col("cue"), "1").otherwise("0").alias("text"))
    counters = [
        "valid_quads", "long_edges", "short_edges", "degenerate_triangles", "folded_quads", "normal_jumps", "coherent_components",
        "coherent_cells", "high_condition", "high_stretch", "high_dirichlet", "area_distortion", "high_shear", "pair_count",
    ]
    return (
        report.summary.select(*keys, *counters)
        .join(codes, list(keys), "left")
        .join(grid_digest(mask, "text", keys, "cue_digest"), list(keys), "left")
        .fillna("", subset=["codes"])
    )

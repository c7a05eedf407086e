"""Geometry review stages on top of the grid frame: references, cues, scores, findings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.numeric import above, below, flag_count, is_finite, no, np_div
from latticeqc.functions import sqltext as T
from latticeqc.operators import grid
from latticeqc.operators.quantiles import exact_quantiles, largest_group
from latticeqc.session import materialize, prefer_small_methods

KEYS = ("package_id",)


def spacing_reference(surf: DataFrame, cfg: ReviewConfig = ReviewConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, obs_h, obs_v, ref_h, ref_v``: median edge lengths, and the declared spacing if given.

    Written out, so that the joins that follow know its size.
    """
    keys = list(keys)
    bound = largest_group(surf, keys)
    lengths = grid.edges(surf, keys).where("valid AND length > 1e-12").select(*keys, "direction", "length")
    medians = exact_quantiles(lengths, [*keys, "direction"], "length", [0.5], group_rows=bound)
    wide = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("direction") == "horizontal", F.col("q")[0])).alias("obs_h"),
        F.max(F.when(F.col("direction") == "vertical", F.col("q")[0])).alias("obs_v"),
    )
    packages = surf.select(*keys).distinct()
    return with_declared(packages.join(wide, keys, "left"), cfg, keys)


def with_declared(observed: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, obs_h, obs_v`` with the references: the declared spacing, or else what was observed."""
    return materialize(
        observed.select(
            *keys,
            "obs_h",
            "obs_v",
            _declared(cfg.expected_spacing_x, "obs_h").alias("ref_h"),
            _declared(cfg.expected_spacing_y, "obs_v").alias("ref_v"),
        )
    )


def _declared(value: float | None, observed: str) -> Column:
    return F.lit(float(value)) if value is not None else F.col(observed)


def target_spacing(refs: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed over expected spacing per axis, with the isotropic and anisotropy factors."""
    none = F.lit(None).cast("double")
    fx = F.col("obs_h") / cfg.expected_spacing_x if cfg.expected_spacing_x else none
    fy = F.col("obs_v") / cfg.expected_spacing_y if cfg.expected_spacing_y else none
    x, y = F.col("factor_x"), F.col("factor_y")
    return refs.select(*keys, fx.alias("factor_x"), fy.alias("factor_y")).withColumns(
        {"isotropic": F.sqrt(x * y), "anisotropy": F.greatest(np_div(x, y), np_div(y, x))}
    )


def edge_ratios(surf: DataFrame, refs: DataFrame, cfg: ReviewConfig = ReviewConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with ``ratio`` to the observed median of their direction, and the long/short flags."""
    observed = F.when(F.col("direction") == "horizontal", F.col("obs_h")).otherwise(F.col("obs_v"))
    joined = grid.edges(surf, keys).join(refs, list(keys), "left").withColumn("ratio", np_div(F.col("length"), observed))
    return joined.withColumns(
        {
            "long": F.coalesce(above(F.col("ratio"), cfg.long_edge_ratio), no()),
            "short": F.coalesce(below(F.col("ratio"), cfg.short_edge_ratio), no()),
        }
    )


def surface_frame(
    surf: DataFrame, refs: DataFrame, cfg: ReviewConfig = ReviewConfig(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Everything that depends on a vertex and its neighbourhood, one row per vertex.

    Cells live on the row of their upper left vertex (``cell`` is true).  Columns a caller does not
    use are pruned together with the windows that feed them.
    """
    keys = list(keys)
    prefer_small_methods(surf.sparkSession)
    with_refs = surf.join(refs, keys, "left")
    # Rows stay slim through the sorts: only corners and normals pass them, metrics come afterwards.
    frame = grid.cell_normal_columns(grid.corners(with_refs, keys, after=2, before=1))
    frame = grid.to_own(grid.normal_columns(frame, keys))
    frame = grid.edge_columns(grid.step_columns(frame, cfg))
    frame = grid.jacobian_columns(grid.triangle_columns(frame))
    frame = grid.distortion_flags(frame, cfg)
    return local_cues(frame, cfg)


def local_cues(frame: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Per-cell cue flags and the severity score, before components and proximity are known."""
    ratios = {
        "h_ratio": f"CASE WHEN h_ok THEN {T.div('h_len', 'obs_h')} END",
        "v_ratio": f"CASE WHEN v_ok THEN {T.div('v_len', 'obs_v')} END",
    }
    lengths = {}
    for name, (p, q, s, t, axis) in grid.SIDES.items():
        lengths[f"{name}_len"] = f"CASE WHEN valid{s} AND valid{t} THEN {T.norm(T.sub(q, p))} END"
        ratios[f"{name}_ratio"] = f"CASE WHEN {T.finite(f'{name}_len')} THEN {T.div(f'{name}_len', f'obs_{axis}')} END"
    sides = [f"{n}_ratio" for n in grid.SIDES]
    turn = math.cos(math.radians(cfg.normal_jump_degrees))
    dots = [f"{n}_dot" for n in ("right", "left", "down", "up")]
    frame = T.stage(T.stage(frame, lengths), ratios)
    frame = T.stage(
        frame,
        {
            "edge_cue": T.any_of(
                [T.above(s, cfg.long_edge_ratio) for s in sides] + [T.below(s, cfg.short_edge_ratio) for s in sides]
            ),
            "jump_cue": T.any_of([T.below(d, turn) for d in dots]),
            "h_jump": T.below("right_dot", turn),
            "v_jump": T.below("down_dot", turn),
            "h_flip": T.below("right_dot", 0.0),
            "v_flip": T.below("down_dot", 0.0),
            "h_angle": "degrees(acos(right_dot))",
            "v_angle": "degrees(acos(down_dot))",
            # Smallest cosine around the cell; least() ignores nulls.
            "worst_dot": f"least({', '.join(dots)})",
            "edge_level": f"greatest({', '.join(T.edge_score(s) for s in sides)})",
        },
    )
    shape = T.any_of(
        ["degenerate_a", "degenerate_b", "folded", "split_sensitive", "high_condition", "high_stretch",
         "area_distortion", "high_shear", "high_dirichlet"]
    )
    area_limit = max(cfg.area_ratio_high, 1.0 / cfg.area_ratio_low)
    levels = [
        "edge_level",
        T.log2_score("condition_number", math.log2(max(cfg.condition_number, 1.0001))),
        T.log2_score("symmetric_stretch", math.log2(max(cfg.symmetric_stretch, 1.0001))),
        T.log2_score(f"greatest(area_ratio, {T.div('1D', 'area_ratio')})", math.log2(area_limit)),
        f"least(nanvl(shear, 0D) / {T.number(cfg.shear)}, 1D)",
        "jump_level",
    ]
    frame = T.stage(frame, {"jump_level": "CASE WHEN worst_dot IS NULL THEN 0D ELSE least(degrees(acos(worst_dot)) / 90D, 1D) END"})
    # A fold or collapse sets the score to 1; no level exceeds that.
    score = f"CASE WHEN degenerate_a OR degenerate_b OR folded THEN 1D ELSE greatest({', '.join(levels)}) END"
    return T.stage(
        frame,
        {
            "local_cue": f"cell AND (((edge_cue OR {shape}) AND cell_valid) OR jump_cue)",
            "local_score": f"CASE WHEN cell_valid THEN {score} END",
        },
    )


def cells_where(frame: DataFrame, condition: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Places on the cell lattice where a flag of the frame holds.

    A plain filter would be pushed below the stages that compute the flag, each of which would then be
    evaluated twice and inlined into one huge predicate; a generator stays where it is.
    """
    hit = f"explode(CASE WHEN cell AND ({condition}) THEN array(1) END) AS _hit"
    return frame.selectExpr(*keys, "row", "col", hit).drop("_hit")


CELL_COUNTS = {
    "valid_quads": "cell_valid",
    "folded_quads": "folded",
    "folded_both": "folded_both",
    "split_sensitive": "split_sensitive",
    "high_condition": "high_condition",
    "high_stretch": "high_stretch",
    "area_distortion": "area_distortion",
    "high_shear": "high_shear",
    "high_dirichlet": "high_dirichlet",
}


def cell_counts(frame: DataFrame, cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """All per-package counters of the frame in one aggregation."""
    def count(flag: str, name: str) -> str:
        return f"CAST(count_if({flag}) AS BIGINT) AS {name}"

    def both(first: str, second: str, name: str) -> str:
        return f"CAST(count_if({first}) + count_if({second}) AS BIGINT) AS {name}"

    texts = [count(f"{flag} AND cell", name) for name, flag in CELL_COUNTS.items()] + [
        both(*[T.above(f"{d}_ratio", cfg.long_edge_ratio) for d in "hv"], "long_edges"),
        both(*[T.below(f"{d}_ratio", cfg.short_edge_ratio) for d in "hv"], "short_edges"),
        both("degenerate_a", "degenerate_b", "degenerate_triangles"),
        both("near_a", "near_b", "near_degenerate_triangles"),
        both("h_jump", "v_jump", "normal_jumps"),
        both("h_flip", "v_flip", "orientation_flips"),
        "sum(CASE WHEN NOT isnan(area) THEN area END) AS surface_area",
    ]
    return frame.groupBy(*keys).agg(*[F.expr(t) for t in texts])


def vertex_integrity(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counters of the loaded surface: shape, valid, non-finite and sentinel vertices."""
    x, y, z = (F.col(a) for a in "xyz")
    finite = is_finite(x) & is_finite(y) & is_finite(z)
    some, every = (x == -1) | (y == -1) | (z == -1), (x == -1) & (y == -1) & (z == -1)
    derived = is_finite(z) & (z > 0)
    return surf.groupBy(*keys).agg(
        (F.max("row") + 1).cast("bigint").alias("height"),
        (F.max("col") + 1).cast("bigint").alias("width"),
        F.count("*").alias("vertex_count"),
        flag_count(F.col("valid")).alias("valid_count"),
        flag_count(~finite).alias("nonfinite_count"),
        flag_count(F.col("valid") & ~finite).alias("nonfinite_valid"),
        flag_count(every).alias("sentinel_count"),
        flag_count(some & ~every).alias("partial_sentinel"),
        flag_count(F.col("explicit_mask").isNotNull() & (F.col("valid") != derived)).alias("mask_disagreement"),
    )


# Value sources of the example lists: cue -> (flag, value, largest first, tag).
EXAMPLES = {
    "long-edges": [("h_long", "h_ratio", True, "horizontal"), ("v_long", "v_ratio", True, "vertical")],
    "short-edges": [("h_short", "h_ratio", False, "horizontal"), ("v_short", "v_ratio", False, "vertical")],
    "degenerate-triangles": [("degenerate_a", "sine_a", False, "official_a"), ("degenerate_b", "sine_b", False, "official_b")],
    "normal-jumps": [("h_jump", "h_angle", True, "horizontal"), ("v_jump", "v_angle", True, "vertical")],
    "orientation-flips": [("h_flip", "h_angle", True, "horizontal"), ("v_flip", "v_angle", True, "vertical")],
    "normal-steps": [("top_candidate", "top_step", True, "horizontal"), ("left_candidate", "left_step", True, "vertical")],
    "folded-quads": [("folded", "fold_cosine", False, "")],
    "triangulation-sensitive": [("split_sensitive", "sensitive_value", False, "")],
    "anisotropic-cells": [("high_condition", "condition_number", True, "")],
    "symmetric-stretch": [("high_stretch", "symmetric_stretch", True, "")],
    "low-area-ratio": [("low_area", "area_ratio", False, "")],
    "high-area-ratio": [("high_area", "area_ratio", True, "")],
    "high-shear": [("high_shear", "shear", True, "")],
    "high-distortion": [("high_dirichlet", "symmetric_dirichlet", True, "")],
}


def example_candidates(frame: DataFrame, cues: Sequence[str], cfg: ReviewConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, cue, tag, row, col, value, largest`` for every flagged location of the given cues."""
    marked = T.stage(
        frame,
        {
            **{f"{d}_long": T.above(f"{d}_ratio", cfg.long_edge_ratio) for d in "hv"},
            **{f"{d}_short": T.below(f"{d}_ratio", cfg.short_edge_ratio) for d in "hv"},
        },
    )
    entries = ", ".join(
        f"named_struct('cue', '{cue}', 'tag', '{tag}', 'largest', {str(largest).lower()}, 'value', {value}, 'hit', {flag})"
        for cue in cues
        for flag, value, largest, tag in EXAMPLES[cue]
    )
    return marked.selectExpr(*keys, "row", "col", f"inline(filter(array({entries}), e -> coalesce(e.hit, false)))").drop("hit")


def top_locations(found: DataFrame, limit: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """First ``limit`` locations per cue and tag.

    Largest values come with ties in reverse row-major order and NaN first; smallest values with ties
    in row-major order and NaN last.
    """
    by = Window.partitionBy(*keys, "cue", "tag")
    parts = []
    for largest in (True, False):
        order = (
            [F.desc("value"), F.desc("row"), F.desc("col")] if largest else [F.asc("value"), F.asc("row"), F.asc("col")]
        )
        # Two constant branches keep the ranking filter in a form Spark can push below the shuffle.
        parts.append(
            found.where(F.col("largest") == largest)
            .withColumn("rank", F.row_number().over(by.orderBy(*order)))
            .where(F.col("rank") <= limit)
        )
    return parts[0].unionByName(parts[1])


def merged_examples(found: DataFrame, limit: int = 50, each: int = 25, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two tagged lists of ``each`` locations joined, sorted again and cut at ``limit``."""
    first = top_locations(found, each, keys).drop("rank")
    unusable = ~is_finite(F.col("value"))
    sign = F.when(F.col("largest"), -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy(*keys, "cue").orderBy(
        F.when(unusable, 0).otherwise(1), F.when(unusable, F.lit(0.0)).otherwise(sign), "tag", "row", "col"
    )
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def tagged_value(value: Column) -> list[Column]:
    """A value fit for strict JSON: null with a tag when it is not finite."""
    tag = (
        F.when(F.isnan(value), "nan").when(value == float("inf"), "positive_infinity").when(value == float("-inf"), "negative_infinity")
    )
    return [F.when(is_finite(value), value).alias("value"), tag.alias("nonfinite")]


# Metric names and the columns that they summarize.
METRICS = {
    "horizontal_edge_length": "h_len_ok",
    "vertical_edge_length": "v_len_ok",
    "horizontal_observed_ratio": "h_ratio",
    "vertical_observed_ratio": "v_ratio",
    "quad_area": "area",
    "triangle_normalized_area_sine": ("sine_a", "sine_b"),
    "official_diagonal_fold_cosine": "fold_cosine",
    "alternate_diagonal_fold_cosine": "alt_fold_cosine",
    "condition_number": "condition_number",
    "symmetric_stretch": "symmetric_stretch",
    "area_ratio": "area_ratio",
    "shear": "shear",
    "symmetric_dirichlet": "symmetric_dirichlet",
    "normal_jump_degrees": ("h_angle", "v_angle"),
    "horizontal_step": "top_step",
    "vertical_step": "left_step",
}


def metric_rows(frame_df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frame to long form ``keys, metric, value``."""
    marked = frame_df.withColumns({"h_len_ok": F.when(F.col("h_ok"), F.col("h_len")), "v_len_ok": F.when(F.col("v_ok"), F.col("v_len"))})
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
        for m, cols in METRICS.items()
        for c in ([cols] if isinstance(cols, str) else cols)
    ]
    usable = F.filter(F.array(*entries), lambda e: is_finite(e["value"]))
    return marked.select(*keys, F.explode(usable).alias("e")).select(*keys, "e.metric", "e.value")

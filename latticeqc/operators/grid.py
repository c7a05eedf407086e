"""Edges, cells and surface normals of a vertex grid, all on one tiled shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.sqltext import (
    NAN, above, add, any_of, below, clip_cosine, cross, div, dot, finite, norm, stage, sub, unit, vec,
)
from latticeqc.operators.tiles import OWN, TILE, TILE_COL, TILE_ROW, neighbour, owned_text, tile

KEYS = ("package_id",)

# Corners (r,c), (r,c+1), (r+1,c), (r+1,c+1) of the cell with origin (r,c).
P00, P01, P10, P11 = vec(""), vec("", "01"), vec("", "10"), vec("", "11")


def quad_cells(df: DataFrame, flag: str = "valid", keys: Sequence[str] = KEYS, size: int = TILE) -> DataFrame:
    """``keys, row, col, cell_valid`` for every cell of the lattice; the AND of its four corners."""
    keys = list(keys)
    slim = tile(df.selectExpr(*keys, "row", "col", f"{flag} AS _f"), keys, 0, 1, size)
    right, down = neighbour(keys, "col", 1), neighbour(keys, "row", 1)
    # Null where there is no right neighbour; a plain AND would turn a false flag there into false.
    paired = stage(stage(slim, {"_right": right("_f")}), {"_pair": "CASE WHEN _right IS NOT NULL THEN _f AND _right END"})
    return (
        stage(paired, {"_below": down("_pair"), OWN: owned_text(size)})
        .where(f"_pair IS NOT NULL AND _below IS NOT NULL AND {OWN}")
        .selectExpr(*keys, "row", "col", "_pair AND _below AS cell_valid")
    )


def quad_counts(df: DataFrame, flag: str = "valid", keys: Sequence[str] = KEYS) -> DataFrame:
    return quad_cells(df, flag, keys).groupBy(*keys).agg(F.count_if("cell_valid").cast("bigint").alias("face_count"))


def corners(surf: DataFrame, keys: Sequence[str] = KEYS, after: int = 1, before: int = 0, size: int = TILE) -> DataFrame:
    """Vertices with their right, lower and diagonal neighbours; still tiled, halo rows included.

    ``cell`` says that the cell with this origin exists; ``valid01``/``valid10`` are null where the
    right/lower neighbour does not.
    """
    keys = list(keys)
    tiled = tile(surf, keys, before, after, size)
    right, down = neighbour(keys, "col", 1), neighbour(keys, "row", 1)
    names = ["x", "y", "z", "valid"]
    paired = stage(tiled, {f"{n}01": right(n) for n in names})
    squared = stage(
        paired,
        {
            **{f"{n}10": down(n) for n in names},
            **{f"{n}11": down(f"{n}01") for n in names},
            OWN: owned_text(size),
        },
    )
    return stage(
        squared,
        {
            "cell": "valid01 IS NOT NULL AND valid11 IS NOT NULL",
            "cell_valid": "coalesce(valid AND valid01 AND valid10 AND valid11, false)",
        },
    )


def edge_columns(frame: DataFrame) -> DataFrame:
    """Length and validity of the right and lower edge of each vertex."""
    sized = stage(frame, {"h_len": norm(sub(P01, P00)), "v_len": norm(sub(P10, P00))})
    return stage(
        sized,
        {
            "h_ok": f"coalesce(valid AND valid01, false) AND {finite('h_len')}",
            "v_ok": f"coalesce(valid AND valid10, false) AND {finite('v_len')}",
        },
    )


def edges(surf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, row, col, direction, ex, ey, ez, length, valid``; length is null on unusable edges."""
    keys = list(keys)
    frame = edge_columns(corners(surf, keys)).where(OWN)

    def one(direction: str, prefix: str, end: str) -> str:
        delta = ", ".join(f"'e{a}', {d}" for a, d in zip("xyz", sub(vec("", end), P00)))
        return (
            f"named_struct('direction', '{direction}', {delta}, 'length', CASE WHEN {prefix}_ok THEN {prefix}_len END,"
            f" 'valid', {prefix}_ok, 'there', valid{end} IS NOT NULL)"
        )

    pair = f"array({one('horizontal', 'h', '01')}, {one('vertical', 'v', '10')})"
    return frame.selectExpr(*keys, "row", "col", f"inline(filter({pair}, e -> e.there))").drop("there")


def triangle_columns(frame: DataFrame) -> DataFrame:
    """Areas, sines and fold tests of the two triangles of each cell (split along the p10-p01 diagonal)."""
    sides = {
        "ta": cross(sub(P01, P00), sub(P10, P00)),
        "tb": cross(sub(P11, P01), sub(P10, P01)),
        "sa": cross(sub(P01, P00), sub(P11, P00)),
        "sb": cross(sub(P11, P00), sub(P10, P00)),
    }
    out = stage(frame, {f"{t}_{a}": c for t, v in sides.items() for a, c in zip("xyz", v)})
    out = stage(out, {f"{t}_len": norm(vec(f"{t}_")) for t in sides})
    out = stage(out, {f"{t}_u{a}": c for t in sides for a, c in zip("xyz", unit(vec(f"{t}_"), f"{t}_len"))})
    base_a = f"({norm(sub(P01, P00))} * {norm(sub(P10, P00))})"
    base_b = f"({norm(sub(P11, P01))} * {norm(sub(P10, P01))})"
    on_cell = {
        "sine_a": div("ta_len", base_a),
        "sine_b": div("tb_len", base_b),
        "fold_cosine": dot(vec("ta_u"), vec("tb_u")),
        "alt_fold_cosine": dot(vec("sa_u"), vec("sb_u")),
        "area": "0.5D * (ta_len + tb_len)",
    }
    out = stage(
        out,
        {
            **{n: f"CASE WHEN cell_valid THEN {c} END" for n, c in on_cell.items()},
        },
    )
    collapsed = "cell_valid AND (NOT {f} OR {c} <= 1e-6D)"
    close = "cell_valid AND {f} AND {c} <= 1e-3D"
    out = stage(
        out,
        {
            **{f"degenerate_{t}": collapsed.format(f=finite(f"sine_{t}"), c=f"sine_{t}") for t in "ab"},
            **{f"near_{t}": close.format(f=finite(f"sine_{t}"), c=f"sine_{t}") for t in "ab"},
            "folded": below("fold_cosine", 0.0),
            "alt_folded": below("alt_fold_cosine", 0.0),
        },
    )
    return stage(
        out,
        {
            "folded_both": "folded AND alt_folded",
            "split_sensitive": "folded <> alt_folded",
            # greatest() keeps NaN, least() would drop it.
            "sensitive_value": "-greatest(-fold_cosine, -alt_fold_cosine)",
        },
    )


def cell_normal_columns(frame: DataFrame) -> DataFrame:
    """Only the unit normal of each cell, the one cell value its neighbours need."""
    scratch = []
    out = frame

    def put(columns: dict[str, str]) -> None:
        nonlocal out
        out = stage(out, columns)
        scratch.extend(columns)

    sides = {"_a": cross(sub(P01, P00), sub(P10, P00)), "_b": cross(sub(P11, P01), sub(P10, P01))}
    put({f"{t}{a}": c for t, v in sides.items() for a, c in zip("xyz", v)})
    put({f"{t}l": norm(vec(t)) for t in sides})
    put({f"{t}u{a}": c for t in sides for a, c in zip("xyz", unit(vec(t), f"{t}l"))})
    put({f"_m{a}": c for a, c in zip("xyz", add(vec("_au"), vec("_bu")))})
    put({"_ml": norm(vec("_m"))})
    out = stage(
        out,
        {
            **{f"n{a}": c for a, c in zip("xyz", unit(vec("_m"), "_ml"))},
            "normal_ok": f"cell_valid AND {finite('_ml')} AND _ml > 1e-12D",
        },
    )
    return out.drop(*scratch)


def jacobian_columns(frame: DataFrame) -> DataFrame:
    """Singular values of the bilinear map at the cell centre and five distortion metrics.

    Needs ``ref_h`` and ``ref_v``; without them the metrics are NaN on valid cells, null elsewhere.
    """
    centre = {}
    for a, o, p, q, r in zip("xyz", P00, P01, P10, P11):
        half = f"0.5D * ({r} - {q} - {p} + {o})"
        centre[f"du_{a}"] = f"coalesce({div(f'({p} - {o} + {half})', 'ref_h')}, {NAN})"
        centre[f"dv_{a}"] = f"coalesce({div(f'({q} - {o} + {half})', 'ref_v')}, {NAN})"
    du, dv = vec("du_"), vec("dv_")
    out = stage(frame, centre)
    out = stage(out, {"g_uu": dot(du, du), "g_vv": dot(dv, dv), "g_uv": dot(du, dv)})
    out = stage(out, {"trace": "g_uu + g_vv", "determinant": "g_uu * g_vv - g_uv * g_uv"})
    out = stage(out, {"root": "sqrt(greatest(trace * trace - 4D * determinant, 0D))"})
    out = stage(
        out,
        {"lambda_max": "greatest(0.5D * (trace + root), 0D)", "lambda_min": "greatest(0.5D * (trace - root), 0D)"},
    )
    out = stage(out, {"sigma_max": "sqrt(lambda_max)", "sigma_min": "sqrt(lambda_min)"})
    metrics = {
        "condition_number": div("sigma_max", "sigma_min"),
        "symmetric_stretch": f"greatest(sigma_max, {div('1D', 'sigma_min')})",
        "area_ratio": "sigma_max * sigma_min",
        "shear": div("abs(g_uv)", "sqrt(g_uu * g_vv)"),
        "symmetric_dirichlet": f"lambda_max + lambda_min + {div('1D', 'lambda_max')} + {div('1D', 'lambda_min')}",
    }
    return stage(out, {n: f"CASE WHEN cell_valid THEN {c} END" for n, c in metrics.items()})


def distortion_flags(frame: DataFrame, cfg) -> DataFrame:
    out = stage(
        frame,
        {
            "high_condition": above("condition_number", cfg.condition_number),
            "high_stretch": above("symmetric_stretch", cfg.symmetric_stretch),
            "low_area": below("area_ratio", cfg.area_ratio_low),
            "high_area": above("area_ratio", cfg.area_ratio_high),
            "high_shear": above("shear", cfg.shear),
            "high_dirichlet": above("symmetric_dirichlet", cfg.symmetric_dirichlet),
        },
    )
    return stage(out, {"area_distortion": "low_area OR high_area"})


def _adjacent_dots(keys: list[str], axis: str) -> dict[str, str]:
    """Cosine between a cell's normal and the next and previous one along ``axis``."""
    out = {}
    for label, step in (("right", 1), ("left", -1)) if axis == "col" else (("down", 1), ("up", -1)):
        near = neighbour(keys, axis, step)
        value = clip_cosine(dot(vec("n"), [near(f"n{a}") for a in "xyz"]))
        out[f"{label}_dot"] = f"CASE WHEN normal_ok AND {near('normal_ok')} THEN {value} END"
    return out


def normal_columns(frame: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adjacent-cell cosines, vertex normals and the normals at the four corners of each cell."""
    keys = list(keys)
    up, left = neighbour(keys, "row", -1), neighbour(keys, "col", -1)
    right, down = neighbour(keys, "col", 1), neighbour(keys, "row", 1)
    names = ["cx", "cy", "cz", "cn"]
    out = stage(
        frame,
        {**{f"c{a}": f"CASE WHEN normal_ok THEN n{a} ELSE 0D END" for a in "xyz"}, "cn": "CASE WHEN normal_ok THEN 1 ELSE 0 END"},
    )
    # Cells above, then cells to the left of the vertex; columns first, as the rows are sorted so.
    out = stage(out, {**{f"{n}2": f"{n} + coalesce({up(n)}, 0)" for n in names}, **_adjacent_dots(keys, "row")})
    out = stage(out, {**{f"{n}4": f"{n}2 + coalesce({left(f'{n}2')}, 0)" for n in names}, **_adjacent_dots(keys, "col")})
    out = stage(out, {"vn_len": norm(vec("c", "4"))})
    out = stage(
        out,
        {
            **{f"vn{a}": c for a, c in zip("xyz", unit(vec("c", "4"), "vn_len"))},
            "vn_ok": f"cn4 > 0 AND {finite('vn_len')} AND vn_len > 1e-12D",
        },
    )
    out = out.drop("cx", "cy", "cz", "cn", "cx2", "cy2", "cz2", "cn2", "cx4", "cy4", "cz4", "cn4", "vn_len")
    names = ["vnx", "vny", "vnz", "vn_ok"]
    out = stage(out, {f"{n}01": right(n) for n in names})
    return stage(out, {**{f"{n}10": down(n) for n in names}, **{f"{n}11": down(f"{n}01") for n in names}})


# Sides of a cell: start, end, suffix of start and end, reference; top and left belong to the vertex itself.
SIDES = {
    "top": (P00, P01, "", "01", "h"),
    "bottom": (P10, P11, "10", "11", "h"),
    "left": (P00, P10, "", "10", "v"),
    "right": (P01, P11, "01", "11", "v"),
}


def step_columns(frame: DataFrame, cfg) -> DataFrame:
    """Share of each cell-side edge that runs along the surface normal, relative to the spacing."""
    sums, scores, hits = {}, {}, {}
    for name, (p, q, s, t, axis) in SIDES.items():
        total = add(vec("vn", s), vec("vn", t))
        # |edge . unit(total)| / reference, with the length divided out last.
        sums[f"{name}_along"] = f"abs({dot(sub(q, p), total)})"
        sums[f"{name}_size"] = norm(total)
        usable = (
            f"valid{s} AND valid{t} AND vn_ok{s} AND vn_ok{t} AND {name}_size > 1e-12D AND {finite(f'{name}_along')}"
        )
        share = div(f"try_divide({name}_along, {name}_size)", f"ref_{axis}")
        scores[f"{name}_step"] = f"CASE WHEN {usable} THEN {share} END"
        hits[f"{name}_candidate"] = f"{finite(f'{name}_step')} AND {name}_step >= double('{cfg.normal_step_ratio!r}')"
    out = stage(stage(stage(frame, sums), scores), hits)
    return stage(out, {"step_candidate": f"cell_valid AND {any_of([f'{n}_candidate' for n in SIDES])}"})


def to_own(frame: DataFrame) -> DataFrame:
    return frame.where(OWN).drop(TILE_ROW, TILE_COL, OWN)

"""Numpy measures of one tile: edges, cells, normals, steps, distortion, cues, runs and border links.

A tile comes with a halo of two lines before and three after its own window, which is what the normal steps of the cells
beside it need. Values follow the column stages of ``operators/grid`` and ``operators/geometry`` operation by operation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from latticeqc.config import ReviewConfig

BEFORE, AFTER = 2, 3
EXISTS, VALID, MASKED = 1, 2, 4
KINDS = ("vertex", "cell", "gap", "step")
REACH = {"vertex": 0, "cell": 0, "gap": 1, "step": 1}
COUNTERS = (
    "valid_quads", "folded_quads", "folded_both", "split_sensitive", "high_condition", "high_stretch", "area_distortion", "high_shear", "high_dirichlet",
    "long_edges", "short_edges", "degenerate_triangles", "near_degenerate_triangles", "normal_jumps", "orientation_flips", "vertex_count", "valid_count",
    "nonfinite_count", "nonfinite_valid", "sentinel_count", "partial_sentinel", "mask_disagreement", "vertices_without_faces",
)

Vec = tuple[np.ndarray, np.ndarray, np.ndarray]
POINT = np.dtype([("row", "<i4"), ("col", "<i4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")])


@dataclass
class Tile:
    """``at`` is the grid place of the first line and column; ``own`` slices the tile's own window out of its arrays."""

    at: tuple[int, int]
    own: tuple[slice, slice]
    point: Vec
    exists: np.ndarray
    valid: np.ndarray
    masked: np.ndarray


def unpacked(row: dict, size: int) -> Tile:
    """The tile of a packed row; one missing line and column follow its arrays, so that neighbours always exist."""
    shape = (row["height"], row["width"])

    def plane(name: str, kind, blank) -> np.ndarray:
        out = np.full((shape[0] + 1, shape[1] + 1), blank, kind)
        out[:-1, :-1] = np.frombuffer(row[name], kind).reshape(shape)
        return out

    state = plane("state", np.uint8, 0)
    own = tuple(slice(max(t * size - at, 0), min((t + 1) * size - at, n)) for t, at, n in zip((row["tile_row"], row["tile_col"]), (row["top"], row["left"]), shape))
    point = tuple(plane(a, np.float64, np.nan) for a in "xyz")
    return Tile((row["top"], row["left"]), own, point, state & EXISTS > 0, state & VALID > 0, state & MASKED > 0)


def points(*columns: np.ndarray) -> np.ndarray:
    """Values of POINT's columns as one array of records."""
    out = np.empty(len(columns[0]), POINT)
    for name, values in zip(POINT.names, columns):
        out[name] = values
    return out


def usable_points(row: dict, size: int) -> np.ndarray:
    """The valid vertices with finite coordinates of a packed row's own window, as POINTs."""
    tile = unpacked(row, size)
    x, y, z = (a[tile.own] for a in tile.point)
    r, c = np.nonzero(tile.valid[tile.own] & np.isfinite(x) & np.isfinite(y) & np.isfinite(z))
    top, left = tile.at[0] + tile.own[0].start, tile.at[1] + tile.own[1].start
    return np.concatenate([points(r + top, c + left, x[r, c], y[r, c], z[r, c]), np.frombuffer(row["rest"], POINT)])


def _right(a: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out[:, :-1], out[:, -1] = a[:, 1:], False if a.dtype == bool else np.nan
    return out


def _down(a: np.ndarray) -> np.ndarray:
    return _right(a.T).T


def _left(a: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    out[:, 1:] = a[:, :-1]
    return out


def _up(a: np.ndarray) -> np.ndarray:
    return _left(a.T).T


def _sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def _add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def _dot(a: Vec, b: Vec) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a: Vec) -> np.ndarray:
    return np.sqrt(_dot(a, a))


def _cross(a: Vec, b: Vec) -> Vec:
    return tuple(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1)))


def _unit(a: Vec, length: np.ndarray) -> Vec:
    good = np.isfinite(length) & (length > 1e-12)
    return tuple(np.where(good, p / length, np.nan) for p in a)


def edge_lengths(tile: Tile) -> dict[str, np.ndarray]:
    """Lengths of the right (h) and lower (v) edges, NaN where an edge is not usable."""
    out = {}
    for name, step in (("h", _right), ("v", _down)):
        length = _norm(_sub(tuple(step(a) for a in tile.point), tile.point))
        out[name] = np.where(tile.valid & step(tile.valid) & np.isfinite(length), length, np.nan)
    return out


def measured(tile: Tile, refs: dict[str, float], cfg: ReviewConfig) -> dict[str, np.ndarray]:
    """All values per vertex and cell of the tile, halo included; NaN where a value does not exist."""
    p00, p01, p10 = tile.point, tuple(map(_right, tile.point)), tuple(map(_down, tile.point))
    p11 = tuple(map(_right, p10))
    v00, v01, v10 = tile.valid, _right(tile.valid), _down(tile.valid)
    v11 = _right(v10)
    ref = {k: np.float64(np.nan if v is None else v) for k, v in refs.items()}
    cell = tile.exists & _right(tile.exists) & _down(tile.exists) & _right(_down(tile.exists))
    ok = v00 & v01 & v10 & v11
    m: dict[str, np.ndarray] = {"cell": cell, "cell_valid": ok}
    length = edge_lengths(tile)
    for axis in "hv":
        m[f"{axis}_len"], m[f"{axis}_ratio"] = length[axis], length[axis] / ref[f"obs_{axis}"]

    def on_cell(a: np.ndarray) -> np.ndarray:
        return np.where(ok, a, np.nan)

    # Triangles of both splits, and the normal of the cell.
    sides = {"ta": (_sub(p01, p00), _sub(p10, p00)), "tb": (_sub(p11, p01), _sub(p10, p01)), "sa": (_sub(p01, p00), _sub(p11, p00)), "sb": (_sub(p11, p00), _sub(p10, p00))}
    turned = {t: _cross(*s) for t, s in sides.items()}
    size = {t: _norm(c) for t, c in turned.items()}
    units = {t: _unit(turned[t], size[t]) for t in sides}
    for t in "ab":
        sine = on_cell(size[f"t{t}"] / (_norm(sides[f"t{t}"][0]) * _norm(sides[f"t{t}"][1])))
        m[f"sine_{t}"] = sine
        m[f"degenerate_{t}"] = ok & (~np.isfinite(sine) | (sine <= 1e-6))
        m[f"near_{t}"] = ok & np.isfinite(sine) & (sine <= 1e-3)
    m["fold_cosine"], m["alt_fold_cosine"] = on_cell(_dot(units["ta"], units["tb"])), on_cell(_dot(units["sa"], units["sb"]))
    m["area"] = on_cell(0.5 * (size["ta"] + size["tb"]))
    m["folded"], alt = m["fold_cosine"] < 0, m["alt_fold_cosine"] < 0
    m["folded_both"], m["split_sensitive"] = m["folded"] & alt, m["folded"] != alt
    m["sensitive_value"] = np.minimum(m["fold_cosine"], m["alt_fold_cosine"])
    total = _add(units["ta"], units["tb"])
    total_size = _norm(total)
    normal = _unit(total, total_size)
    normal_ok = ok & np.isfinite(total_size) & (total_size > 1e-12)

    # Singular values of the bilinear map at the cell's centre.
    half = tuple(0.5 * (r - q - p + o) for o, p, q, r in zip(p00, p01, p10, p11))
    du = tuple((p - o + h) / ref["ref_h"] for o, p, h in zip(p00, p01, half))
    dv = tuple((q - o + h) / ref["ref_v"] for o, q, h in zip(p00, p10, half))
    uu, vv, uv = _dot(du, du), _dot(dv, dv), _dot(du, dv)
    trace, determinant = uu + vv, uu * vv - uv * uv
    root = np.sqrt(np.maximum(trace * trace - 4.0 * determinant, 0.0))
    high, low = np.maximum(0.5 * (trace + root), 0.0), np.maximum(0.5 * (trace - root), 0.0)
    sigma_high, sigma_low = np.sqrt(high), np.sqrt(low)
    m["condition_number"] = on_cell(sigma_high / sigma_low)
    m["symmetric_stretch"] = on_cell(np.maximum(sigma_high, 1.0 / sigma_low))
    m["area_ratio"] = on_cell(sigma_high * sigma_low)
    m["shear"] = on_cell(np.abs(uv) / np.sqrt(uu * vv))
    m["symmetric_dirichlet"] = on_cell(high + low + 1.0 / high + 1.0 / low)
    m["high_condition"] = m["condition_number"] > cfg.condition_number
    m["high_stretch"] = m["symmetric_stretch"] > cfg.symmetric_stretch
    m["low_area"], m["high_area"] = m["area_ratio"] < cfg.area_ratio_low, m["area_ratio"] > cfg.area_ratio_high
    m["area_distortion"] = m["low_area"] | m["high_area"]
    m["high_shear"], m["high_dirichlet"] = m["shear"] > cfg.shear, m["symmetric_dirichlet"] > cfg.symmetric_dirichlet

    # Cosines between neighbouring cells, and vertex normals.
    def cosine(step) -> np.ndarray:
        near = tuple(map(step, normal))
        return np.where(normal_ok & step(normal_ok), np.minimum(np.maximum(_dot(normal, near), -1.0), 1.0), np.nan)

    dots = {"right": cosine(_right), "left": cosine(_left), "down": cosine(_down), "up": cosine(_up)}
    summed = [np.where(normal_ok, a, 0.0) for a in normal] + [normal_ok.astype(np.float64)]
    summed = [a + _up(a) for a in summed]
    *around, cells = [a + _left(a) for a in summed]
    around_size = _norm(around)
    at_vertex = _unit(around, around_size)
    vertex_ok = (cells > 0) & np.isfinite(around_size) & (around_size > 1e-12)
    corner = {"": (at_vertex, vertex_ok), "01": (tuple(map(_right, at_vertex)), _right(vertex_ok)), "10": (tuple(map(_down, at_vertex)), _down(vertex_ok))}
    corner["11"] = (tuple(_right(_down(a)) for a in at_vertex), _right(_down(vertex_ok)))
    points, valids = {"": p00, "01": p01, "10": p10, "11": p11}, {"": v00, "01": v01, "10": v10, "11": v11}
    stepped, edge_cue, ratios = [], np.zeros_like(ok), []
    for name, s, t, axis in (("top", "", "01", "h"), ("bottom", "10", "11", "h"), ("left", "", "10", "v"), ("right", "01", "11", "v")):
        side = _sub(points[t], points[s])
        both = _add(corner[s][0], corner[t][0])
        along, both_size = np.abs(_dot(side, both)), _norm(both)
        usable = valids[s] & valids[t] & corner[s][1] & corner[t][1] & (both_size > 1e-12) & np.isfinite(along)
        step = np.where(usable, along / both_size / ref[f"ref_{axis}"], np.nan)
        candidate = np.isfinite(step) & (step >= cfg.normal_step_ratio)
        stepped.append(candidate)
        m[f"{name}_step"], m[f"{name}_candidate"] = step, candidate
        length_ = np.where(valids[s] & valids[t], _norm(side), np.nan)
        ratio = np.where(np.isfinite(length_), length_ / ref[f"obs_{axis}"], np.nan)
        edge_cue |= (ratio > cfg.long_edge_ratio) | (ratio < cfg.short_edge_ratio)
        ratios.append(ratio)
    m["step_candidate"] = ok & np.logical_or.reduce(stepped)

    # Cues and the score before components and proximity are known.
    turn = math.cos(math.radians(cfg.normal_jump_degrees))
    jump_cue = np.logical_or.reduce([d < turn for d in dots.values()])
    for axis, name in (("h", "right"), ("v", "down")):
        m[f"{axis}_jump"], m[f"{axis}_flip"], m[f"{axis}_angle"] = dots[name] < turn, dots[name] < 0, np.degrees(np.arccos(dots[name]))
        m[f"{axis}_long"], m[f"{axis}_short"] = m[f"{axis}_ratio"] > cfg.long_edge_ratio, m[f"{axis}_ratio"] < cfg.short_edge_ratio
    flags = ("degenerate_a", "degenerate_b", "folded", "split_sensitive", "high_condition", "high_stretch", "area_distortion", "high_shear", "high_dirichlet")
    shape_cue = np.logical_or.reduce([m[f] for f in flags])
    m["local_cue"] = cell & (((edge_cue | shape_cue) & ok) | jump_cue)

    def log_level(value: np.ndarray, limit: float) -> np.ndarray:
        return np.minimum(np.log2(np.fmax(value, 1.0)) / math.log2(limit), 1.0)

    edge_level = [np.minimum(np.abs(np.log2(np.where(np.isnan(r), 1.0, r))) / 2.0, 1.0) for r in ratios]
    worst = np.fmin.reduce(list(dots.values()))
    levels = [
        *edge_level,
        log_level(m["condition_number"], max(cfg.condition_number, 1.0001)),
        log_level(m["symmetric_stretch"], max(cfg.symmetric_stretch, 1.0001)),
        log_level(np.maximum(m["area_ratio"], 1.0 / m["area_ratio"]), max(cfg.area_ratio_high, 1.0 / cfg.area_ratio_low)),
        np.minimum(np.where(np.isnan(m["shear"]), 0.0, m["shear"]) / cfg.shear, 1.0),
        np.where(np.isnan(worst), 0.0, np.minimum(np.degrees(np.arccos(worst)) / 90.0, 1.0)),
    ]
    m["local_score"] = on_cell(np.where(m["degenerate_a"] | m["degenerate_b"] | m["folded"], 1.0, np.maximum.reduce(levels)))
    return m


def counters(tile: Tile, m: dict[str, np.ndarray]) -> tuple[list[int], float | None]:
    """COUNTERS over the own window, and the surface area; None without a cell that has one."""
    def n(flag: np.ndarray) -> int:
        return int(np.count_nonzero(flag[tile.own]))

    x, y, z = tile.point
    finite = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    some, every = (x == -1) | (y == -1) | (z == -1), (x == -1) & (y == -1) & (z == -1)
    ok = m["cell_valid"]
    incident = ok | _up(ok) | _left(ok) | _up(_left(ok))
    cells = [n(m[f] & m["cell"]) for f in ("cell_valid", "folded", "folded_both", "split_sensitive", "high_condition", "high_stretch", "area_distortion", "high_shear", "high_dirichlet")]
    pairs = [n(m[a]) + n(m[b]) for a, b in (("h_long", "v_long"), ("h_short", "v_short"), ("degenerate_a", "degenerate_b"), ("near_a", "near_b"), ("h_jump", "v_jump"), ("h_flip", "v_flip"))]
    there = tile.exists
    vertices = [
        there, tile.valid, there & ~finite, tile.valid & ~finite, there & every, there & some & ~every,
        there & tile.masked & (tile.valid != (np.isfinite(z) & (z > 0))), tile.valid & ~incident,
    ]
    area = m["area"][tile.own]
    return cells + pairs + [n(v) for v in vertices], None if np.isnan(area).all() else float(np.nansum(area))


def masks(tile: Tile, m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"vertex": tile.valid, "cell": m["cell_valid"], "gap": m["cell"] & ~m["cell_valid"], "step": m["cell"] & m["step_candidate"]}


def smallest_reached(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Smallest node in the component of each node."""
    low = np.arange(size)
    while True:
        before = low.copy()
        edge_low = np.minimum(low[u], low[v])
        np.minimum.at(low, u, edge_low)
        np.minimum.at(low, v, edge_low)
        low = low[low]
        if np.array_equal(low, before):
            return low


def labelled_runs(mask: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of ``mask`` in row-major order, and the first run of each run's component."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    padded[:, 1:-1] = mask
    before, after = padded[:, :-1], padded[:, 1:]
    row, lo = np.nonzero(after & ~before)
    hi = np.nonzero(before & ~after)[1] - 1
    # Runs of the row above that a run touches are consecutive.
    wide = mask.shape[1] + 4
    first = np.searchsorted(row * wide + hi, (row - 1) * wide + lo - reach)
    last = np.searchsorted(row * wide + lo, (row - 1) * wide + hi + reach, "right")
    count = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(row)), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return row, lo, hi, smallest_reached(below, above, len(row))


def components(tile: Tile, mask: np.ndarray, reach: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Runs (row, lo, hi, root), links over the lower and right border (root, row, col of the cell beyond) and
    cells that other tiles may link to (row, col, root); places on the whole grid, roots are ids of runs.
    """
    rows, cols = tile.own
    own = mask[tile.own]
    row, lo, hi, root = labelled_runs(own, reach)
    top, left = tile.at[0] + rows.start, tile.at[1] + cols.start
    ids = (row + top).astype(np.int64) * (1 << 31) + lo + left
    roots = ids[root]
    runs = [row + top, lo + left, hi + left, roots]
    label = np.full(own.shape, -1, np.int64)
    label[own] = np.repeat(roots, hi - lo + 1)
    links, shape = [], own.shape
    moves = [(1, d) for d in range(-reach, reach + 1)] + [(d, 1) for d in range(-reach, reach + 1)]
    # Only cells on a border line have a neighbour beyond it.
    border = np.zeros_like(own)
    border[-1:], border[:, :1], border[:, -1:] = True, True, True
    edge_row, edge_col = np.nonzero(border & own)
    for dr, dc in dict.fromkeys(moves):
        r, c = edge_row, edge_col
        out = (r + dr >= shape[0]) if dr == 1 else np.zeros(len(r), bool)
        out |= (c + dc >= shape[1]) if dc == 1 else False
        out |= (c + dc < 0) if dr == 1 and dc == -1 else False
        r, c = r[out], c[out]
        gr, gc = r + rows.start + dr, c + cols.start + dc
        inside = (gr >= 0) & (gc >= 0) & (gr < mask.shape[0]) & (gc < mask.shape[1])
        r, c, gr, gc = r[inside], c[inside], gr[inside], gc[inside]
        hit = mask[gr, gc]
        links.append((label[r[hit], c[hit]], gr[hit] + tile.at[0], gc[hit] + tile.at[1]))
    border = np.zeros_like(own)
    border[:1], border[:, :1], border[:, -1:] = True, True, True
    pr, pc = np.nonzero(border & own)
    return runs, [np.concatenate(part) for part in zip(*links)], [pr + top, pc + left, label[pr, pc]]


def best_candidates(tile: Tile, m: dict[str, np.ndarray], entries: list[tuple[str, str, bool]], keep: int) -> list[tuple[np.ndarray, ...]]:
    """Per entry (flag, value, largest first) the places and values that can be among its first ``keep`` of the whole grid.

    Values that equal the last one within the nine digits of a list stay in, so that ties are left to the caller.
    """
    out = []
    for flag, value, largest in entries:
        r, c = np.nonzero(m[flag][tile.own])
        found = m[value][tile.own][r, c]
        if len(r) > keep:
            # NaN comes first among the largest and last among the smallest values.
            order = np.where(np.isnan(found), np.inf, found)
            order = -order if largest else order
            limit = np.partition(order, keep - 1)[keep - 1]
            near = order <= limit + 2e-9
            r, c, found = r[near], c[near], found[near]
        out.append((r + tile.at[0] + tile.own[0].start, c + tile.at[1] + tile.own[1].start, found))
    return out

"""Edges, cells, triangles, distortion and normals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.numeric import edge_score, finite_or_null, flag_count, is_finite, rounded
from latticeqc.operators import geometry as G
from latticeqc.operators import grid, project
from latticeqc.operators.quantiles import largest_group, summary
from latticeqc.queries.geometry_sql import edge_to_cells
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import fr6, r6
from latticeqc.queries.vertex_queries import validity
from latticeqc.session import materialize

CFG = ReviewConfig()
K = ["package_id", "row", "col"]


def fr(name: str, alias: str | None = None):
    return rounded(finite_or_null(F.col(name))).alias(alias or name)


def frame(fx) -> DataFrame:
    refs = G.spacing_reference(fx.surf, CFG)
    return G.surface_frame(fx.surf, refs, CFG)


def cells(fx) -> DataFrame:
    return frame(fx).where("cell")


# --- edges ---------------------------------------------------------------------------------------


def _edge_query(name, direction):
    @query(
        name,
        f"SELECT package_id, row, col, {fr6('ex')} AS ex, {fr6('ey')} AS ey, {fr6('ez')} AS ez, {r6('length')} AS length, valid FROM edge_all WHERE direction='{direction}'",
    )
    def run(fx):
        return grid.edges(fx.surf).where(F.col("direction") == direction).select(
            *K, fr("ex"), fr("ey"), fr("ez"), rounded(F.col("length")).alias("length"), "valid"
        )


_edge_query("horizontal_edges", "horizontal")
_edge_query("vertical_edges", "vertical")


@query("spacing_reference", f"SELECT package_id, {r6('obs_h')} AS obs_h, {r6('obs_v')} AS obs_v, 15e-1 AS ref_h, {r6('obs_v')} AS ref_v FROM refs")
def spacing_reference(fx):
    refs = G.spacing_reference(fx.surf, ReviewConfig(expected_spacing_x=1.5))
    return refs.select("package_id", *[rounded(F.col(c)).alias(c) for c in ("obs_h", "obs_v", "ref_h", "ref_v")])


def ratios(fx):
    return G.edge_ratios(fx.surf, G.spacing_reference(fx.surf, CFG), CFG)


@query("edge_ratios", f"SELECT package_id, direction, row, col, {fr6('ratio')} AS ratio FROM edge_ratio")
def edge_ratios(fx):
    return ratios(fx).select("package_id", "direction", "row", "col", fr("ratio"))


def _edge_flag(name, column):
    @query(name, f"SELECT package_id, direction, count(*) FILTER ({column}) AS edges FROM edge_ratio GROUP BY 1,2")
    def run(fx):
        return ratios(fx).groupBy("package_id", "direction").agg(flag_count(F.col(column)).alias("edges"))


_edge_flag("long_edges", "long")
_edge_flag("short_edges", "short")

EDGE_SCORE_SQL = (
    "CASE WHEN ratio IS NULL OR isnan(ratio) THEN 0e0 WHEN ratio=0 OR NOT isfinite(ratio) THEN 1e0"
    " ELSE least(abs(log2(CASE WHEN ratio>0 THEN ratio ELSE 1 END))/2,1e0) END"
)


define("scored_edges", f"SELECT *, {EDGE_SCORE_SQL} AS score FROM edge_ratio")


@query("edge_score", f"SELECT package_id, direction, row, col, {r6(EDGE_SCORE_SQL)} AS score FROM edge_ratio")
def edge_score_query(fx):
    return ratios(fx).select("package_id", "direction", "row", "col", rounded(edge_score(F.col("ratio"))).alias("score"))


@query(
    "project_edges_to_cells",
    f"""SELECT c.package_id, c.row, c.col, bool_or(long OR short) AS flagged, {r6('max(score)')} AS score FROM
      ({edge_to_cells('scored_edges', 'long, short, score')}) c JOIN quad q ON q.package_id=c.package_id AND q.row=c.row AND q.col=c.col GROUP BY 1,2,3""",
)
def project_edges_to_cells(fx):
    # The four sides of a cell are among its corners, so the frame needs no second shuffle.
    return cells(fx).select(*K, F.col("edge_cue").alias("flagged"), rounded(F.col("edge_level")).alias("score"))


@query(
    "project_adjacency_to_cells",
    "SELECT package_id, row, col, bool_or(jump) AS flagged FROM jump_cells GROUP BY 1,2,3",
)
def project_adjacency_to_cells(fx):
    pairs = frame(fx).select(
        *K,
        F.explode(
            F.array(
                F.struct(F.lit("horizontal").alias("direction"), F.col("right_dot").alias("cosine"), F.col("h_jump").alias("flag")),
                F.struct(F.lit("vertical").alias("direction"), F.col("down_dot").alias("cosine"), F.col("v_jump").alias("flag")),
            )
        ).alias("p"),
    ).select(*K, "p.*").where("cosine IS NOT NULL")
    return project.adjacency_to_cells(pairs, "flag").withColumnRenamed("flag", "flagged")


define("part_sentinel", "SELECT package_id, row, col FROM flags WHERE partial_sentinel")
VERTEX_TO_CELLS = """SELECT DISTINCT f.package_id, f.row-i AS row, f.col-j AS col FROM {source} f
  CROSS JOIN (SELECT unnest([0,1]) AS i) ii CROSS JOIN (SELECT unnest([0,1]) AS j) jj JOIN shapes s ON s.package_id=f.package_id
  WHERE f.row-i BETWEEN 0 AND s.height-2 AND f.col-j BETWEEN 0 AND s.width-2"""


@query("vertex_flags_to_cells", VERTEX_TO_CELLS.format(source="part_sentinel"))
def vertex_flags_to_cells(fx):
    from latticeqc.operators.masks import vertex_flags
    from latticeqc.sources.surfaces import grid_shapes

    return project.vertices_to_cells(vertex_flags(fx.vertices).where("partial_sentinel"), materialize(grid_shapes(fx.vertices)))


define(
    "incident",
    """SELECT DISTINCT package_id, row+i AS row, col+j AS col FROM quad CROSS JOIN (SELECT unnest([0,1]) AS i) ii
       CROSS JOIN (SELECT unnest([0,1]) AS j) jj WHERE ok""",
)


@query(
    "cells_to_vertices",
    """SELECT s.package_id, s.row, s.col, i.package_id IS NOT NULL AS incident, s.valid AND i.package_id IS NULL AS without_face
       FROM surf s LEFT JOIN incident i ON i.package_id=s.package_id AND i.row=s.row AND i.col=s.col""",
)
def cells_to_vertices(fx):
    return project.incident_vertices(fx.surf)


@query(
    "target_spacing",
    f"""SELECT package_id, {r6('fx')} AS factor_x, {r6('fy')} AS factor_y, {r6('sqrt(fx*fy)')} AS isotropic, {r6('greatest(fx/fy,fy/fx)')} AS anisotropy,
      abs(sqrt(fx*fy)-1)>15e-2 AS drift, greatest(fx/fy,fy/fx)>125e-2 AS anisotropic
      FROM (SELECT package_id, obs_h/8e-1 AS fx, obs_v/11e-1 AS fy FROM refs)""",
)
def target_spacing(fx):
    cfg = ReviewConfig(expected_spacing_x=0.8, expected_spacing_y=1.1)
    found = G.target_spacing(G.spacing_reference(fx.surf, cfg), cfg)
    return found.select(
        "package_id",
        *[rounded(F.col(c)).alias(c) for c in ("factor_x", "factor_y", "isotropic", "anisotropy")],
        (F.abs(F.col("isotropic") - 1) > 0.15).alias("drift"),
        (F.col("anisotropy") > 1.25).alias("anisotropic"),
    )


# --- cells ---------------------------------------------------------------------------------------


@query("quad_cells", "SELECT package_id, row, col, ok AS cell_valid FROM quad")
def quad_cells(fx):
    return grid.quad_cells(fx.surf)


define(
    "portable_quad",
    """SELECT a.package_id, a.row, a.col, a.portable AND b.portable AND c.portable AND d.portable AS ok
    FROM validity a JOIN validity b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col+1
    JOIN validity c ON c.package_id=a.package_id AND c.row=a.row+1 AND c.col=a.col
    JOIN validity d ON d.package_id=a.package_id AND d.row=a.row+1 AND d.col=a.col+1""",
)


@query("valid_quads", "SELECT package_id, count(*) FILTER (ok) AS face_count FROM portable_quad GROUP BY 1")
def valid_quads(fx):
    return grid.quad_counts(validity(fx), "portable")


define(
    "xquad",
    """SELECT a.package_id, a.row, a.col, s.height, s.width, a.x IS DISTINCT FROM -1 AND b.x IS DISTINCT FROM -1 AND c.x IS DISTINCT FROM -1 AND d.x IS DISTINCT FROM -1 AS ok
    FROM vertices a JOIN vertices b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col+1
    JOIN vertices c ON c.package_id=a.package_id AND c.row=a.row+1 AND c.col=a.col
    JOIN vertices d ON d.package_id=a.package_id AND d.row=a.row+1 AND d.col=a.col+1
    JOIN shapes s ON s.package_id=a.package_id""",
)
BOUNDARY_SQL = """SELECT q.package_id, s.height, s.width, v.n AS valid_vertices, count(*) FILTER (ok) AS valid_quads,
   count(*) FILTER (ok AND (q.row+2=s.height OR q.col+2=s.width)) AS added_quads,
   count(*) FILTER (ok AND q.row+2=s.height) AS last_row_quads, count(*) FILTER (ok AND q.col+2=s.width) AS last_col_quads,
   count(*) FILTER (ok AND q.row+2=s.height AND q.col+2=s.width) AS corner_quad
   FROM xquad q JOIN shapes s ON s.package_id=q.package_id JOIN (SELECT package_id, count(*) FILTER (x IS DISTINCT FROM -1) AS n FROM vertices GROUP BY 1) v
   ON v.package_id=q.package_id GROUP BY 1,2,3,4"""
define("boundary_counts", BOUNDARY_SQL)


@query("boundary_quads", BOUNDARY_SQL)
def boundary_quads(fx):
    return project.boundary_counts(fx.vertices)


@query(
    "halfopen_quads",
    """SELECT q.package_id, 2*count(DISTINCT struct_pack(r:=q.row, c:=q.col)) AS faces, count(DISTINCT struct_pack(r:=q.row+i, c:=q.col+j)) AS vertices
       FROM portable_quad q JOIN shapes s ON s.package_id=q.package_id CROSS JOIN (SELECT unnest([0,1]) AS i) ii CROSS JOIN (SELECT unnest([0,1]) AS j) jj
       WHERE q.ok AND q.row<s.height-2 AND q.col<s.width-2 GROUP BY 1""",
)
def halfopen_quads(fx):
    return project.halfopen_counts(validity(fx), "portable")


def _cell_query(name, columns, where="ok", spark_where="cell_valid"):
    """Rounded numbers or plain flags of the frame; ``columns`` maps name -> (spark column, SQL column)."""
    numbers = {n: v for n, v in columns.items() if not n.startswith("is_")}
    flags = {n[3:]: v for n, v in columns.items() if n.startswith("is_")}
    sql = ", ".join([f"{fr6(q)} AS {n}" for n, (_, q) in numbers.items()] + [f"{q} AS {n}" for n, (_, q) in flags.items()])

    @query(name, f"SELECT package_id, row, col, {sql} FROM cells WHERE {where}")
    def run(fx):
        return cells(fx).where(spark_where).select(
            *K, *[fr(s, n) for n, (s, _) in numbers.items()], *[F.col(s).alias(n) for n, (s, _) in flags.items()]
        )


def _same(*names):
    return {n: (n, n) for n in names}


def _flags(*names):
    return {f"is_{n}": (n, n) for n in names}


_cell_query(
    "triangle_normals",
    {
        **{f"a_{c}": (f"ta_u{c}", f"tau{c}") for c in "xyz"},
        **{f"b_{c}": (f"tb_u{c}", f"tbu{c}") for c in "xyz"},
        "double_area_a": ("ta_len", "talen"),
        "double_area_b": ("tb_len", "tblen"),
    },
)
_cell_query("triangle_sine", _same("sine_a", "sine_b"))
_cell_query("degenerate_triangles", _flags("degenerate_a", "degenerate_b", "near_a", "near_b"))
_cell_query("folded_quads", {**_same("fold_cosine"), **_flags("folded")})
_cell_query("alternate_fold", {**_same("alt_fold_cosine"), **_flags("alt_folded", "folded_both", "split_sensitive")})
_cell_query("cell_normals", {**{f"n{c}": (f"n{c}", f"n{c}") for c in "xyz"}, **_flags("normal_ok")})
_cell_query("bilinear_center", {**{f"du_{c}": (f"du_{c}", f"du{c}") for c in "xyz"}, **{f"dv_{c}": (f"dv_{c}", f"dv{c}") for c in "xyz"}})
_cell_query("gram_singular_values", {"sigma_max": ("sigma_max", "smax"), "sigma_min": ("sigma_min", "smin")})
for _metric in ("condition_number", "symmetric_stretch", "area_ratio", "shear", "symmetric_dirichlet"):
    _cell_query(_metric, _same(_metric))
_cell_query("distortion_flags", _flags("high_condition", "high_stretch", "low_area", "high_area", "high_shear", "high_dirichlet"))


@query(
    "quad_area",
    f"""SELECT c.package_id, {r6('sum(area) FILTER (isfinite(area))')} AS surface_area, {r6('count(*) FILTER (ok)*obs_h*obs_v')} AS observed_grid_area,
      {r6('sum(area) FILTER (isfinite(area))/(count(*) FILTER (ok)*obs_h*obs_v)')} AS ratio FROM cells c GROUP BY c.package_id, obs_h, obs_v""",
)
def quad_area(fx):
    total = cells(fx).groupBy("package_id", "obs_h", "obs_v").agg(
        F.sum(F.when(is_finite(F.col("area")), F.col("area"))).alias("a"),
        (flag_count(F.col("cell_valid")) * F.col("obs_h") * F.col("obs_v")).alias("g"),
    )
    return total.select(
        "package_id", rounded(F.col("a")).alias("surface_area"), rounded(F.col("g")).alias("observed_grid_area"), rounded(F.col("a") / F.col("g")).alias("ratio")
    )


@query("review_cue_mask", "SELECT package_id, row, col, local_cue AS cue FROM local_cells")
def review_cue_mask(fx):
    return cells(fx).select(*K, F.col("local_cue").alias("cue"))


@query("review_score", f"SELECT package_id, row, col, {r6('local_score')} AS score FROM scored_cells")
def review_score(fx):
    return cells(fx).select(*K, rounded(F.col("local_score")).alias("score"))


_cell_metric = lambda m, c: f"SELECT package_id, '{m}' AS metric, {c} AS v FROM cells"
define(
    "metric_values",
    " UNION ALL ".join(
        [
            f"SELECT package_id, '{d}_edge_length' AS metric, length AS v FROM edge_all WHERE direction='{d}'" for d in ("horizontal", "vertical")
        ]
        + [f"SELECT package_id, '{d}_observed_ratio' AS metric, ratio AS v FROM edge_ratio WHERE direction='{d}'" for d in ("horizontal", "vertical")]
        + [
            _cell_metric(m, c)
            for m, cols in G.METRICS.items()
            for c in ([cols] if isinstance(cols, str) else cols)
            if c in ("area", "sine_a", "sine_b", "fold_cosine", "alt_fold_cosine", "condition_number", "symmetric_stretch", "area_ratio", "shear", "symmetric_dirichlet")
        ]
        + ["SELECT package_id, 'normal_jump_degrees' AS metric, angle AS v FROM jumps"]
        + [f"SELECT package_id, '{d}_step' AS metric, score AS v FROM steps WHERE direction='{d}'" for d in ("horizontal", "vertical")]
    ),
)
METRIC_SQL = f"""SELECT package_id, metric, count(*) AS count, {r6('min(v)')} AS min, {r6('quantile_cont(v,5e-2)')} AS p05, {r6('quantile_cont(v,5e-1)')} AS p50,
  {r6('quantile_cont(v,95e-2)')} AS p95, {r6('max(v)')} AS max FROM metric_values WHERE v IS NOT NULL AND isfinite(v) GROUP BY 1,2"""


@query("metric_summary", METRIC_SQL)
def metric_summary(fx):
    rows = summary(G.metric_rows(frame(fx)), ["package_id"], "metric", "value", 2 * largest_group(fx.vertices, ["package_id"]))
    return rows.select("package_id", "metric", "count", *[rounded(F.col(c)).alias(c) for c in ("min", "p05", "p50", "p95", "max")])


# --- normals -------------------------------------------------------------------------------------


@query("normal_jumps", f"SELECT package_id, direction, row, col, {r6('angle')} AS angle, jump, flip FROM jumps")
def normal_jumps(fx):
    entry = lambda d, a, j, f: F.struct(F.lit(d).alias("direction"), F.col(a).alias("angle"), F.col(j).alias("jump"), F.col(f).alias("flip"))
    pairs = F.array(entry("horizontal", "h_angle", "h_jump", "h_flip"), entry("vertical", "v_angle", "v_jump", "v_flip"))
    return (
        cells(fx).select(*K, F.explode(F.filter(pairs, lambda p: p["angle"].isNotNull())).alias("p"))
        .select("package_id", "p.direction", "row", "col", rounded(F.col("p.angle")).alias("angle"), "p.jump", "p.flip")
    )


@query(
    "normal_jump_score",
    f"""SELECT c.package_id, c.row, c.col, {r6('coalesce(max(least(angle/90,1e0)),0e0)')} AS score FROM cells c LEFT JOIN jump_cells j
       ON j.package_id=c.package_id AND j.row=c.row AND j.col=c.col GROUP BY 1,2,3""",
)
def normal_jump_score(fx):
    score = F.when(F.col("worst_dot").isNull(), F.lit(0.0)).otherwise(F.least(F.degrees(F.acos("worst_dot")) / 90.0, F.lit(1.0)))
    return cells(fx).select(*K, rounded(score).alias("score"))


@query("vertex_normals", f"SELECT package_id, row, col, {fr6('vnx')} AS nx, {fr6('vny')} AS ny, {fr6('vnz')} AS nz FROM vnormal WHERE vn_ok")
def vertex_normals(fx):
    return frame(fx).where("vn_ok").select(*K, *[fr(f"vn{a}", f"n{a}") for a in "xyz"])


define(
    "edge_support",
    f"""SELECT e.package_id, e.direction, e.row, e.col, a.vnx+b.vnx AS sx, a.vny+b.vny AS sy, a.vnz+b.vnz AS sz FROM edge_all e
      JOIN vnormal a ON a.package_id=e.package_id AND a.row=e.row AND a.col=e.col AND a.vn_ok
      JOIN vnormal b ON b.package_id=e.package_id AND b.row=e.row+CAST(e.direction='vertical' AS INT) AND b.col=e.col+CAST(e.direction='horizontal' AS INT) AND b.vn_ok
      WHERE e.valid""",
)


@query(
    "edge_normals",
    f"""SELECT package_id, direction, row, col, {r6('sx/len')} AS nx, {r6('sy/len')} AS ny, {r6('sz/len')} AS nz FROM
       (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS len FROM edge_support) WHERE isfinite(len) AND len>1e-12""",
)
def edge_normals(fx):
    return project.edge_normals(frame(fx)).select("package_id", "direction", "row", "col", fr("nx"), fr("ny"), fr("nz"))


def step_rows(fx):
    entry = lambda d, s, c: F.struct(F.lit(d).alias("direction"), F.col(s).alias("score"), F.col(c).alias("hit"))
    pairs = F.array(entry("horizontal", "top_step", "top_candidate"), entry("vertical", "left_step", "left_candidate"))
    return (
        frame(fx).select(*K, F.explode(F.filter(pairs, lambda p: p["score"].isNotNull())).alias("p"))
        .select("package_id", "p.direction", "row", "col", "p.score", "p.hit")
    )


@query("normal_step_score", f"SELECT package_id, direction, row, col, {fr6('score')} AS score FROM steps")
def normal_step_score(fx):
    return step_rows(fx).select("package_id", "direction", "row", "col", fr("score"))


@query("normal_step_candidates", "SELECT package_id, row, col FROM step_cells")
def normal_step_candidates(fx):
    return G.cells_where(frame(fx), "step_candidate")

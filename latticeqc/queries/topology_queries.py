"""Components, holes, regions, graphs, dilation, proximity and surface comparison."""

from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.numeric import rounded
from latticeqc.operators import components as C
from latticeqc.operators import diff, digest, grid, project, proximity
from latticeqc.operators import geometry as G
from latticeqc.plans.geometry_report import cell_shapes, coherent_bands, hole_runs
from latticeqc.plans.splits import component_ids
from latticeqc.queries.grid_queries import CFG, K, VERTEX_TO_CELLS, frame
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import r6, set_digest_sql
from latticeqc.session import materialize
from latticeqc.sources.surfaces import grid_shapes


def component_blocks(name: str, source: str, connectivity: int) -> None:
    """Blocks ``{name}_lab``: runs with the smallest run they reach, by transitive closure."""
    reach = 1 if connectivity == 8 else 0
    define(
        f"{name}_runs",
        f"""SELECT package_id, row, min(col) AS lo, max(col) AS hi, row*CAST(2147483648 AS BIGINT)+min(col) AS run FROM
        (SELECT *, col-row_number() OVER (PARTITION BY package_id,row ORDER BY col) AS isl FROM ({source})) GROUP BY package_id, row, isl""",
    )
    define(
        f"{name}_adj",
        f"""SELECT a.package_id, a.run AS u, b.run AS v FROM {name}_runs a JOIN {name}_runs b ON b.package_id=a.package_id
        AND b.row IN (a.row-1,a.row+1) AND a.lo<=b.hi+{reach} AND b.lo<=a.hi+{reach}""",
    )
    define(
        f"{name}_reach",
        f"""SELECT package_id, run AS node, run AS root FROM {name}_runs UNION
        SELECT r.package_id, e.v, r.root FROM {name}_reach r JOIN {name}_adj e ON e.package_id=r.package_id AND e.u=r.node WHERE r.root<e.v""",
    )
    define(
        f"{name}_lab",
        f"""SELECT r.package_id, r.row, r.lo, r.hi, min(q.root) AS label FROM {name}_runs r JOIN {name}_reach q
        ON q.package_id=r.package_id AND q.node=r.run GROUP BY 1,2,3,4""",
    )
    define(f"{name}_size", f"SELECT package_id, label, CAST(sum(hi-lo+1) AS BIGINT) AS size FROM {name}_lab GROUP BY 1,2")


component_blocks("vc", "SELECT package_id, row, col FROM surf WHERE valid", 4)
component_blocks("cc", "SELECT package_id, row, col FROM quad WHERE ok", 4)
component_blocks("hc", "SELECT package_id, row, col FROM quad WHERE NOT ok", 8)
component_blocks("bc", "SELECT package_id, row, col FROM step_cells", 8)
component_blocks("pc", "SELECT package_id, row, col FROM flags WHERE sentinel_any", 8)
define(
    "holes",
    """SELECT l.* FROM hc_lab l JOIN (SELECT l.package_id, label FROM hc_lab l JOIN shapes s ON s.package_id=l.package_id GROUP BY l.package_id, label
       HAVING NOT bool_or(row=0 OR row=s.height-2 OR lo=0 OR hi=s.width-2)) o ON o.package_id=l.package_id AND o.label=l.label""",
)
define("bands", "SELECT l.* FROM bc_lab l JOIN bc_size s ON s.package_id=l.package_id AND s.label=l.label WHERE s.size>=8")
define("band_cells", "SELECT package_id, row, unnest(generate_series(lo,hi)) AS col FROM bands")


def _label_sql(name: str) -> str:
    return f"SELECT package_id, row, lo, hi, label FROM {name}"


@query("components4", _label_sql("vc_lab"))
def components4(fx):
    return C.label_runs(fx.surf.where("valid"), ["package_id"], 4)


@query("components8", _label_sql("pc_lab"))
def components8(fx):
    from latticeqc.operators.masks import vertex_flags

    return C.label_runs(vertex_flags(fx.vertices).where("sentinel_any"), ["package_id"], 8)


@query(
    "component_sizes",
    """SELECT package_id, kind, size, count(*) AS components FROM (SELECT package_id, 'vertex' AS kind, size FROM vc_size
       UNION ALL SELECT package_id, 'cell', size FROM cc_size) GROUP BY 1,2,3""",
)
def component_sizes(fx):
    surf = fx.surf
    vertex = C.component_sizes(C.label_runs(surf.where("valid"), ["package_id"], 4)).withColumn("kind", F.lit("vertex"))
    cell = C.component_sizes(C.label_runs(grid.quad_cells(surf).where("cell_valid"), ["package_id"], 4))
    both = vertex.unionByName(cell.withColumn("kind", F.lit("cell")))
    return both.groupBy("package_id", "kind", "size").agg(F.count("*").alias("components"))


@query("enclosed_regions", _label_sql("holes"))
def enclosed_regions(fx):
    surf = fx.surf
    return hole_runs(grid.quad_cells(surf), cell_shapes(surf)).select("package_id", "row", "lo", "hi", "label")


REGION_SQL = """SELECT package_id, label, CAST(sum(hi-lo+1) AS BIGINT) AS cell_count, min(row) AS row_min, min(lo) AS col_min, max(row) AS row_max, max(hi) AS col_max,
  round(sum(row*(hi-lo+1))*1e0/sum(hi-lo+1),6)+0e0 AS centroid_row, round(sum((lo+hi)*(hi-lo+1)/2e0)/sum(hi-lo+1),6)+0e0 AS centroid_col FROM holes GROUP BY 1,2"""


REGION_RANKS = f"SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY cell_count DESC, label) AS rank, count(*) OVER (PARTITION BY package_id) AS total, false AS truncated FROM ({REGION_SQL})"


@query("region_summary", REGION_RANKS)
def region_summary(fx):
    surf = fx.surf
    regions = C.region_summary(hole_runs(grid.quad_cells(surf), cell_shapes(surf)))
    return regions.withColumns({c: rounded(F.col(c)) for c in ("centroid_row", "centroid_col")})


@query("coherent_steps", "SELECT package_id, label, size FROM bc_size WHERE size>=8")
def coherent_steps(fx):
    return C.component_sizes(coherent_bands(frame(fx), CFG))


# --- graph ---------------------------------------------------------------------------------------

define("graph_edges", "SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b FROM overlap_fx WHERE a<>b")
define(
    "graph_reach",
    """SELECT CAST(doc_id AS VARCHAR) AS node, CAST(doc_id AS VARCHAR) AS root FROM documents UNION
       SELECT CASE WHEN e.a=r.node THEN e.b ELSE e.a END, r.root FROM graph_reach r JOIN graph_edges e ON e.a=r.node OR e.b=r.node""",
)
define("graph_lab", "SELECT node, min(root) AS label FROM graph_reach GROUP BY 1")
define(
    "graph_ids",
    f"SELECT label, count(*) AS size, concat('sha256:',{set_digest_sql('node')}) AS component_id, {set_digest_sql('node')} AS members FROM graph_lab GROUP BY 1",
)


def graph(fx):
    edges = fx.overlap_edges.selectExpr("a AS u", "b AS v")
    return C.graph_components(fx.overlap_nodes, edges)


@query("graph_components", "SELECT node, label FROM graph_lab")
def graph_components(fx):
    return graph(fx)


@query("component_id", "SELECT l.node, component_id, size FROM graph_lab l JOIN graph_ids i ON i.label=l.label")
def component_id(fx):
    return component_ids(graph(fx)).select("node", "component_id", "size")


# --- dilation ------------------------------------------------------------------------------------


def _dilated(source: str, radius: int) -> str:
    return f"""SELECT DISTINCT d.package_id, d.row+i AS row, d.col+j AS col FROM ({source}) d CROSS JOIN (SELECT unnest(generate_series(-{radius},{radius})) AS i) ii
      CROSS JOIN (SELECT unnest(generate_series(-{radius},{radius})) AS j) jj JOIN shapes s ON s.package_id=d.package_id
      WHERE d.row+i BETWEEN 0 AND s.height-2 AND d.col+j BETWEEN 0 AND s.width-2"""


define("folded_cells", "SELECT package_id, row, col FROM cells WHERE folded")


@query("dilate", _dilated("SELECT package_id, row, col FROM folded_cells", 2))
def dilate(fx):
    return diff.dilate(G.cells_where(frame(fx), "folded"), 2, cell_shapes(fx.surf))


define(
    "annotation_seeds",
    """SELECT DISTINCT a.package_id, CAST(floor(h) AS INT)-i AS row, CAST(floor(w) AS INT)-j AS col FROM annotations_fx a CROSS JOIN (SELECT unnest([0,1]) AS i) ii
       CROSS JOIN (SELECT unnest([0,1]) AS j) jj JOIN shapes s ON s.package_id=a.package_id
       WHERE a.valid AND CAST(floor(h) AS INT)-i BETWEEN 0 AND s.height-2 AND CAST(floor(w) AS INT)-j BETWEEN 0 AND s.width-2""",
)
define("annotated", _dilated("SELECT package_id, row, col FROM annotation_seeds", 1))


@query("annotation_neighborhoods", "SELECT package_id, row, col FROM annotated")
def annotation_neighborhoods(fx):
    from latticeqc.sources.annotations import neighborhoods

    return neighborhoods(fx.annotations.where("valid"), cell_shapes(fx.vertices), radius=1)


# --- proximity -----------------------------------------------------------------------------------

# The surface wrapped around every 16 columns, so that distant grid positions meet in space.
WRAP = "x-16*floor(col/16)"
define("wrapped", f"SELECT package_id, row, col, {WRAP} AS x, y, z FROM surf WHERE valid AND isfinite(x) AND isfinite(y) AND isfinite(z)")
define("near_limit", "SELECT package_id, 6e-1*sqrt(obs_h*obs_v) AS lim FROM refs")
NEAR = ReviewConfig(nonlocal_distance_ratio=0.6, max_proximity_points=1500, max_proximity_pairs=20)


def wrapped(fx):
    return proximity.usable_points(fx.surf).withColumn("x", F.col("x") - 16 * F.floor(F.col("col") / 16))


define("near_n", "SELECT package_id, greatest(1,CAST(ceil(sqrt(count(*)/1500e0)) AS INT)) AS stride FROM wrapped GROUP BY 1")
define(
    "near_sample",
    """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY package_id) AS m, row_number() OVER (PARTITION BY package_id ORDER BY row,col)-1 AS i FROM
       (SELECT w.*, stride FROM wrapped w JOIN near_n n ON n.package_id=w.package_id WHERE row%stride=0 AND col%stride=0))
       WHERE m<=1500 OR i IN (SELECT (k*m)//1500 FROM (SELECT unnest(generate_series(0,1499)) AS k))""",
)


@query("proximity_sample", "SELECT package_id, row, col, stride, m>1500 AS capped FROM near_sample")
def proximity_sample(fx):
    return proximity.proximity_sample(wrapped(fx), 1500).select(*K, "stride", "capped")


CAP = ReviewConfig(nonlocal_distance_ratio=0.6, max_proximity_points=300, max_proximity_pairs=20)


@query(
    "proximity_sample_capped",
    """SELECT package_id, row, col FROM (SELECT *, count(*) OVER (PARTITION BY package_id) AS m, row_number() OVER (PARTITION BY package_id ORDER BY row,col)-1 AS i
       FROM wrapped w WHERE (row+2*col)%3=0 AND row%4=0 AND col%4=0 ) WHERE m<=30 OR i IN (SELECT (k*m)//30 FROM (SELECT unnest(generate_series(0,29)) AS k))""",
)
def proximity_sample_capped(fx):
    # Validity that lines up with the stride leaves more points than the limit, so the cap acts.
    aligned = wrapped(fx).where("(row+2*col)%3=0 AND row%4=0 AND col%4=0")
    return proximity.proximity_sample(aligned, 30).select(*K)


define(
    "near_pairs",
    """SELECT a.package_id, a.row AS a_row, a.col AS a_col, b.row AS b_row, b.col AS b_col, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS distance,
       9*(floor(a.x/lim)-floor(b.x/lim)+1)+3*(floor(a.y/lim)-floor(b.y/lim)+1)+floor(a.z/lim)-floor(b.z/lim)+1 AS visit
       FROM wrapped a JOIN near_limit l ON l.package_id=a.package_id JOIN wrapped b ON b.package_id=a.package_id AND (b.row>a.row OR (b.row=a.row AND b.col>a.col))
       WHERE greatest(abs(a.row-b.row),abs(a.col-b.col))>4 AND sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))<lim""",
)


def near_pairs(fx):
    points = proximity.proximity_sample(wrapped(fx), 100_000)
    return proximity.proximity_pairs(points, G.spacing_reference(fx.surf, NEAR), NEAR)


@query("nonlocal_proximity", f"SELECT package_id, a_row, a_col, b_row, b_col, {r6('distance')} AS distance FROM near_pairs")
def nonlocal_proximity(fx):
    return near_pairs(fx).select("package_id", "a_row", "a_col", "b_row", "b_col", rounded(F.col("distance")).alias("distance"))


@query(
    "proximity_pairs",
    """SELECT p.package_id, rank, a_row, a_col, b_row, b_col, n AS pair_count, n>20 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY package_id) AS n,
       row_number() OVER (PARTITION BY package_id ORDER BY b_row,b_col,visit,a_row,a_col) AS rank FROM near_pairs) p WHERE rank<=20""",
)
def proximity_pairs(fx):
    pairs = materialize(near_pairs(fx))
    totals = proximity.pair_totals(pairs, 20)
    return proximity.listed_pairs(pairs, 20).join(totals, "package_id").select(
        "package_id", "rank", "a_row", "a_col", "b_row", "b_col", "pair_count", "truncated"
    )


define("near_vertices", "SELECT package_id, a_row AS row, a_col AS col FROM near_pairs UNION SELECT package_id, b_row, b_col FROM near_pairs")


@query(
    "proximity_cells",
    f"SELECT c.package_id, c.row, c.col FROM ({VERTEX_TO_CELLS.format(source='near_vertices')}) c JOIN quad q ON q.package_id=c.package_id AND q.row=c.row AND q.col=c.col AND q.ok",
)
def proximity_cells(fx):
    touched = project.vertices_to_cells(proximity.pair_vertices(near_pairs(fx)), materialize(grid_shapes(fx.vertices)))
    return touched.join(grid.quad_cells(fx.surf).where("cell_valid"), K, "left_semi")


# --- comparison ----------------------------------------------------------------------------------

CHANGED = (
    "CASE WHEN (row*3+col*5)%97=0 THEN -1e0 WHEN x=-1 AND (row+col)%3=0 THEN 5e0 WHEN (row+col*7)%31=0 THEN x+5e-1 ELSE x END"
)
define("plain", "SELECT package_id, row, col, x, y, z FROM surf")
define("changed", f"SELECT package_id, row, col, {CHANGED} AS x, y, z FROM surf")
define(
    "diff_pairs",
    """SELECT coalesce(a.package_id,b.package_id) AS package_id, coalesce(a.row,b.row) AS row, coalesce(a.col,b.col) AS col, a.package_id IS NOT NULL AS ina, b.package_id IS NOT NULL AS inb,
       CAST(CAST(b.x AS FLOAT)-CAST(a.x AS FLOAT) AS DOUBLE) AS dx, CAST(CAST(b.y AS FLOAT)-CAST(a.y AS FLOAT) AS DOUBLE) AS dy, CAST(CAST(b.z AS FLOAT)-CAST(a.z AS FLOAT) AS DOUBLE) AS dz,
       isnan(a.x) OR isnan(b.x) OR a.x<>b.x OR isnan(a.y) OR isnan(b.y) OR a.y<>b.y OR isnan(a.z) OR isnan(b.z) OR a.z<>b.z AS differs,
       b.x-a.x AS ex, b.y-a.y AS ey, b.z-a.z AS ez
       FROM (SELECT * FROM plain WHERE isnan(x) OR x<>-1) a FULL JOIN (SELECT * FROM changed WHERE isnan(x) OR x<>-1) b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col""",
)


def versions(fx):
    before = fx.surf.select(*K, "x", "y", "z")
    return before, before.selectExpr(*K, f"{CHANGED} AS x", "y", "z")


@query(
    "surface_diff",
    """SELECT package_id, count(*) FILTER (ina) AS before_valid, count(*) FILTER (inb) AS after_valid, count(*) FILTER (ina AND inb) AS common,
       count(*) FILTER (ina AND NOT inb) AS before_only, count(*) FILTER (inb AND NOT ina) AS after_only, count(*) FILTER (ina AND inb AND d<>0) AS changed,
       CASE WHEN bool_or(ina AND inb AND isnan(d)) THEN NULL ELSE round(coalesce(avg(d) FILTER (ina AND inb AND d<>0),0e0),6)+0e0 END AS mean_displacement,
       round(coalesce(max(d) FILTER (ina AND inb AND d<>0 AND isfinite(d)),0e0),6)+0e0 AS max_displacement,
       coalesce(first(row ORDER BY d DESC, row, col) FILTER (ina AND inb AND d<>0 AND isfinite(d)),0) AS max_row,
       coalesce(first(col ORDER BY d DESC, row, col) FILTER (ina AND inb AND d<>0 AND isfinite(d)),0) AS max_col
       FROM (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS d FROM diff_pairs) GROUP BY 1""",
)
def surface_diff(fx):
    out = diff.surface_diff(*versions(fx))
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_displacement", "max_displacement")})


ALIGNED_SQL = """SELECT package_id, count(*) FILTER (ina AND inb) AS common, count(*) FILTER (ina AND NOT inb) AS before_only, count(*) FILTER (inb AND NOT ina) AS after_only,
  count(*) FILTER (ina<>inb) AS symmetric_difference, count(*) FILTER (c) AS changed, count(*) FILTER (c AND NOT isfinite(d)) AS nonfinite_changed,
  round(coalesce(avg(d) FILTER (c AND isfinite(d)),0e0),6)+0e0 AS mean_changed, round(coalesce(avg(d) FILTER (ina AND inb AND isfinite(d)),0e0),6)+0e0 AS mean_common,
  round(coalesce(max(d) FILTER (c AND isfinite(d)),0e0),6)+0e0 AS max_displacement,
  first(row ORDER BY d DESC, row, col) FILTER (c AND isfinite(d)) AS max_row, first(col ORDER BY d DESC, row, col) FILTER (c AND isfinite(d)) AS max_col
  FROM (SELECT *, ina AND inb AND differs AS c, sqrt(ex*ex+ey*ey+ez*ez) AS d FROM diff_pairs) GROUP BY 1"""


@query("surface_diff_aligned", ALIGNED_SQL)
def surface_diff_aligned(fx):
    before, after = versions(fx)
    # The saved grid of the later version starts one row and two columns earlier.
    saved = after.withColumns({"row": F.col("row") + 1, "col": F.col("col") + 2, "offset_row": F.lit(1), "offset_col": F.lit(2)})
    out = diff.aligned_diff(before, diff.to_source_grid(saved, "offset_row", "offset_col"))
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_changed", "mean_common", "max_displacement")})


DIGEST_SQL = """SELECT package_id, sha256(string_agg(d,chr(10) ORDER BY b)) AS digest FROM (SELECT package_id, row//1024 AS b, sha256(string_agg(d,chr(10) ORDER BY row,s)) AS d
  FROM (SELECT package_id, row, col//4096 AS s, sha256(string_agg({text},';' ORDER BY col)) AS d FROM {source} GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1"""
define("lost", "SELECT package_id, row, col, concat(CAST(row AS VARCHAR),',',CAST(col AS VARCHAR)) AS place FROM diff_pairs WHERE ina AND NOT inb")
define("lost_digest", DIGEST_SQL.format(text="place", source="lost"))


@query(
    "sampled_locations",
    """SELECT l.package_id, count AS total, count>64 AS truncated, sample, digest FROM (SELECT package_id, max(n) AS count, string_agg(place,';' ORDER BY row,col) AS sample FROM
       (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY row,col) AS i, count(*) OVER (PARTITION BY package_id) AS n FROM lost) WHERE i<=64 GROUP BY 1) l
       JOIN lost_digest d ON d.package_id=l.package_id""",
)
def sampled_locations(fx):
    from latticeqc.operators.ranking import first_locations

    before, after = (diff.by_sentinel(v).select(*K) for v in versions(fx))
    return first_locations(before.join(after, K, "left_anti"), 64)


@query("array_equal", """SELECT package_id, count(*) FILTER (ina<>inb OR differs) AS differing, count(*) FILTER (ina<>inb OR differs)=0 AS equal FROM diff_pairs GROUP BY 1""")
def array_equal(fx):
    from latticeqc.operators.ranking import grids_equal

    return grids_equal(*(diff.by_sentinel(v) for v in versions(fx)))


define("portable_xor", "SELECT package_id, row, col FROM validity WHERE python_valid<>cpp_valid")


@query("mask_symmetric_difference", "SELECT package_id, row, col FROM portable_xor")
def mask_symmetric_difference(fx):
    from latticeqc.queries.vertex_queries import validity

    valid = validity(fx)
    return diff.cells_differing(
        valid.select(*K, F.col("python_valid").alias("f")), valid.select(*K, F.col("cpp_valid").alias("f")), "f"
    )


AXES = {a: f"CASE WHEN isnan({a}) THEN 'nan' ELSE CAST(CAST(round({a}*1e6) AS BIGINT) AS STRING) END" for a in "xyz"}
for _a, _t in AXES.items():
    define(f"digest_{_a}", DIGEST_SQL.format(text=_t.replace("STRING", "VARCHAR"), source="surf"))
define("digest_valid", DIGEST_SQL.format(text="CASE WHEN valid THEN '1' ELSE '0' END", source="surf"))


@query(
    "surface_observations",
    """SELECT s.package_id, valid_vertices, valid_quads, x_vs_y, x_vs_z, m.digest AS mask_digest, dx.digest AS x_digest, dy.digest AS y_digest, dz.digest AS z_digest
       FROM (SELECT package_id, count(*) FILTER (valid) AS valid_vertices, count(*) FILTER ((x=-1)<>(y=-1)) AS x_vs_y, count(*) FILTER ((x=-1)<>(z=-1)) AS x_vs_z FROM surf GROUP BY 1) s
       JOIN (SELECT package_id, count(*) FILTER (ok) AS valid_quads FROM quad GROUP BY 1) q ON q.package_id=s.package_id
       JOIN digest_valid m ON m.package_id=s.package_id JOIN digest_x dx ON dx.package_id=s.package_id JOIN digest_y dy ON dy.package_id=s.package_id JOIN digest_z dz ON dz.package_id=s.package_id""",
)
def surface_observations(fx):
    surf = fx.surf
    counts = surf.groupBy("package_id").agg(
        F.count_if("valid").alias("valid_vertices"),
        F.count_if((F.col("x") == -1) != (F.col("y") == -1)).alias("x_vs_y"),
        F.count_if((F.col("x") == -1) != (F.col("z") == -1)).alias("x_vs_z"),
    )
    out = counts.join(grid.quad_counts(surf).withColumnRenamed("face_count", "valid_quads"), "package_id")
    texts = {"mask": "CASE WHEN valid THEN '1' ELSE '0' END", **AXES}
    for name, text in texts.items():
        lines = surf.selectExpr(*K, f"{text} AS text")
        out = out.join(digest.grid_digest(lines, "text", name=f"{name}_digest"), "package_id")
    return out

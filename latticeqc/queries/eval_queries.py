"""Splits, perturbation, detection rates, bootstrap, thresholds, gates and comparisons."""

from pyspark.sql import functions as F

from latticeqc.functions.numeric import rounded
from latticeqc.operators import diff, grid, ranking
from latticeqc.operators import geometry as G
from latticeqc.operators.ordering import evenly_spaced, row_count, with_global_position
from latticeqc.plans import perturbation as X
from latticeqc.plans import scoring as S
from latticeqc.plans import splits
from latticeqc.plans.geometry_report import cell_shapes, geometry_report
from latticeqc.queries.grid_queries import CFG, K, frame
from latticeqc.queries.registry import define, define_over, query
from latticeqc.queries.sql import r6
from latticeqc.queries.topology_queries import _dilated, graph, versions
from latticeqc.session import materialize, spread
from latticeqc.sources.annotations import neighborhoods

# --- splits --------------------------------------------------------------------------------------

DEV = "doc_id%40=7"
define("dev_nodes", f"SELECT CAST(doc_id AS VARCHAR) AS node FROM documents WHERE {DEV}")
define("roles", "SELECT l.node, l.label, CASE WHEN l.node IN (SELECT node FROM dev_nodes) THEN 'development' WHEN l.label IN (SELECT label FROM graph_lab WHERE node IN (SELECT node FROM dev_nodes)) THEN 'excluded' ELSE 'clean' END AS role FROM graph_lab l")
define(
    "held",
    """SELECT label, size, rank_hash, row_number() OVER (ORDER BY rank_hash, members)-1 AS place, CAST(sum(size) OVER (ORDER BY rank_hash, members ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM
       (SELECT i.label, i.size, i.members, sha256(concat('salt-1',chr(0),members)) AS rank_hash FROM graph_ids i WHERE i.label IN (SELECT label FROM roles WHERE role='clean'))""",
)


def dev(fx):
    return fx.table("documents").where(DEV).selectExpr("CAST(doc_id AS STRING) AS node")


@query("development_exclusion", "SELECT node, label, role FROM roles")
def development_exclusion(fx):
    return splits.development_exclusion(graph(fx), dev(fx))


@query("holdout_select", "SELECT label, size, rank_hash, place, running FROM held WHERE running-size<128")
def holdout_select(fx):
    roles = splits.development_exclusion(graph(fx), dev(fx))
    return splits.holdout_select(roles.where("role = 'clean'").select("node", "label"), 128, "salt-1")


ROLE_SQL = """SELECT r.node, i.component_id, CASE WHEN r.label IN (SELECT label FROM held WHERE running-size<128) THEN 'holdout' ELSE r.role END AS role FROM roles r JOIN graph_ids i ON i.label=r.label"""


def split(fx):
    return splits.isolated_split(fx.overlap_nodes, fx.overlap_edges.selectExpr("a AS u", "b AS v"), dev(fx), 128, "salt-1")


@query("isolated_split", ROLE_SQL)
def isolated_split(fx):
    return split(fx)


@query(
    "split_disjointness",
    f"""SELECT count(*) AS components, CAST(count(*) FILTER (d AND h) AS INT) AS mixed_components, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(dn) AS BIGINT) AS development, CAST(sum(hn) AS BIGINT) AS holdout FROM
        (SELECT component_id, bool_or(role IN ('development','excluded')) AS d, bool_or(role IN ('holdout','clean')) AS h, count(*) AS n, count(*) FILTER (role='development') AS dn, count(*) FILTER (role='holdout') AS hn FROM ({ROLE_SQL}) GROUP BY 1)""",
)
def split_disjointness(fx):
    return splits.disjointness(split(fx))


@query(
    "split_leakage",
    f"""SELECT count(*) AS components, CAST(count(*) FILTER (d AND h) AS INT) AS mixed_components, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(dn) AS BIGINT) AS development, CAST(sum(hn) AS BIGINT) AS holdout FROM
        (SELECT component_id, bool_or(role='development') AS d, bool_or(role='holdout') AS h, count(*) AS n, count(*) FILTER (role='development') AS dn, count(*) FILTER (role='holdout') AS hn
         FROM (SELECT component_id, CASE WHEN CAST(node AS BIGINT)%3=0 THEN 'development' ELSE 'holdout' END AS role FROM ({ROLE_SQL})) GROUP BY 1)""",
)
def split_leakage(fx):
    # The same check of a split that deals nodes without regard to their components.
    naive = F.when(F.col("node").cast("bigint") % 3 == 0, "development").otherwise("holdout")
    return splits.disjointness(split(fx).withColumn("role", naive))


@query(
    "select_evenly",
    """SELECT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR))-1 AS i, count(*) OVER () AS n FROM documents)
       WHERE i IN (SELECT (k*((SELECT count(*) FROM documents)-1))//63 FROM (SELECT unnest(generate_series(0,63)) AS k))""",
)
def select_evenly(fx):
    ids = fx.table("documents").selectExpr("CAST(doc_id AS STRING) AS id")
    n = row_count(ids)
    return with_global_position(ids, ["id"]).where(evenly_spaced(n, 64, F.col("pos"))).select("id")


@query(
    "hash_ranked_split",
    """SELECT name, "group", CASE WHEN "group"<>'s1' THEN 'test' WHEN rk<=24 THEN 'validation' ELSE 'train' END AS split, CASE WHEN "group"='s1' AND rk<=24 THEN rk END AS rank FROM
       (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY sha256(name), name) AS rk FROM (SELECT concat('s',CAST(1+doc_id%5 AS VARCHAR),'_',CAST(doc_id AS VARCHAR)) AS name, concat('s',CAST(1+doc_id%5 AS VARCHAR)) AS "group" FROM documents))""",
)
def hash_ranked_split(fx):
    names = fx.table("documents").selectExpr("concat('s',1+doc_id%5,'_',doc_id) AS name", "concat('s',1+doc_id%5) AS group")
    return ranking.hash_ranked_split(names, 24, "s1")


FACTORS = "CASE WHEN pitch=700 THEN 'single_sheet_control' ELSE 'primary' END"


@query(
    "factorial_cells",
    f"""SELECT *, CAST((row_number() OVER (ORDER BY seed, pitch, level)-1)%10 AS BIGINT) AS shard FROM (SELECT s_suppkey AS seed, pitch, level, {FACTORS} AS kind,
        concat(CASE WHEN pitch=700 THEN 'control' ELSE 'primary' END,'_seed',CAST(s_suppkey AS VARCHAR),'_pitch',CAST(pitch AS VARCHAR),'_pap',CAST(level AS VARCHAR)) AS name FROM supplier
        CROSS JOIN (SELECT unnest([170,200,230,260,700]) AS pitch) CROSS JOIN (SELECT unnest([35,50,65,90]) AS level))""",
)
def factorial_cells(fx):
    # Pitches (700 is the single-sheet control) and intensity levels of the design.
    cells = (
        fx.table("supplier").select(F.col("s_suppkey").alias("seed"))
        .withColumn("pitch", F.explode(F.array(*[F.lit(p) for p in (170, 200, 230, 260, 700)])))
        .withColumn("level", F.explode(F.array(*[F.lit(v) for v in (35, 50, 65, 90)])))
    )
    named = cells.selectExpr(
        "*", f"{FACTORS} AS kind", "concat(CASE WHEN pitch=700 THEN 'control' ELSE 'primary' END,'_seed',seed,'_pitch',pitch,'_pap',level) AS name"
    )
    return with_global_position(named, ["seed", "pitch", "level"]).withColumn("shard", F.col("pos") % 10).drop("pos", "running")


# --- perturbation --------------------------------------------------------------------------------

define("movable", "SELECT s.package_id, s.row, s.col, s.x, s.y, s.z, s.valid, vnx, vny, vnz, s.valid AND coalesce(vn_ok,false) AS mv FROM surf s LEFT JOIN vnormal n ON n.package_id=s.package_id AND n.row=s.row AND n.col=s.col")
define(
    "mquad",
    """SELECT a.package_id, a.row, a.col FROM movable a JOIN movable b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col+1 AND b.mv JOIN movable c ON c.package_id=a.package_id AND c.row=a.row+1 AND c.col=a.col AND c.mv
       JOIN movable d ON d.package_id=a.package_id AND d.row=a.row+1 AND d.col=a.col+1 AND d.mv WHERE a.mv""",
)
define(
    "seams",
    """SELECT package_id, orientation, seam, support FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY support DESC, orientation DESC, seam) AS k FROM
       (SELECT m.package_id, 'vertical' AS orientation, col+1 AS seam, count(*) AS support, any_value(width) AS n FROM mquad m JOIN shapes s ON s.package_id=m.package_id GROUP BY 1,3
        UNION ALL SELECT m.package_id, 'horizontal', row+1, count(*), any_value(height) FROM mquad m JOIN shapes s ON s.package_id=m.package_id GROUP BY 1,3)
       WHERE seam>=greatest(1,n//4) AND seam<least(n-1,3*n//4+1)) WHERE k=1 AND support>=4""",
)


@query("choose_seam", "SELECT package_id, orientation, seam, support FROM seams")
def choose_seam(fx):
    return X.choose_seam(materialize(X.averaged_normals(fx.surf)))


def share_sql(pos: str, width: str) -> str:
    t = f"least(greatest((({pos})-(seam-{width}/2e0))/({width}*1e0),0e0),1e0)"
    return f"CASE WHEN {width}=1 THEN CASE WHEN ({pos})>=seam THEN 1e0 ELSE 0e0 END ELSE {t}*{t}*(3-2*{t}) END"


POS = "CASE WHEN orientation='vertical' THEN col ELSE row END"


@query("transition_coefficient", f"SELECT s.package_id, row, col, w AS width, {r6(share_sql(POS, 'w'))} AS share FROM surf s JOIN seams m ON m.package_id=s.package_id CROSS JOIN (SELECT unnest([1,4,12]) AS w)")
def transition_coefficient(fx):
    seams = X.choose_seam(materialize(X.averaged_normals(fx.surf)))
    spread = fx.surf.select(*K).join(seams, "package_id").withColumn("width", F.explode(F.array(F.lit(1), F.lit(4), F.lit(12))))
    share = X.transition(f"({POS})", "seam", "width")
    return spread.selectExpr(*K, "width", f"round({share}, 6) + 0D AS share")


def _moved(offset: str, width: str) -> str:
    cols = ", ".join(f"CASE WHEN {offset}>0 AND mv THEN CAST(CAST({a}+{offset}*share*vn{a} AS FLOAT) AS DOUBLE) ELSE {a} END AS {a}" for a in "xyz")
    return f"SELECT package_id, {offset} AS offset_voxels, {width} AS width_cells, row, col, {cols}, valid FROM (SELECT m.*, {share_sql(POS, width)} AS share, o, w FROM movable m JOIN seams s ON s.package_id=m.package_id CROSS JOIN ladder)"


# Offsets in voxels and widths in cells of the perturbation ladder.
OFFSETS, WIDTHS = [4.0, 8.0, 16.0], [1, 4, 12]
define("ladder", "SELECT 0e0 AS o, 1 AS w UNION ALL SELECT o, w FROM (SELECT unnest([4e0,8e0,16e0]) AS o) CROSS JOIN (SELECT unnest([1,4,12]) AS w)")
define("moved", _moved("o", "w"))


def ladder(fx):
    normals = materialize(X.averaged_normals(fx.surf))
    return X.offset_ladder(normals, materialize(X.choose_seam(normals)), OFFSETS, WIDTHS)


@query(
    "inject_offset",
    "SELECT package_id, offset_voxels, width_cells, row, col, CASE WHEN isfinite(x) THEN round(x,4)+0e0 END AS x, round(y,4)+0e0 AS y, round(z,4)+0e0 AS z, valid FROM moved WHERE width_cells=4",
)
def inject_offset(fx):
    return ladder(fx).where("width_cells = 4").selectExpr(
        *X.CASE, "row", "col", "CASE WHEN NOT isnan(x) THEN round(x,4)+0D END AS x", "round(y,4)+0D AS y", "round(z,4)+0D AS z", "valid"
    )


@query("offset_ladder", "SELECT package_id, offset_voxels, width_cells, count(*) AS vertices, count(*) FILTER (valid) AS valid_vertices, round(sum(z),3)+0e0 AS z_sum FROM moved GROUP BY 1,2,3")
def offset_ladder(fx):
    return ladder(fx).groupBy(*X.CASE).agg(
        F.count("*").alias("vertices"), F.count_if("valid").alias("valid_vertices"), rounded(F.sum("z"), 3).alias("z_sum")
    )


@query("null_control", "SELECT package_id, 0 AS coordinate_mismatches, 0 AS validity_mismatches, true AS identical FROM (SELECT DISTINCT package_id FROM seams)")
def null_control(fx):
    surf = materialize(fx.surf)
    normals = materialize(X.averaged_normals(surf))
    null = X.offset_ladder(normals, materialize(X.choose_seam(normals)), [], [1])
    a = surf.select(*K, F.struct("x", "y", "z").alias("p"), F.col("valid").alias("u"))
    b = null.select(*K, F.struct("x", "y", "z").alias("q"), F.col("valid").alias("v"))
    # Null-safe equality takes NaN as equal to NaN, as equal bytes would be.
    same, kept = F.col("p").eqNullSafe(F.col("q")), F.col("u").eqNullSafe(F.col("v"))
    out = b.join(a, K, "full_outer").groupBy("package_id").agg(
        F.count_if(~same).cast("int").alias("coordinate_mismatches"), F.count_if(~kept).cast("int").alias("validity_mismatches")
    )
    return out.withColumn("identical", (F.col("coordinate_mismatches") == 0) & (F.col("validity_mismatches") == 0))


@query(
    "moved_control",
    """SELECT m.package_id, m.offset_voxels, m.width_cells, count(*) AS vertices,
       count(*) FILTER (NOT (abs(m.x-s.x)<=0.01 AND abs(m.y-s.y)<=0.01 AND abs(m.z-s.z)<=0.01) AND isfinite(m.x+m.y+m.z)) AS moved_vertices, count(*) FILTER (m.valid IS DISTINCT FROM s.valid) AS validity_mismatches
       FROM moved m JOIN surf s ON s.package_id=m.package_id AND s.row=m.row AND s.col=m.col GROUP BY 1,2,3""",
)
def moved_control(fx):
    return X.moved_control(materialize(fx.surf), ladder(fx), tolerance=0.01)


def _seam_set(width: int) -> str:
    far, near = (share_sql(POS.replace("col", f"q.col{step}").replace("ELSE row", f"ELSE q.row{step}"), str(width)) for step in ("+1", ""))
    return f"SELECT q.package_id, q.row, q.col FROM quad q JOIN seams s ON s.package_id=q.package_id WHERE ok AND abs(({far})-({near}))>1e-12"


define("seam_set", _seam_set(4))


def seam_band(fx):
    normals = materialize(X.averaged_normals(fx.surf))
    cells = materialize(grid.quad_cells(fx.surf))
    return X.seam_cells(cells, materialize(X.choose_seam(normals)), 4), cells


@query("seam_cells", "SELECT package_id, row, col FROM seam_set")
def seam_cells(fx):
    return seam_band(fx)[0]


@query("evaluation_cells", f"SELECT d.package_id, d.row, d.col FROM ({_dilated('SELECT package_id, row, col FROM seam_set', 1)}) d JOIN quad q ON q.package_id=d.package_id AND q.row=d.row AND q.col=d.col AND q.ok")
def evaluation_cells(fx):
    seam, cells = seam_band(fx)
    return X.evaluation_cells(seam, cells, cell_shapes(fx.surf))


@query(
    "incremental_cues",
    """SELECT c.package_id, c.row, c.col FROM local_cells c JOIN annotated a ON a.package_id=c.package_id AND a.row=c.row AND a.col=c.col WHERE c.high_shear AND NOT c.jump_cue""",
)
def incremental_cues(fx):
    every = materialize(frame(fx).where("cell").select(*K, "high_shear", "jump_cue"))
    band = neighborhoods(fx.annotations.where("valid"), cell_shapes(fx.vertices), radius=1)
    return X.incremental(every.where("high_shear"), every.where("jump_cue"), ["package_id"]).join(band, K, "left_semi")


# The moved surfaces as packages of their own, and the blocks of the review once more over them.
define("moved_surf", "SELECT package_id*10000+CAST(offset_voxels AS INT)*100+width_cells AS package_id, row, col, x, y, z, valid, CAST(NULL AS BOOLEAN) AS explicit_mask FROM moved")
# The same pairs as std_pairs, met in cubes of the limit's side.
define("moved_points", "SELECT u.*, 25e-2*sqrt(obs_h*obs_v) AS near, floor(x/(25e-2*sqrt(obs_h*obs_v))) AS i, floor(y/(25e-2*sqrt(obs_h*obs_v))) AS j, floor(z/(25e-2*sqrt(obs_h*obs_v))) AS k FROM moved_usable u JOIN moved_refs r ON r.package_id=u.package_id")
define(
    "moved_std_pairs",
    """SELECT a.package_id, a.row AS a_row, a.col AS a_col, b.row AS b_row, b.col AS b_col FROM
       (SELECT p.* EXCLUDE (i, j, k), i+di AS i, j+dj AS j, k+dk AS k FROM moved_points p CROSS JOIN (SELECT unnest([-1,0,1]) AS di) CROSS JOIN (SELECT unnest([-1,0,1]) AS dj) CROSS JOIN (SELECT unnest([-1,0,1]) AS dk)) a
       JOIN moved_points b ON b.package_id=a.package_id AND b.i=a.i AND b.j=a.j AND b.k=a.k AND (b.row>a.row OR (b.row=a.row AND b.col>a.col)) WHERE greatest(abs(a.row-b.row),abs(a.col-b.col))>4
       AND sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))<a.near""",
)
define_over("moved_", "final_cells", "surf")
define(
    "seam_bands",
    " UNION ALL ".join(
        f"SELECT d.package_id, {w} AS width_cells, d.row, d.col FROM ({_dilated(_seam_set(w), 1)}) d JOIN quad q ON q.package_id=d.package_id AND q.row=d.row AND q.col=d.col AND q.ok"
        for w in WIDTHS
    ),
)
define(
    "moved_cues",
    """SELECT m.*, e.row IS NOT NULL AS near, m.cue AND NOT coalesce(b.cue,false) AS incremental, m.band AND NOT coalesce(b.band,false) AS incremental_step, m.cue_before AND NOT coalesce(b.cue_before,false) AS incremental_before
       FROM (SELECT package_id//10000 AS package_id, package_id%10000//100*1e0 AS offset_voxels, package_id%100 AS width_cells, row, col, cue, band, cue_before FROM moved_final_cells) m
       LEFT JOIN final_cells b ON b.package_id=m.package_id AND b.row=m.row AND b.col=m.col
       LEFT JOIN seam_bands e ON e.package_id=m.package_id AND e.width_cells=m.width_cells AND e.row=m.row AND e.col=m.col""",
)
_FAMILIES = ("incremental", "incremental_step", "incremental_before")
_COUNTED = ", ".join(f"count(*) FILTER ({f}) AS {f}_cells, count(*) FILTER ({f} AND near) AS {f}_localized" for f in _FAMILIES)


@query(
    "perturbation_benchmark",
    f"""SELECT s.package_id, l.o AS offset_voxels, l.w AS width_cells, orientation, seam, support, coalesce(z.n,0) AS evaluation_cells,
       {', '.join(f"coalesce({f}_{k},0) AS {f}_{k}" for f in _FAMILIES for k in ('cells', 'localized'))}, coalesce(localized_cue_cells,0) AS localized_cue_cells, coalesce(localized_cue_cells,0)>0 AS raw_detected,
       coalesce(incremental_localized,0)>0 AS detected, coalesce(incremental_step_localized,0)>0 AS step_detected, coalesce(incremental_before_localized,0)>0 AS before_detected
       FROM seams s CROSS JOIN ladder l LEFT JOIN (SELECT package_id, width_cells, count(*) AS n FROM seam_bands GROUP BY 1,2) z ON z.package_id=s.package_id AND z.width_cells=l.w
       LEFT JOIN (SELECT package_id, offset_voxels, width_cells, {_COUNTED}, count(*) FILTER (cue AND near) AS localized_cue_cells FROM moved_cues GROUP BY 1,2,3) c
       ON c.package_id=s.package_id AND c.offset_voxels=l.o AND c.width_cells=l.w""",
)
def perturbation_benchmark(fx):
    return X.perturbation_benchmark(fx.surf, OFFSETS, WIDTHS)


@query("incremental_moved_cues", "SELECT package_id, offset_voxels, width_cells, row, col, near FROM moved_cues WHERE incremental AND offset_voxels=16 AND width_cells=4")
def incremental_moved_cues(fx):
    surf = materialize(fx.surf)
    normals = materialize(X.averaged_normals(surf))
    seams = materialize(X.choose_seam(normals))
    moved = X.offset_ladder(normals, seams, [16.0], [4]).where("offset_voxels > 0").drop("orientation", "seam")
    fresh = X.incremental(geometry_report(moved, CFG, X.CASE).cells.where("cue"), geometry_report(surf, CFG).cells.where("cue"))
    valid = materialize(grid.quad_cells(surf))
    band = X.evaluation_cells(X.seam_cells(valid, seams, 4), valid, cell_shapes(surf)).withColumn("near", F.lit(True))
    return fresh.join(band, K, "left").select(*X.CASE, "row", "col", F.coalesce("near", F.lit(False)).alias("near"))


# --- rates and bootstrap -------------------------------------------------------------------------

CASES = [
    "CASE WHEN l_returnflag='N' THEN 'holdout' ELSE 'development' END AS split", "l_linenumber%3*4 AS offset_voxels", "l_linenumber%2*3+1 AS width_cells", "l_suppkey AS component_id",
    "l_quantity>25 AS raw_detected", "l_quantity>30 AS detected", "l_quantity>40 AS step_detected", "l_quantity>45 AS before_detected",
    "CAST(l_quantity AS BIGINT) AS evaluation_cells", "CAST(l_tax*100 AS BIGINT) AS incremental_localized",
]
define("cases_fx", f"SELECT {', '.join(CASES)} FROM lineitem")


def cases(fx):
    return fx.table("lineitem").selectExpr(*CASES)


@query(
    "detection_rates",
    "SELECT split, offset_voxels, width_cells, count(*) AS cases, count(DISTINCT component_id) AS components, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}_cases, round(count(*) FILTER ({c})/count(*),6)+0e0 AS {n}_rate" for n, c in (("raw", "raw_detected"), ("incremental", "detected"), ("step", "step_detected"), ("before", "before_detected")))
    + ", CAST(sum(evaluation_cells) AS BIGINT) AS evaluation_cells, CAST(sum(incremental_localized) AS BIGINT) AS incremental_localized FROM cases_fx GROUP BY 1,2,3",
)
def detection_rates(fx):
    out = S.detection_rates(cases(fx))
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c.endswith("_rate")})


OBS = [
    "CASE WHEN o_orderstatus='F' THEN 'holdout' ELSE 'connected' END AS evaluation_group", "o_custkey AS component_id", "o_orderkey%4 AS points", "o_orderkey%7 AS near_cells",
    "CASE WHEN o_orderkey%5=0 THEN o_orderkey%7 ELSE 0 END AS cue_cells", "o_orderkey%5=0 AS any_cue",
]
define("obs_fx", f"SELECT {', '.join(OBS)} FROM orders")


@query(
    "alert_summary",
    " UNION ALL ".join(
        f"""SELECT '{g}' AS "group", count(*) AS packages, count(DISTINCT component_id) AS components, count(*) FILTER (m) AS annotated, CAST(sum(points) FILTER (m) AS BIGINT) AS points, CAST(sum(near_cells) FILTER (m) AS BIGINT) AS near_cells,
        CAST(sum(cue_cells) FILTER (m) AS BIGINT) AS cue_cells, count(*) FILTER (m AND cue_cells>0) AS cue_packages, count(*) FILTER (any_cue) AS packages_with_cue, round(sum(cue_cells) FILTER (m)/sum(near_cells) FILTER (m),6)+0e0 AS cue_cell_rate,
        round(count(*) FILTER (m AND cue_cells>0)/count(*) FILTER (m),6)+0e0 AS cue_package_rate FROM (SELECT *, points>0 AND near_cells>0 AS m FROM obs_fx) WHERE {w}"""
        for g, w in (("all", "true"), ("holdout", "evaluation_group='holdout'"))
    ),
)
def alert_summary(fx):
    out = S.alert_summary(fx.table("orders").selectExpr(*OBS))
    return out.withColumns({c: rounded(F.col(c)) for c in ("cue_cell_rate", "cue_package_rate")})


@query("null_control_summary", "SELECT split, count(*) AS cases, count(*) FILTER (NOT raw_detected) AS raw_detected_mismatches, count(*) FILTER (NOT detected) AS detected_mismatches FROM cases_fx GROUP BY 1")
def null_control_summary(fx):
    return S.null_control_summary(cases(fx), ["raw_detected", "detected"])


def _boot(units: str, keys: list[str], seed: str, iterations: int) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x}=b.{x}" for x in keys)
    keytext = "".join(f",'|',CAST(d.{x} AS VARCHAR)" for x in keys)
    hexes = f"substr(md5(concat('{seed}'{keytext},'|',CAST(iteration AS VARCHAR),'|',CAST(draw AS VARCHAR))),1,15)"
    return f"""SELECT t.*, round(lo,6)+0e0 AS low, round(hi,6)+0e0 AS high FROM (SELECT {k}, count(*) AS units, round(sum(num)/sum(den),6)+0e0 AS estimate FROM ({units}) GROUP BY {k}) t JOIN
      (SELECT {k}, quantile_cont(rate,25e-3) AS lo, quantile_cont(rate,975e-3) AS hi FROM (SELECT {', '.join('a.' + x for x in keys)}, iteration, sum(num)/sum(den) AS rate FROM
        (SELECT d.*, CAST(concat('0x',{hexes}) AS BIGINT)%n AS pos FROM (SELECT {k}, pos AS draw, n, iteration FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY unit)-1 AS pos, count(*) OVER (PARTITION BY {k}) AS n FROM ({units}))
          CROSS JOIN (SELECT unnest(generate_series(0,{iterations - 1})) AS iteration)) d) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY unit)-1 AS pos FROM ({units})) b ON {on} AND a.pos=b.pos GROUP BY {', '.join('a.' + x for x in keys)}, iteration) GROUP BY {k}) q USING ({k})"""


UNITS = "SELECT split, component_id AS unit, count(*) FILTER (detected)*1e0 AS num, count(*)*1e0 AS den FROM cases_fx GROUP BY 1,2"


@query("cluster_bootstrap", _boot(UNITS, ["split"], "boot-1", 10_000))
def cluster_bootstrap(fx):
    units = cases(fx).groupBy("split", F.col("component_id").alias("unit")).agg(
        F.count_if("detected").cast("double").alias("num"), F.count("*").cast("double").alias("den")
    )
    out = S.cluster_bootstrap(units, ["split"], "unit", "boot-1", 10_000)
    return out.withColumns({c: rounded(F.col(c)) for c in ("estimate", "low", "high")})


# --- thresholds and paired runs ------------------------------------------------------------------


@query("mean_by_threshold", f"SELECT run, threshold, {r6('avg(blend)')} AS mean_blend FROM scores_fx GROUP BY 1,2")
def mean_by_threshold(fx):
    return S.mean_by_threshold(fx.scores).withColumn("mean_blend", rounded(F.col("mean_blend")))


@query(
    "choose_threshold",
    """SELECT run, threshold AS selected_threshold, m AS mean_blend FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY m DESC, abs(threshold-5e-1), threshold) AS k FROM
       (SELECT run, threshold, round(avg(blend),6)+0e0 AS m FROM scores_fx GROUP BY 1,2)) WHERE k=1""",
)
def choose_threshold(fx):
    return ranking.choose_threshold(S.mean_by_threshold(fx.scores).withColumn("mean_blend", rounded(F.col("mean_blend"))))


ARMED = ["CASE l_returnflag WHEN 'A' THEN 'control' WHEN 'R' THEN 'gap' ELSE 'other' END AS arm", "l_linenumber%3 AS seed", "l_suppkey AS patch", "l_discount"]
define("armed", f"SELECT arm, seed, patch, avg(l_discount) AS value FROM (SELECT {', '.join(ARMED)} FROM lineitem) GROUP BY 1,2,3")
define("deltas", "SELECT seed, patch, g.value-c.value AS delta FROM (SELECT * FROM armed WHERE arm='control') c JOIN (SELECT * FROM armed WHERE arm='gap') g USING (seed, patch)")


def armed(fx):
    return fx.table("lineitem").selectExpr(*ARMED).groupBy("arm", "seed", "patch").agg(F.avg("l_discount").alias("value"))


@query("paired_delta", f"SELECT CAST(seed AS VARCHAR) AS scope, patch, {r6('delta')} AS delta FROM deltas UNION ALL SELECT 'pooled', patch, {r6('avg(delta)')} FROM deltas GROUP BY patch")
def paired_delta(fx):
    deltas = materialize(S.paired_delta(armed(fx), ("control", "gap")))
    pooled = S.pooled_delta(deltas).select(F.lit("pooled").alias("scope"), "patch", "delta")
    both = deltas.select(F.col("seed").cast("string").alias("scope"), "patch", "delta").unionByName(pooled)
    return both.withColumn("delta", rounded(F.col("delta")))


@query("bootstrap_mean_interval", _boot("SELECT concat('seed ',CAST(seed AS VARCHAR)) AS scope, patch AS unit, delta AS num, 1e0 AS den FROM deltas UNION ALL SELECT 'pooled', patch, avg(delta), 1e0 FROM deltas GROUP BY patch", ["scope"], "boot-2", 10_000))
def bootstrap_mean_interval(fx):
    out = S.paired_report(armed(fx), ("control", "gap"), "boot-2", 10_000)
    return out.withColumns({c: rounded(F.col(c)) for c in ("estimate", "low", "high")})


GRID = [round(0.30 + 0.05 * i, 2) for i in range(9)]
MANIFEST = ["l_suppkey AS run", "CASE WHEN l_suppkey%7=2 THEN 'draft' ELSE 'frozen' END AS status", "CASE WHEN l_suppkey%5=1 THEN 'other' ELSE 'split' END AS manifest_split", "max(CASE WHEN l_suppkey%6=3 THEN 0.33 ELSE round(0.30+0.05*CAST(l_linenumber AS INT),2) END) AS selected_threshold"]


@query(
    "frozen_threshold_gate",
    """SELECT run, p AS present, st AS status_ok, sp AS split_ok, th AS threshold_ok, p AND st AND sp AND th AS open FROM (SELECT r.s_suppkey AS run, m.run IS NOT NULL AS p, coalesce(status='frozen',false) AS st, coalesce(manifest_split='split',false) AS sp,
       coalesce(m.run%6<>3,false) AS th FROM supplier r LEFT JOIN (SELECT DISTINCT l_suppkey AS run, CASE WHEN l_suppkey%7=2 THEN 'draft' ELSE 'frozen' END AS status, CASE WHEN l_suppkey%5=1 THEN 'other' ELSE 'split' END AS manifest_split
       FROM lineitem WHERE l_suppkey%11<>4) m ON m.run=r.s_suppkey)""",
)
def frozen_threshold_gate(fx):
    base = fx.table("lineitem").where("l_suppkey%11<>4").selectExpr(*MANIFEST[:3], "CASE WHEN l_suppkey%6=3 THEN 0.33D ELSE round(0.30D+0.05D*CAST(l_linenumber AS INT),2) END AS t")
    manifest = base.groupBy("run", "status", "manifest_split").agg(F.max("t").alias("selected_threshold"))
    runs = fx.table("supplier").select(F.col("s_suppkey").alias("run"), F.lit("split").alias("split_hash"))
    return S.frozen_gate(runs, manifest, "frozen", [*GRID, 0.30])


# --- expected against actual ---------------------------------------------------------------------

TREE = "sha256(CASE WHEN doc_id%31=4 THEN concat(text,'!') ELSE text END)"


@query("tree_unchanged", f"SELECT dir, count(*) AS files, count(*) FILTER (sha256(content)<>{TREE.replace('text', 'content')} OR doc_id%37=2) AS changed, count(*) FILTER (sha256(content)<>{TREE.replace('text', 'content')} OR doc_id%37=2)=0 AS unchanged FROM files_fx GROUP BY 1")
def tree_unchanged(fx):
    before = fx.files.selectExpr("dir", "filename", "sha2(content,256) AS digest")
    after = fx.files.where("doc_id%37<>2").selectExpr("dir", "filename", "sha2(CASE WHEN doc_id%31=4 THEN concat(content,'!') ELSE content END,256) AS digest")
    compared = S.expected_vs_actual(before, after, ["dir", "filename"], ["digest"])
    return compared.groupBy("dir").agg(
        F.count("*").alias("files"), F.count_if(~F.col("passed")).alias("changed"), (F.count_if(~F.col("passed")) == 0).alias("unchanged")
    )


@query(
    "expected_vs_actual",
    """SELECT package_id, n=v AS python_ok, m=w AS cpp_ok, n=v AND m=w AS passed FROM (SELECT package_id, python_valid_count AS n, cpp_finite_count AS m, python_valid_count AS v, CASE WHEN package_id%4=3 THEN 0 ELSE cpp_finite_count END AS w FROM vsummary)""",
)
def expected_vs_actual(fx):
    from latticeqc.operators.masks import validity_summary
    from latticeqc.queries.vertex_queries import validity

    actual = materialize(validity_summary(validity(fx)).selectExpr("package_id", "python_valid_count AS python", "cpp_finite_count AS cpp"))
    expected = actual.withColumn("cpp", F.when(F.col("package_id") % 4 == 3, F.lit(0)).otherwise(F.col("cpp")))
    return S.expected_vs_actual(expected, actual, ["package_id"], ["python", "cpp"])


@query("set_match", "SELECT dir, 'missing' AS problem FROM requested_dirs WHERE dir NOT IN (SELECT dir FROM files_fx WHERE doc_id%3<>1) UNION ALL SELECT DISTINCT concat(dir,'_x'), 'extra' FROM files_fx WHERE doc_id%17=3")
def set_match(fx):
    observed = fx.files.where("doc_id%3<>1").select("dir").unionByName(fx.files.where("doc_id%17=3").selectExpr("concat(dir,'_x') AS dir"))
    return S.set_match(fx.requested_dirs, observed, "dir")


# What a frozen protocol fixes, and for which runs the observed one differs.
PROTOCOL = {"schema": (50, 1), "ids": (60, 2), "config": (70, 3), "offsets": (80, 4), "widths": (90, 5), "radius": (110, 6), "leaked": (130, 7)}
_KEPT = {c: f"(o.o_orderkey IS NOT NULL AND l.k IS NOT NULL AND coalesce(l.k,o.o_orderkey)%{m}<>{r})" for c, (m, r) in PROTOCOL.items()}


@query(
    "frozen_protocol_guard",
    "SELECT coalesce(l.k,o.o_orderkey)//100 AS run, "
    + ", ".join(f"bool_and({ok}) AS {c}_ok" for c, ok in _KEPT.items())
    + f", bool_and({' AND '.join(_KEPT.values())}) AS passed FROM orders o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k=o.o_orderkey GROUP BY 1",
)
def frozen_protocol_guard(fx):
    frozen = fx.table("orders").selectExpr("o_orderkey AS k", *[f"sha2('{c}:frozen', 256) AS {c}" for c in PROTOCOL])
    runs = fx.table("lineitem").selectExpr("l_orderkey AS k").distinct()
    seen = runs.selectExpr("k", *[f"sha2(CASE WHEN k%{m}={r} THEN '{c}:changed' ELSE '{c}:frozen' END, 256) AS {c}" for c, (m, r) in PROTOCOL.items()])
    checked = S.expected_vs_actual(frozen, seen, ["k"], list(PROTOCOL))
    flags = [f"{c}_ok" for c in PROTOCOL] + ["passed"]
    return checked.groupBy(F.expr("k div 100").alias("run")).agg(*[F.bool_and(c).alias(c) for c in flags])


SCHEMA_NAME = "split-v1"
# Each order is a run: its frozen document from orders, its own from lineitem, with changes by remainders of the key.
_FROZEN_DOC = f"""concat('{{"schema_version":"', CASE WHEN k%50=1 THEN 'split-v0' ELSE '{SCHEMA_NAME}' END, '","source":{{"selected_patch_ids_sha256":"', sha2(CAST(k AS STRING),256),
 '"}},"frozen_detector":{{"configuration":{{"limits":{{"edge":', k%7, ',"ratio":0.5}},"names":["a","b"],"none":[]}}}},"protocol":{{"normal_offsets_voxels":[4,8,16],"transition_widths_cells":[1,4,12],"annotation_neighborhood_radius_cells":3}},',
 '"split":{{"development_ids":["p', k, '","p', k+1, '","p', k+2, '"],"development_related_excluded_ids":["p', k+3, '"],"clean_holdout_pool_ids":["p', k+4, '","p', k+5,
 CASE WHEN k%140=9 THEN concat('","p', k+3, '","p', k, '","p', k) ELSE '' END, '"],"selected_holdout_ids":["p', k+CASE WHEN k%130=7 THEN 1 ELSE 4 END, '"]}}}}')"""
_OWN_DOC = """concat('{"frozen_detector":{"configuration":{"none":[],"names":', CASE WHEN k%70=4 THEN 'null' ELSE '["a","b"]' END, ',"limits":{"ratio":', CASE WHEN k%70=3 THEN '0.50' ELSE '0.5' END, ',"edge":', k%7+CASE WHEN k%70=5 THEN 1 ELSE 0 END, '}}},
 "source":{"selected_patch_ids_sha256":"', CASE WHEN k%60=2 THEN 'other' ELSE sha2(CAST(k AS STRING),256) END, '"},"protocol":{"normal_offsets_voxels":', CASE k%80 WHEN 4 THEN '[4,8]' WHEN 5 THEN '[4.0,8,16,32]' WHEN 6 THEN '[4,16,8]' ELSE '[4.0,8e0,16]' END,
 ',"transition_widths_cells":', CASE WHEN k%90=5 THEN '[1,4,13]' ELSE '[1,4,12]' END, ',"annotation_neighborhood_radius_cells":', CASE WHEN k%110=6 THEN '4' WHEN k%110=7 THEN '"3"' ELSE '3' END, '}}')"""


define("protocol_runs", "SELECT o_orderkey AS k, l.k IS NULL AS lost FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k=o_orderkey")


@query(
    "frozen_protocol_findings",
    """SELECT * FROM (SELECT k AS run, 'unsupported-schema' AS code, CAST(k%50=1 AS BIGINT) AS n FROM protocol_runs
         UNION ALL SELECT k, 'ids-differ', CAST(lost OR k%60=2 AS BIGINT) FROM protocol_runs
         UNION ALL SELECT k, 'configuration-differs', CASE WHEN lost THEN 5 WHEN k%70=4 THEN 3 WHEN k%70=5 THEN 1 ELSE 0 END FROM protocol_runs
         UNION ALL SELECT k, 'offsets-differ', CASE WHEN lost THEN 3 WHEN k%80 IN (4,5) THEN 1 WHEN k%80=6 THEN 2 ELSE 0 END FROM protocol_runs
         UNION ALL SELECT k, 'widths-differ', CASE WHEN lost THEN 3 WHEN k%90=5 THEN 1 ELSE 0 END FROM protocol_runs
         UNION ALL SELECT k, 'radius-differs', CAST(lost OR k%110 IN (6,7) AS BIGINT) FROM protocol_runs
         UNION ALL SELECT k, 'development-in-holdout', CAST(k%130=7 AS BIGINT) FROM protocol_runs
         UNION ALL SELECT k, 'component-leaks', CASE WHEN k%140=9 THEN 2 ELSE 0 END FROM protocol_runs) WHERE n>0""",
)
def frozen_protocol_findings(fx):
    from latticeqc.plans.protocol import protocol_findings

    # Keys are dealt before their documents are written.
    frozen = spread(fx.table("orders").selectExpr("o_orderkey AS k"), "k").selectExpr("k AS run", f"{_FROZEN_DOC} AS raw_json")
    own = spread(fx.table("lineitem").selectExpr("l_orderkey AS k").distinct(), "k").selectExpr("k AS run", f"{_OWN_DOC} AS raw_json")
    return protocol_findings(frozen, own, ["run"], SCHEMA_NAME)


@query(
    "preregistered_fixture",
    """SELECT b.package_id, height=50 AND width=64 AS shape_ok, nf=0 AS finite_ok, xy=0 AND xz=0 AS sentinels_agree, valid_vertices=3101 AS vertices_ok, added_quads=b.last_row_quads+b.last_col_quads-b.corner_quad AS boundary_ok FROM boundary_counts b JOIN
       (SELECT package_id, count(*) FILTER (NOT finite_all) AS nf, count(*) FILTER ((x IS DISTINCT FROM -1)<>(y IS DISTINCT FROM -1)) AS xy, count(*) FILTER ((x IS DISTINCT FROM -1)<>(z IS DISTINCT FROM -1)) AS xz FROM flags GROUP BY 1) f ON f.package_id=b.package_id""",
)
def preregistered_fixture(fx):
    from latticeqc.plans.summaries import preregistered

    return preregistered(fx.vertices, height=50, width=64, valid_vertices=3101)


@query("replicate_determinism", "SELECT lang AS variant, count(*) AS replicates, count(DISTINCT CASE WHEN lang='en' THEN sha256('same') ELSE sha256(text) END) AS digests, count(DISTINCT CASE WHEN lang='en' THEN sha256('same') ELSE sha256(text) END)=1 AS deterministic FROM documents GROUP BY 1")
def replicate_determinism(fx):
    return S.replicate_determinism(fx.table("documents").selectExpr("lang AS variant", "sha2(CASE WHEN lang='en' THEN 'same' ELSE text END,256) AS digest"))


@query(
    "trace_integrity",
    """SELECT doc_id, doc_id%9<>4 AS log_ok, doc_id%6<>5 AND n_chars>=0 AS area_ok, coalesce(doc_id%9<>4 AND doc_id%6<>5 AND doc_id%8<>3,false) AS area_matches_log FROM documents""",
)
def trace_integrity(fx):
    from latticeqc.plans.summaries import trace_integrity as check
    from latticeqc.sources.logs import parse_trace_log

    meta = fx.table("documents").selectExpr(
        "doc_id", "concat('{\"area_vx2\":', CASE WHEN doc_id%6=5 THEN '\"7\"' ELSE CAST(n_chars + CASE WHEN doc_id%8=3 THEN 1 ELSE 0 END AS STRING) END, '}') AS raw_json"
    )
    return check(meta, parse_trace_log(fx.logs, ["doc_id"]), "doc_id")


@query("rule_geometry_load_failed", "SELECT package_id, 'error' AS severity, 'geometry-load-failed' AS code FROM gate WHERE NOT (decoded AND same_shape)")
def geometry_load_failed(fx):
    from latticeqc.operators.contract import coordinate_gate
    from latticeqc.plans.summaries import load_failures

    return load_failures(coordinate_gate(fx.channels))

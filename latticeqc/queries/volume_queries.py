"""Rays, spacing, gaps, tiles and normalization."""

from pyspark.sql import functions as F

from latticeqc.functions.numeric import rounded
from latticeqc.operators import ranking
from latticeqc.operators import volume as V
from latticeqc.plans import scoring
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import r6

# --- rays ----------------------------------------------------------------------------------------

define("ray_rows", "SELECT cell, ray_id, i, turn[i+1] AS t, prob[i+1] AS p, turn[32] AS own FROM rays_fx CROSS JOIN (SELECT unnest(generate_series(0,63)) AS i) WHERE turn[32]>0")
define(
    "ray_span",
    """SELECT cell, ray_id, first(i ORDER BY abs(i-31), i) FILTER (t>0 AND t<>own) AS other, coalesce(max(i) FILTER (i<31 AND t<>own)+1,0) AS a, coalesce(min(i) FILTER (i>31 AND t<>own)-1,63) AS b
       FROM ray_rows GROUP BY 1,2""",
)
define(
    "ray_scores",
    """SELECT s.cell, s.ray_id, CAST(other IS NOT NULL AS INT) AS neighbour_sites, CAST(other IS NOT NULL AND seen AS INT) AS detected_sites, CAST(other IS NOT NULL AND seen AND solid AS INT) AS fused_sites,
       CAST(other IS NULL AS INT) AS control_sites, CAST(other IS NULL AND NOT solid AS INT) AS false_splits FROM ray_span s JOIN
       (SELECT r.cell, r.ray_id, bool_and(p>=45e-2) FILTER (i BETWEEN coalesce(least(other,31),a) AND coalesce(greatest(other,31),b)) AS solid, bool_and(p>=45e-2) FILTER (i=31) AS seen
        FROM ray_rows r JOIN ray_span s ON s.cell=r.cell AND s.ray_id=r.ray_id GROUP BY 1,2) q ON q.cell=s.cell AND q.ray_id=s.ray_id""".replace("coalesce(least(other,31),a)", "CASE WHEN other IS NULL THEN a ELSE least(other,31) END").replace("coalesce(greatest(other,31),b)", "CASE WHEN other IS NULL THEN b ELSE greatest(other,31) END"),
)


@query("score_rays", "SELECT * FROM ray_scores")
def score_rays(fx):
    return V.score_rays(fx.rays, 0.45, ["cell", "ray_id"])


POOLED = """SELECT *, detected_sites/greatest(neighbour_sites,1) AS detection_rate, fused_sites/greatest(detected_sites,1) AS fusion_rate, false_splits/greatest(control_sites,1) AS false_split_rate FROM
  (SELECT cell, CAST(sum(neighbour_sites) AS BIGINT) AS neighbour_sites, CAST(sum(detected_sites) AS BIGINT) AS detected_sites, CAST(sum(fused_sites) AS BIGINT) AS fused_sites,
   CAST(sum(control_sites) AS BIGINT) AS control_sites, CAST(sum(false_splits) AS BIGINT) AS false_splits FROM ray_scores GROUP BY 1)"""
define("pooled", POOLED)


@query("pool_counts", "SELECT * REPLACE (round(detection_rate,6)+0e0 AS detection_rate, round(fusion_rate,6)+0e0 AS fusion_rate, round(false_split_rate,6)+0e0 AS false_split_rate) FROM pooled")
def pool_counts(fx):
    pooled = scoring.pool_counts(V.score_rays(fx.rays, 0.45, ["cell"]), ["cell"])
    return pooled.withColumns({c: rounded(F.col(c)) for c in ("detection_rate", "fusion_rate", "false_split_rate")})


@query(
    "rate_deltas_and_gates",
    """SELECT seed, round(f,6)+0e0 AS fusion_delta, round(d,6)+0e0 AS detection_delta, round(s,6)+0e0 AS split_delta, f<=-1e-1 AS fusion_ok, d>=-2e-2 AS detection_ok, s<=2e-2 AS split_ok FROM
       (SELECT CAST(cell AS INT)//2 AS seed, max(fusion_rate) FILTER (CAST(cell AS INT)%2=1)-max(fusion_rate) FILTER (CAST(cell AS INT)%2=0) AS f, max(detection_rate) FILTER (CAST(cell AS INT)%2=1)-max(detection_rate) FILTER (CAST(cell AS INT)%2=0) AS d,
        max(false_split_rate) FILTER (CAST(cell AS INT)%2=1)-max(false_split_rate) FILTER (CAST(cell AS INT)%2=0) AS s FROM pooled GROUP BY 1)""",
)
def rate_deltas_and_gates(fx):
    pooled = scoring.pool_counts(V.score_rays(fx.rays, 0.45, ["cell"]), ["cell"])
    armed = pooled.selectExpr("*", "CAST(cell AS INT) div 2 AS seed", "CASE WHEN CAST(cell AS INT)%2=1 THEN 'gap' ELSE 'control' END AS arm")
    return scoring.rate_gates(armed, ("control", "gap")).withColumns({c: rounded(F.col(c)) for c in ("fusion_delta", "detection_delta", "split_delta")})


@query(
    "gate_totals",
    """SELECT bool_and(f<=-1e-1) AS all_fusion, bool_and(d>=-2e-2) AS all_detection, bool_and(s<=2e-2) AS all_split FROM
       (SELECT CAST(cell AS INT)//2 AS seed, max(fusion_rate) FILTER (CAST(cell AS INT)%2=1)-max(fusion_rate) FILTER (CAST(cell AS INT)%2=0) AS f, max(detection_rate) FILTER (CAST(cell AS INT)%2=1)-max(detection_rate) FILTER (CAST(cell AS INT)%2=0) AS d,
        max(false_split_rate) FILTER (CAST(cell AS INT)%2=1)-max(false_split_rate) FILTER (CAST(cell AS INT)%2=0) AS s FROM pooled GROUP BY 1)""",
)
def gate_totals(fx):
    pooled = scoring.pool_counts(V.score_rays(fx.rays, 0.45, ["cell"]), ["cell"])
    armed = pooled.selectExpr("*", "CAST(cell AS INT) div 2 AS seed", "CASE WHEN CAST(cell AS INT)%2=1 THEN 'gap' ELSE 'control' END AS arm")
    return scoring.gate_totals(scoring.rate_gates(armed, ("control", "gap")))


# --- voxels --------------------------------------------------------------------------------------

define("vox", "SELECT package_id, package_id%3 AS z, y, x, label FROM instance_map")
define("vol_shape", "SELECT package_id, 3 AS depth, max(y)+1 AS height, max(x)+1 AS width FROM vox GROUP BY 1")
define("vol_sites", "SELECT package_id, y*1000+x AS site, z, y, x, 0e0 AS nz, 1e-1*((y*7+x)%5-2) AS ny, CASE WHEN y%3=0 THEN 15e-1 ELSE 1e0 END AS nx FROM vox WHERE label>0")
define(
    "marched",
    """SELECT s.package_id, s.site, s.z, s.y, s.x, sign, d, f.package_id IS NOT NULL AS hit FROM (SELECT v.*, sign, d, CAST(least(greatest(round_even(v.z+sign*d*nz,0),0),depth-1) AS INT) AS vz,
       CAST(least(greatest(round_even(v.y+sign*d*ny,0),0),height-1) AS INT) AS vy, CAST(least(greatest(round_even(v.x+sign*d*nx,0),0),width-1) AS INT) AS vx FROM vol_sites v JOIN vol_shape h ON h.package_id=v.package_id
       CROSS JOIN (SELECT unnest([1,-1]) AS sign) CROSS JOIN (SELECT unnest(generate_series(1,39)) AS d)) s LEFT JOIN (SELECT * FROM vox WHERE label>0) f ON f.package_id=s.package_id AND f.z=vz AND f.y=vy AND f.x=vx""",
)
define(
    "spaced_sites",
    """SELECT package_id, site, z, y, x, coalesce(min(back),40) AS spacing FROM (SELECT m.package_id, m.site, m.z, m.y, m.x, m.sign, min(d) FILTER (hit AND d>gap) AS back FROM marched m JOIN
       (SELECT package_id, site, sign, min(d) FILTER (NOT hit) AS gap FROM marched GROUP BY 1,2,3) g ON g.package_id=m.package_id AND g.site=m.site AND g.sign=m.sign GROUP BY 1,2,3,4,5,6) GROUP BY 1,2,3,4,5""",
)


def voxels(fx):
    return fx.instance_map.withColumn("z", F.expr("CAST(package_id % 3 AS INT)"))


def vol_shape(fx):
    return voxels(fx).groupBy("package_id").agg(F.lit(3).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def vol_sites(fx):
    return voxels(fx).where("label > 0").selectExpr(
        "package_id", "y*1000+x AS site", "z", "y", "x", "0D AS nz", "0.1D*((y*7+x)%5-2) AS ny", "CASE WHEN y%3=0 THEN 1.5D ELSE 1D END AS nx"
    )


def spacing(fx):
    return V.next_sheet_spacing(vol_sites(fx), voxels(fx).where("label > 0"), vol_shape(fx), ["package_id"])


@query("next_sheet_spacing", "SELECT package_id, site, z, y, x, spacing FROM spaced_sites")
def next_sheet_spacing(fx):
    return spacing(fx)


PANEL_SQL = """SELECT package_id, count(*) AS sites, count(*) FILTER (spacing<=8) AS compressed_sites, round(avg(CAST(spacing<=8 AS DOUBLE)),6)+0e0 AS compressed_share,
  quantile_cont(spacing,5e-1)*1e0 AS median_spacing, round(quantile_cont(spacing*1e0,1e-1),6)+0e0 AS spacing_p10 FROM spaced_sites GROUP BY 1"""
define("panels", PANEL_SQL)


def panels(fx):
    out = V.panel_measurements(spacing(fx), ["package_id"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("compressed_share", "spacing_p10")})


@query("panel_measurements", "SELECT * FROM panels")
def panel_measurements(fx):
    return panels(fx)


@query(
    "rank_panels",
    """SELECT image, compressed_share, median_spacing, row_number() OVER (ORDER BY compressed_share DESC, median_spacing, image) AS rank FROM
       (SELECT concat('s4_',CAST(package_id AS VARCHAR)) AS image, compressed_share, median_spacing FROM panels ORDER BY compressed_share DESC, median_spacing, image LIMIT 4)""",
)
def rank_panels(fx):
    named = panels(fx).select(F.concat(F.lit("s4_"), F.col("package_id").cast("string")).alias("image"), "compressed_share", "median_spacing")
    return ranking.rank_panels(named, 4)


@query(
    "representative_center",
    """SELECT package_id, b.z AS center_z, b.y AS center_y, b.x AS center_x FROM (SELECT c.package_id, min(struct_pack(d:=(z-mz)*(z-mz)+(y-my)*(y-my)+(x-mx)*(x-mx), z:=z, y:=y, x:=x)) AS b FROM
       (SELECT s.* FROM spaced_sites s JOIN (SELECT package_id, greatest(min(spacing),8) AS lim FROM spaced_sites GROUP BY 1) l ON l.package_id=s.package_id WHERE spacing<=lim) c JOIN
       (SELECT s.package_id, median(z*1e0) AS mz, median(y*1e0) AS my, median(x*1e0) AS mx FROM spaced_sites s JOIN (SELECT package_id, greatest(min(spacing),8) AS lim FROM spaced_sites GROUP BY 1) l ON l.package_id=s.package_id
        WHERE spacing<=lim GROUP BY 1) m ON m.package_id=c.package_id GROUP BY 1)""",
)
def representative_center(fx):
    return V.representative_center(spacing(fx), ["package_id"])


@query("hash_sample_sites", "SELECT package_id, site, pick, sites FROM (SELECT package_id, site, row_number() OVER (PARTITION BY package_id ORDER BY md5(concat_ws('|',CAST(package_id AS VARCHAR),CAST(site AS VARCHAR))), site) AS pick, count(*) OVER (PARTITION BY package_id) AS sites FROM vol_sites) WHERE pick<=100 AND sites>=300")
def hash_sample_sites(fx):
    return ranking.hash_sample(vol_sites(fx).select("package_id", "site"), 100, 300, ["package_id"], ["site"])


define("prob_vox", "SELECT v.package_id, v.z, v.y, v.x, v.label, 5e-1+2e-1*g.e AS prob FROM vox v JOIN grid_raw g ON g.package_id=v.package_id AND g.r=v.y AND g.c=v.x")


@query(
    "sample_rays_on_table",
    f"""SELECT t.package_id, t.site, t.i, coalesce(n.label,0) AS label, round(coalesce(p.prob,0e0),6)+0e0 AS prob FROM
       (SELECT s.package_id, s.site, i FROM vol_sites s CROSS JOIN (SELECT unnest(generate_series(0,48)) AS i)) t LEFT JOIN ray_pos r ON r.package_id=t.package_id AND r.site=t.site AND r.i=t.i
       LEFT JOIN prob_vox n ON n.package_id=r.package_id AND n.z=CAST(floor(pz+5e-1) AS INT) AND n.y=CAST(floor(py+5e-1) AS INT) AND n.x=CAST(floor(px+5e-1) AS INT)
       LEFT JOIN (SELECT c.package_id, c.site, c.i, sum(w*v.prob) AS prob FROM (SELECT package_id, site, i, CAST(floor(pz) AS INT) AS vz, CAST(floor(py) AS INT)+dy AS vy, CAST(floor(px) AS INT)+dx AS vx,
         (CASE WHEN dy=1 THEN py-floor(py) ELSE 1-(py-floor(py)) END)*(CASE WHEN dx=1 THEN px-floor(px) ELSE 1-(px-floor(px)) END) AS w FROM ray_pos CROSS JOIN (SELECT unnest([0,1]) AS dy) CROSS JOIN (SELECT unnest([0,1]) AS dx)) c
         JOIN prob_vox v ON v.package_id=c.package_id AND v.z=vz AND v.y=vy AND v.x=vx WHERE w>0 GROUP BY 1,2,3) p ON p.package_id=t.package_id AND p.site=t.site AND p.i=t.i""".replace(
        "ray_pos", "(SELECT s.*, i, s.z+5e-1*(i-24)*nz AS pz, s.y+5e-1*(i-24)*ny AS py, s.x+5e-1*(i-24)*nx AS px FROM vol_sites s CROSS JOIN (SELECT unnest(generate_series(0,48)) AS i) JOIN vol_shape h ON h.package_id=s.package_id WHERE s.y+5e-1*(i-24)*ny BETWEEN 0 AND height-1 AND s.x+5e-1*(i-24)*nx BETWEEN 0 AND width-1)"),
)
def sample_rays_on_table(fx):
    prob = fx.grid_raw.selectExpr("package_id", "r AS y", "c AS x", "0.5D+0.2D*e AS prob")
    # Both sides have a row per voxel, which the size of the unexploded table hides.
    table = voxels(fx).join(prob.hint("merge"), ["package_id", "y", "x"])
    out = V.sample_rays(vol_sites(fx), table, vol_shape(fx), ["package_id"])
    return out.withColumn("prob", rounded(F.col("prob")))


# --- gaps and tiles ------------------------------------------------------------------------------

define(
    "gap_px",
    """SELECT package_id, y, x FROM (SELECT m.package_id, m.y+dy AS y, m.x+dx AS x, count(DISTINCT label) AS n FROM (SELECT * FROM instance_map WHERE label>0) m CROSS JOIN (SELECT unnest(generate_series(-5,5)) AS dy) CROSS JOIN (SELECT unnest(generate_series(-5,5)) AS dx)
       WHERE dy*dy+dx*dx<=25 GROUP BY 1,2,3) g WHERE n>=2 AND y BETWEEN 0 AND (SELECT max(height)-1 FROM vol_shape h WHERE h.package_id=g.package_id) AND x BETWEEN 0 AND 63
       AND NOT EXISTS (SELECT 1 FROM instance_map i WHERE i.label>0 AND i.package_id=g.package_id AND i.y=g.y AND i.x=g.x)""",
)


def gap(fx):
    return V.inter_sheet_gap(fx.instance_map, vol_shape(fx).select("package_id", "height", "width"), radius=5)


@query("inter_sheet_gap", "SELECT package_id, y, x FROM gap_px")
def inter_sheet_gap(fx):
    return gap(fx)


@query("broadcast_gap", "SELECT package_id, y, x, z FROM gap_px CROSS JOIN (SELECT unnest([0,1,2]) AS z)")
def broadcast_gap(fx):
    return V.broadcast_gap(gap(fx), 3)


define("lengths", "SELECT doc_id, CAST(n_chars%700+1 AS INT) AS len FROM documents")


@query(
    "sliding_windows",
    "SELECT doc_id, len, CASE WHEN len<=128 THEN '0' ELSE (SELECT string_agg(CAST(s AS VARCHAR),',' ORDER BY s) FROM (SELECT unnest(generate_series(0,len-128,96)) AS s UNION SELECT len-128)) END AS starts FROM lengths",
)
def sliding_windows(fx):
    lengths = fx.table("documents").selectExpr("doc_id", "CAST(n_chars%700+1 AS INT) AS len")
    return lengths.selectExpr("doc_id", "len", f"array_join(transform({V.window_starts('len', 128, 96)}, s -> CAST(s AS STRING)), ',') AS starts")


_BELL = "exp(-5e-1*power(({p}-155e-1)/4e0,2))"
define(
    "tile_rows",
    """SELECT g.package_id, r AS row, c AS col, r0 AS row0, c0 AS col0, 5e-1+1e-1*e+1e-2*((r0+c0)%3) AS prob FROM grid_raw g JOIN vol_shape s ON s.package_id=g.package_id
       JOIN (SELECT unnest([0,18,24,32]) AS r0) a ON r BETWEEN r0 AND r0+31 AND r0 IN (0,18) JOIN (SELECT unnest([0,24,32]) AS c0) b ON c BETWEEN c0 AND c0+31""",
)


def tiles(fx):
    sized = fx.grid_raw.join(vol_shape(fx).select("package_id", "height", "width"), "package_id")
    for axis, pos, size in (("row0", "r", "height"), ("col0", "c", "width")):
        starts = V.window_starts(size, 32, 24)
        sized = sized.selectExpr("*", f"explode(filter({starts}, s -> {pos} BETWEEN s AND s + 31)) AS {axis}")
    return sized.selectExpr("package_id", "r AS row", "c AS col", "row0", "col0", "0.5D+0.1D*e+0.01D*((row0+col0)%3) AS prob")


@query(
    "overlap_blend",
    f"""SELECT package_id, row, col, {r6('sum(prob*w)/sum(w)')} AS value FROM (SELECT *, greatest({_BELL.format(p='(row-row0)')}*{_BELL.format(p='(col-col0)')}/power(exp(-5e-1*power(5e-1/4e0,2)),2),1e-4) AS w FROM tile_rows) GROUP BY 1,2,3""",
)
def overlap_blend(fx):
    return V.overlap_blend(tiles(fx), 32).withColumn("value", rounded(F.col("value")))


_LOST = "package_id%3=1 AND row0=18 AND col0=0"


@query(
    "uncovered",
    f"""SELECT package_id, r AS row, c AS col FROM grid_raw g WHERE NOT EXISTS (SELECT 1 FROM tile_rows t WHERE t.package_id=g.package_id AND t.row=g.r AND t.col=g.c AND NOT ({_LOST}))""",
)
def uncovered(fx):
    blended = V.overlap_blend(tiles(fx).where(f"NOT ({_LOST})"), 32)
    return V.uncovered(fx.grid_raw.selectExpr("package_id", "r AS row", "c AS col"), blended)


# --- normalization and caches --------------------------------------------------------------------

_P = V.EXPECTED_PROPERTIES


@query("ct_normalize", f"SELECT event_id, {r6(f'(least(greatest(value,{_P['low']}e0),{_P['high']}e0)-{_P['mean']}e0)/({_P['std']}e0+1e-8)')} AS value FROM events")
def ct_normalize(fx):
    return fx.table("events").select("event_id", rounded(V.ct_normalize(F.col("value"))).alias("value"))


PROPS = [
    "doc_id", "CASE doc_id%4 WHEN 0 THEN 'CTNormalization' WHEN 1 THEN 'CT' WHEN 2 THEN 'ct_normalization' ELSE 'zscore' END AS scheme",
    "129.0977 + (doc_id%5)*0.0004 AS mean", "42.1883 - CASE WHEN doc_id%11=2 THEN 50 ELSE 0 END AS std", "CASE WHEN doc_id%13=3 THEN NULL ELSE 44 END AS low", "236 AS high",
]
_CAST = [f"CAST({p.rsplit(' AS ', 1)[0]} AS DOUBLE) AS {p.rsplit(' AS ', 1)[1]}" if i > 1 else p for i, p in enumerate(PROPS)]


@query(
    "property_contract",
    f"""SELECT doc_id, sk AS scheme_ok, v AS values_ok, s AS std_ok, i AS interval_ok, sk AND v AND s AND i AS accepted FROM (SELECT doc_id, replace(lower(scheme),'_','') IN ('ctnormalization','ct') AS sk,
      coalesce(abs(mean-{_P['mean']}e0)<=1e-3 AND abs(std-{_P['std']}e0)<=1e-3 AND abs(low-44)<=1e-3 AND abs(high-236)<=1e-3,false) AS v, coalesce(std>0,false) AS s, coalesce(low<high,false) AS i FROM (SELECT {', '.join(_CAST)} FROM documents))""",
)
def property_contract(fx):
    return V.property_contract(fx.table("documents").selectExpr(*_CAST), "doc_id")


@query(
    "validate_prob_cache",
    """SELECT file, true AS finite_ok, min(p)>=0 AND max(p)<=1 AS range_ok, count(*) FILTER (gt NOT IN (0,1))=0 AS binary_ok, min(p)>=0 AND max(p)<=1 AND count(*) FILTER (gt NOT IN (0,1))=0 AS accepted FROM
       (SELECT l_orderkey AS file, l_discount*CASE WHEN l_orderkey%7=2 THEN 15 ELSE 10 END AS p, CASE WHEN l_orderkey%5=1 THEN l_linenumber ELSE l_linenumber%2 END AS gt FROM lineitem) GROUP BY 1""",
)
def validate_prob_cache(fx):
    samples = fx.table("lineitem").selectExpr(
        "l_orderkey AS file", "l_discount*CASE WHEN l_orderkey%7=2 THEN 15 ELSE 10 END AS prob", "CASE WHEN l_orderkey%5=1 THEN l_linenumber ELSE l_linenumber%2 END AS gt"
    )
    return V.validate_prob_cache(samples, ["file"])

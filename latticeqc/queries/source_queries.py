"""Sources, scans and sinks."""

import pandas as pd
from pyspark.sql import functions as F

from latticeqc.functions.numeric import rounded
from latticeqc.operators import digest, project
from latticeqc.operators import geometry as G
from latticeqc.plans import reporting as P

from latticeqc.queries.grid_queries import CFG, K, METRIC_SQL, cells, frame
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import fr6, r6, set_digest_sql
from latticeqc.queries.topology_queries import DIGEST_SQL, graph
from latticeqc.session import materialize
from latticeqc.sources import annotations as A
from latticeqc.sources import logs as L
from latticeqc.sources import packages as S
from latticeqc.sources import rasters

# --- sources -------------------------------------------------------------------------------------


@query("discover_packages", "SELECT DISTINCT regexp_extract(path,'^(.*)/[^/]*$',1) AS dir FROM (SELECT concat('/data/',dir,'/',filename) AS path FROM files_fx) WHERE regexp_extract(path,'([^/]*)$',1) IN ('x.tif','y.tif','z.tif','meta.json')")
def discover_packages(fx):
    paths = fx.files.select(F.concat(F.lit("/data/"), "dir", F.lit("/"), "filename").alias("path"))
    listing = paths.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))
    return S.discover_packages(listing)


@query("file_presence", "SELECT dir, exists_ AS exists, has_x, has_y, has_z, has_meta, has_mask FROM presence")
def file_presence(fx):
    return S.file_presence(fx.requested_dirs, fx.files)


@query("complete_packages", "SELECT dir FROM files_fx WHERE starts_with(dir,'same_wrap') AND filename IN ('x.tif','y.tif','z.tif','meta.json') GROUP BY dir HAVING count(DISTINCT filename)=4")
def complete_packages(fx):
    return S.complete_packages(fx.files, "same_wrap")


define("tile8", "SELECT vec_id AS package_id, CAST((i-1)//8 AS INT) AS row, CAST((i-1)%8 AS INT) AS col, embedding[i] AS value FROM (SELECT *, unnest(generate_series(1,64)) AS i FROM embeddings)")


@query("ingest_rasters", "SELECT package_id, 'x' AS channel, row, col, round(CAST(value AS DOUBLE),6)+0e0 AS value, 'float32' AS dtype, 1 AS frames, 8 AS height, 8 AS width FROM tile8")
def ingest_rasters(fx):
    import numpy as np

    def encode(batches):
        for batch in batches:
            planes = [rasters.encode_strip(np.asarray(v, dtype="float32").reshape(8, 8)) for v in batch["embedding"]]
            yield pd.DataFrame({"package_id": batch["vec_id"], "channel": "x", "content": planes})

    files = fx.table("embeddings").select("vec_id", "embedding").mapInPandas(encode, "package_id BIGINT, channel STRING, content BINARY")
    decoded = materialize(rasters.ingest_rasters(files))
    facts = rasters.channel_table(decoded).select("package_id", "channel", "dtype", "frames", "height", "width")
    samples = decoded.where("row IS NOT NULL").select("package_id", "channel", "row", "col", "value").join(facts, ["package_id", "channel"])
    return samples.select("package_id", "channel", "row", "col", rounded(F.col("value")).alias("value"), "dtype", "frames", "height", "width")


STRICT_META = """CASE WHEN vec_id%7=1 THEN '{"format":"other","source":"grower","grid_offset":[1,2]}' WHEN vec_id%7=2 THEN '{"format":"tifxyz","source":"hand","grid_offset":[1,2]}'
  WHEN vec_id%7=3 THEN '{"format":"tifxyz","source":"grower","grid_offset":[1,2.5]}' WHEN vec_id%7=4 THEN '{"format":"tifxyz","source":"grower"}'
  ELSE '{"format":"tifxyz","source":"grower","grid_offset":[3,4]}' END"""


@query(
    "load_surface_strict",
    f"""SELECT package_id, valid_vertices, height<=40 AS shape_ok, nonfinite=0 AS finite_ok, dtype_ok, format_ok, producer_ok, offset_ok, CASE WHEN offset_ok THEN 3 END AS offset_col,
       CASE WHEN offset_ok THEN 4 END AS offset_row, height<=40 AND nonfinite=0 AND dtype_ok AND format_ok AND producer_ok AND offset_ok AS accepted FROM
       (SELECT v.*, coalesce(dtype_ok,false) AS dtype_ok, m%7<>1 AS format_ok, m%7<>2 AS producer_ok, m%7 NOT IN (3,4) AND m%7 NOT IN (1,2) AS offset_ok FROM
         (SELECT package_id, max(row)+1 AS height, count(*) FILTER (NOT (isfinite(x) AND isfinite(y) AND isfinite(z))) AS nonfinite, count(*) FILTER (isnan(x) OR x<>-1) AS valid_vertices, package_id AS m
          FROM strict_vertices GROUP BY 1) v LEFT JOIN (SELECT package_id, bool_and(dtype='float32') AS dtype_ok FROM channels WHERE channel<>'mask' GROUP BY 1) c ON c.package_id=v.package_id)""".replace(
        "m%7 NOT IN (3,4) AND m%7 NOT IN (1,2) AS offset_ok", "m%7 NOT IN (3,4) AS offset_ok").replace("CASE WHEN offset_ok THEN 3 END", "CASE WHEN offset_ok THEN CASE WHEN package_id%7 IN (1,2) THEN 1 ELSE 3 END END").replace(
        "CASE WHEN offset_ok THEN 4 END", "CASE WHEN offset_ok THEN CASE WHEN package_id%7 IN (1,2) THEN 2 ELSE 4 END END").replace(
        "strict_vertices", "(SELECT vec_id AS package_id, CAST(i-1 AS INT) AS row, CASE WHEN vec_id%11=3 AND i=5 THEN CAST('NaN' AS DOUBLE) WHEN (vec_id+i)%9=0 THEN -1e0 ELSE i*1e0 END AS x, 1e0 AS y, 1e0 AS z FROM (SELECT vec_id, unnest(generate_series(1,CASE WHEN vec_id%5=0 THEN 50 ELSE 30 END)) AS i FROM embeddings))"),
)
def load_surface_strict(fx):
    from latticeqc.sources.surfaces import strict_surface_report

    ids = fx.table("embeddings").select("vec_id")
    vertices = (
        ids.selectExpr("vec_id", "explode(sequence(1, CASE WHEN vec_id%5=0 THEN 50 ELSE 30 END)) AS i")
        .selectExpr("vec_id AS package_id", "i-1 AS row", "0 AS col", "CASE WHEN vec_id%11=3 AND i=5 THEN double('NaN') WHEN (vec_id+i)%9=0 THEN -1D ELSE i*1D END AS x", "1D AS y", "1D AS z")
    )
    meta = ids.selectExpr("vec_id AS package_id", f"{STRICT_META} AS raw_json")
    return strict_surface_report(vertices, fx.channels, meta, producer="grower", format_name="tifxyz", max_side=40)


@query("file_digests", "SELECT dir, filename, sha256(content) AS sha256, bytes FROM files_fx")
def file_digests(fx):
    return S.file_digests(fx.files)


COLLECTION = (
    "concat('{\"collections\":{\"k', CAST(doc_id AS STRING), '\":{\"name\":\"', CASE doc_id%10 WHEN 7 THEN 'between_patches__1__2__3' WHEN 8 THEN concat('between_patches__',CAST(doc_id AS STRING),'__',CAST(doc_id AS STRING))"
    " WHEN 9 THEN concat('near__',CAST(doc_id AS STRING),'__1') WHEN 6 THEN concat('between_patches__',CAST(doc_id+1000000000 AS STRING),'__1')"
    " ELSE concat('between_patches__',CAST(doc_id AS STRING),'__',CAST(doc_id-doc_id%10+n_chars%4 AS STRING)) END, '\"}}}')"
)


@query(
    "overlap_edges",
    f"""SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b FROM (SELECT split_part(substr(name,18),'__',1) AS a, split_part(substr(name,18),'__',2) AS b FROM
       (SELECT regexp_extract(j,'"name":"([^"]*)"',1) AS name FROM (SELECT {COLLECTION.replace('AS STRING', 'AS VARCHAR')} AS j FROM documents)) WHERE starts_with(name,'between_patches__') AND len(string_split(substr(name,18),'__'))=2)
       WHERE a<>b AND a IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AND b IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)""",
)
def overlap_edges(fx):
    docs = fx.table("documents").selectExpr(f"{COLLECTION} AS raw_json")
    return S.overlap_edges(docs, fx.overlap_nodes)


_ANN = "event_type<>'error' AND event_id%5<>0"


@query("annotation_points", f"SELECT event_id AS doc, (event_id*37%4900)+5e-1 AS h, CAST(event_id*91%6300 AS DOUBLE) AS w FROM events WHERE {_ANN} AND event_id%11<>0 AND event_id%13<>0")
def annotation_points(fx):
    return A.annotation_points(fx.annotation_json, ["doc"])


@query("annotation_point_count", f"SELECT event_id AS doc, CASE WHEN {_ANN} AND event_id%11<>0 THEN 1 ELSE 0 END AS points FROM events")
def annotation_point_count(fx):
    return A.annotation_point_count(fx.annotation_json, ["doc"])


IMAGE = "concat('s', CAST(1+doc_id%5 AS STRING), '_', CAST(doc_id AS STRING)"
define("image_files", f"SELECT {IMAGE.replace('STRING', 'VARCHAR')}, '_0000.tif') AS name FROM documents UNION ALL SELECT {IMAGE.replace('STRING', 'VARCHAR')}, '.tif') FROM documents WHERE doc_id%17<>3")


def image_files(fx):
    docs = fx.table("documents")
    return docs.selectExpr(f"{IMAGE}, '_0000.tif') AS name").unionByName(docs.where("doc_id%17<>3").selectExpr(f"{IMAGE}, '.tif') AS name"))


@query(
    "pair_images_labels",
    """SELECT i.name AS image, replace(i.name,'_0000.tif','.tif') AS label, l.name IS NOT NULL AS paired FROM image_files i LEFT JOIN image_files l ON l.name=replace(i.name,'_0000.tif','.tif')
       WHERE i.name LIKE '%\\_0000.tif' ESCAPE '\\'""",
)
def pair_images_labels(fx):
    return S.pair_images_labels(image_files(fx))


@query(
    "parse_trace_log",
    "SELECT doc_id, complete, "
    + ", ".join(
        f"CASE WHEN complete THEN {v} END AS {n}"
        for n, v in {
            "resume_points": "doc_id*3", "resume_fringe": "doc_id%17", "area_width": "100+doc_id%7", "area_height": "90+doc_id%5", "area_x": "doc_id%4", "area_y": "doc_id%3",
            "generation_fringe": "doc_id%50", "generation_area": "n_chars", "final_area_vx2": "n_chars", "final_area_cm2": "n_chars%100+5e-1",
        }.items()
    )
    + ", CASE WHEN complete THEN (SELECT string_agg(line,'|' ORDER BY i) FROM (SELECT trim(x) AS line, i FROM (SELECT unnest(string_split(log,chr(10))) AS x, generate_subscripts(string_split(log,chr(10)),1) AS i) WHERE contains(x,'resume_growth initialized') OR contains(x,'gen 0 processing') OR contains(x,'area est:'))) END AS selected_lines"
    + " FROM (SELECT *, doc_id%9<>4 AS complete FROM logs_fx)",
)
def parse_trace_log(fx):
    return L.parse_trace_log(fx.logs, ["doc_id"])


@query("loaded_libraries", "SELECT doc_id, concat('/opt/a/libvc_core.dylib|/opt/',lang,'/libvc_tracer.dylib') AS libraries FROM documents")
def loaded_libraries(fx):
    return L.loaded_libraries(fx.logs, ["doc_id"])


@query(
    "select_cases",
    "SELECT DISTINCT f.dir, p.dir IS NULL AS unknown FROM requested_dirs f LEFT JOIN (SELECT DISTINCT dir FROM files_fx) p ON p.dir=f.dir",
)
def select_cases(fx):
    known, unknown = S.select_cases(fx.files.select("dir").distinct(), fx.requested_dirs, "dir")
    return known.select("dir", F.lit(False).alias("unknown")).unionByName(unknown.select("dir", F.lit(True).alias("unknown")))


@query("limit_cases", "SELECT dir FROM requested_dirs ORDER BY dir LIMIT 7")
def limit_cases(fx):
    return fx.requested_dirs.orderBy("dir").limit(7)


# --- sinks ---------------------------------------------------------------------------------------


@query("payload_hash", """SELECT doc_id, sha256(concat('{"area":',CAST(n_chars AS VARCHAR),',"lang":"',lang,'","source":"',source,'"}')) AS payload_sha256, doc_id%3<>0 AS matches FROM documents""")
def payload_hash(fx):
    docs = fx.table("documents").select("doc_id", F.col("n_chars").alias("area"), "lang", "source")
    hashed = docs.withColumn("payload_sha256", P.payload_hash(["source", "area", "lang"]))
    claimed = F.when(F.col("doc_id") % 3 == 0, F.lit("0")).otherwise(F.col("payload_sha256"))
    return hashed.select("doc_id", "payload_sha256", (claimed == P.payload_hash(["lang", "source", "area"])).alias("matches"))


_IDS = "SELECT count(*) AS ids, " + set_digest_sql("id") + " AS digest FROM ({source})"


@query("ids_digest", _IDS.format(source="SELECT CAST(doc_id AS VARCHAR) AS id FROM documents"))
def ids_digest(fx):
    return digest.ids_digest(fx.overlap_nodes, "node")


@query("tree_digest", _IDS.format(source="SELECT concat(dir,'/',filename,chr(0),sha256(content)) AS id FROM files_fx"))
def tree_digest(fx):
    files = S.file_digests(fx.files).withColumn("path", F.concat_ws("/", "dir", "filename"))
    return digest.tree_digest(files, "path", "sha256")


@query("evidence_index", "SELECT dir, filename, sha256(content) AS sha256, bytes FROM files_fx WHERE filename LIKE '%.json' AND filename<>'index.json'")
def evidence_index(fx):
    return P.evidence_index(fx.files)


_COUNTERS = {
    "height": "max(row)+1", "mask_disagreement": "count(*) FILTER (explicit_mask IS NOT NULL AND valid<>(isfinite(z) AND z>0))",
    "nonfinite_count": "count(*) FILTER (NOT fin)", "nonfinite_valid": "count(*) FILTER (valid AND NOT fin)", "package_id": "package_id",
    "partial_sentinel": "count(*) FILTER ((x=-1 OR y=-1 OR z=-1) AND NOT (x=-1 AND y=-1 AND z=-1))",
    "sentinel_count": "count(*) FILTER (x=-1 AND y=-1 AND z=-1)", "valid_count": "count(*) FILTER (valid)", "vertex_count": "count(*)", "width": "max(col)+1",
}
_REPORT_JSON = (
    "SELECT package_id, concat('{'," + ",',',".join(f"'\"{name}\":',{value}" for name, value in _COUNTERS.items()) + ",'}') AS document"
    " FROM (SELECT *, isfinite(x) AND isfinite(y) AND isfinite(z) AS fin FROM surf) GROUP BY 1"
)


@query("write_report_json", _REPORT_JSON)
def write_report_json(fx):
    return P.report_json(G.vertex_integrity(fx.surf), "package_id")


define("hole_cells", "SELECT DISTINCT package_id, row, unnest(generate_series(lo,hi)) AS col FROM holes")
define(
    "painted",
    """SELECT package_id, row, col, CASE WHEN hole THEN 220 WHEN act AND s<=5e-1 THEN round_even(40+215*(s/5e-1),0) WHEN act THEN round_even(255-20*((s-5e-1)/5e-1),0) WHEN ok THEN 30 ELSE 16 END AS r,
       CASE WHEN hole THEN 40 WHEN act AND s<=5e-1 THEN round_even(145+60*(s/5e-1),0) WHEN act THEN round_even(205-155*((s-5e-1)/5e-1),0) WHEN ok THEN 38 ELSE 19 END AS g,
       CASE WHEN hole THEN 220 WHEN act AND s<=5e-1 THEN round_even(235-190*(s/5e-1),0) WHEN act THEN round_even(45+0*((s-5e-1)/5e-1),0) WHEN ok THEN 50 ELSE 25 END AS b FROM
       (SELECT c.*, h.row IS NOT NULL AS hole, c.ok AND c.local_cue AS act, least(greatest(coalesce(CAST(round(c.local_score,6) AS DOUBLE),0e0),0e0),1e0) AS s FROM scored_cells c
        LEFT JOIN hole_cells h ON h.package_id=c.package_id AND h.row=c.row AND h.col=c.col)""",
)
PAINT = "SELECT package_id, row, col, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM painted"


def painted(fx):
    from latticeqc.operators.components import expand_runs
    from latticeqc.plans.geometry_report import cell_shapes, hole_runs
    from latticeqc.session import materialize

    cell = materialize(cells(fx).select(*K, "cell_valid", F.col("local_cue").alias("cue"), rounded(F.col("local_score")).alias("score")))
    holes = expand_runs(hole_runs(cell, cell_shapes(fx.surf)))
    return P.overlay_cells(cell, holes)


@query("overlay_cells", PAINT)
def overlay_cells(fx):
    return painted(fx)


@query(
    "overlay_downsample",
    f"""SELECT p.package_id, t.row, u.col, p.r, p.g, p.b FROM ({PAINT}) p JOIN shapes s ON s.package_id=p.package_id
      JOIN (SELECT unnest(generate_series(0,63)) AS row) t ON t.row<greatest(1,CAST(floor((s.height-1)*(40/greatest(s.height-1,s.width-1)*1e0)) AS INT)) AND CAST(floor((t.row+5e-1)*(s.height-1)/greatest(1,CAST(floor((s.height-1)*(40/greatest(s.height-1,s.width-1)*1e0)) AS INT))) AS INT)=p.row
      JOIN (SELECT unnest(generate_series(0,63)) AS col) u ON u.col<greatest(1,CAST(floor((s.width-1)*(40/greatest(s.height-1,s.width-1)*1e0)) AS INT)) AND CAST(floor((u.col+5e-1)*(s.width-1)/greatest(1,CAST(floor((s.width-1)*(40/greatest(s.height-1,s.width-1)*1e0)) AS INT))) AS INT)=p.col""",
)
def overlay_downsample(fx):
    from latticeqc.plans.geometry_report import cell_shapes

    return P.overlay_downsample(painted(fx), cell_shapes(fx.surf), 40)


define("vertex_holes", "SELECT package_id, row, col FROM flags WHERE sentinel_all")
from latticeqc.queries.grid_queries import VERTEX_TO_CELLS  # noqa: E402


@query("vertex_hole_projection", VERTEX_TO_CELLS.format(source="vertex_holes"))
def vertex_hole_projection(fx):
    from latticeqc.operators.masks import vertex_flags
    from latticeqc.session import materialize
    from latticeqc.sources.surfaces import grid_shapes

    return project.vertices_to_cells(vertex_flags(fx.vertices).where("sentinel_all"), materialize(grid_shapes(fx.vertices)))


TABLE_METRICS = [
    "horizontal_edge_length", "vertical_edge_length", "quad_area", "condition_number", "symmetric_stretch", "area_ratio", "shear", "symmetric_dirichlet", "normal_jump_degrees",
]
define("metric_table", METRIC_SQL)


@query(
    "summary_table",
    """SELECT package_id, metric, stat, value FROM (UNPIVOT (SELECT package_id, metric, min, p05, p50, p95, max FROM metric_table WHERE metric IN ("""
    + ",".join(f"'{m}'" for m in TABLE_METRICS)
    + """)) ON min, p05, p50, p95, max INTO NAME stat VALUE value)""",
)
def summary_table(fx):
    from latticeqc.operators.quantiles import largest_group, summary

    rows = G.metric_rows(frame(fx)).where(F.col("metric").isin(TABLE_METRICS))
    table = summary(rows, ["package_id"], "metric", "value", 2 * largest_group(fx.vertices, ["package_id"]))
    return P.unpivot_summary(table).select("package_id", "metric", "stat", rounded(F.col("value")).alias("value"))


define("added_quads", "SELECT package_id, row, col, concat(CAST(row AS VARCHAR),',',CAST(col AS VARCHAR)) AS place FROM xquad WHERE ok AND (row+2=height OR col+2=width)")


@query(
    "boundary_tsv",
    """SELECT concat_ws(chr(9), CAST(b.package_id AS VARCHAR), CAST(height AS VARCHAR), CAST(width AS VARCHAR), CAST(valid_vertices AS VARCHAR), CAST(valid_quads AS VARCHAR), CAST(added_quads AS VARCHAR),
       CAST(last_row_quads AS VARCHAR), CAST(last_col_quads AS VARCHAR), CAST(corner_quad AS VARCHAR), origins) AS line FROM boundary_counts b JOIN
       (SELECT package_id, string_agg(place,';' ORDER BY row,col) AS origins FROM added_quads GROUP BY 1) a ON a.package_id=b.package_id""".replace("CAST(added_quads AS", "CAST(b.added_quads AS"),
)
def boundary_tsv(fx):
    return P.boundary_lines(fx.vertices)

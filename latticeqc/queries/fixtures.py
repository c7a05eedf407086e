"""Input tables derived from the given Parquet tables, for Spark and as SQL text.

Each table grows with the source it is derived from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.sources.surfaces import load_surface

VERTEX_COLUMNS = [
    "package_id",
    "r AS row",
    "c AS col",
    "CASE WHEN (r*7+c*13+package_id*5)%41=0 THEN -1e0 WHEN (r*11+c*3+package_id)%211=7 THEN -1e0"
    " WHEN (r*5+c*17+package_id)%1013=2 THEN CAST('NaN' AS DOUBLE) ELSE c+1e-1*e END AS x",
    "CASE WHEN (r*7+c*13+package_id*5)%41=0 THEN -1e0 ELSE r+1e-1*e END AS y",
    "CASE WHEN (r*7+c*13+package_id*5)%41=0 THEN -1e0 WHEN (r*3+c*19+package_id)%1009=1 THEN -(100+2*e)"
    " ELSE 100+2*e END AS z",
]

META_JSON = """CASE package_id%8
 WHEN 0 THEN '{"uuid":"a","format":"tifxyz","type":"seg","scale":[1.0,1.0],"bbox":[[0,0,90],[64,50,110]],"area":10.5,"source":"grower","grid_offset":[2,1]}'
 WHEN 1 THEN '{"uuid":"a","format":"tifxyz","type":"seg","scale":[1,1],"area_vx2":42.5,"area_cm2":0.004}'
 WHEN 2 THEN '{"uuid":"","format":"other","type":"mesh","scale":[0,"x"],"bbox":[[2,0,0],[1,1,1]],"area":-1}'
 WHEN 3 THEN '{broken'
 WHEN 4 THEN '[1,2]'
 WHEN 5 THEN '{"uuid":"b","format":"tifxyz","type":"seg","scale":[NaN,1.0],"nested":{"bad":-Infinity}}'
 WHEN 6 THEN '{"uuid":7,"format":"tifxyz","type":"seg","scale":[true,1.0],"area_vx2":-3,"area_cm2":"4"}'
 ELSE '{"uuid":"c","format":"tifxyz","type":"seg","scale":[0.05,0.05],"bbox":[[0,0,0],[1,1,1]]}' END"""

FILE_NAME = (
    "CASE CAST(doc_id%8 AS INT) WHEN 0 THEN 'x.tif' WHEN 1 THEN 'y.tif' WHEN 2 THEN 'z.tif' WHEN 3 THEN 'meta.json'"
    " WHEN 4 THEN 'mask.tif' WHEN 5 THEN 'notes.txt' WHEN 6 THEN 'report.json' ELSE 'index.json' END"
)
FILE_DIR = "CAST(floor(doc_id/8) AS BIGINT)"
FILE_KEPT = f"n_chars%11<>0 AND {FILE_DIR}%13<>5"
DIR_NAME = f"concat(CASE WHEN {FILE_DIR}%3=0 THEN 'same_wrap_' ELSE 'other_' END, CAST({FILE_DIR} AS STRING))"

CHANNEL_COLUMNS = [
    "vec_id AS package_id",
    "CASE k WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' ELSE 'mask' END AS channel",
    "(vec_id*3+k)%37<>0 AS readable",
    "CASE WHEN (vec_id+k)%41=3 THEN 2 ELSE 1 END AS frames",
    "CASE WHEN (vec_id+2*k)%43=5 THEN 3 ELSE 2 END AS ndim",
    "CASE WHEN vec_id%29=4 AND k=1 THEN 51 ELSE 50 END AS height",
    "64 AS width",
    "CASE WHEN (vec_id*5+k)%17=0 THEN 'uint16' WHEN (vec_id*5+k)%19=1 THEN 'complex64'"
    " WHEN (vec_id*5+k)%23=2 THEN 'float64' WHEN k<3 THEN 'float32' ELSE 'uint8' END AS dtype",
]

REGISTRY_COLUMNS = [
    "doc_id AS package_id",
    "source AS uuid",
    "lang AS sample",
    "CASE WHEN doc_id%4=0 THEN 'original' ELSE 'normalized' END AS variant",
    "CASE WHEN doc_id%5=0 THEN n_chars END AS area",
    "CASE WHEN doc_id%5<>0 AND doc_id%7<5 THEN n_chars*2 END AS area_vx2",
]

LOG_TEXT = (
    "concat('start', chr(10), 'resume_growth initialized ', CAST(doc_id*3 AS STRING), ' low-res points, fringe ', CAST(doc_id%17 AS STRING),"
    " ' ok used_area [', CAST(100+doc_id%7 AS STRING), ' x ', CAST(90+doc_id%5 AS STRING), ' from (', CAST(doc_id%4 AS STRING), ', ', CAST(doc_id%3 AS STRING), ')]', chr(10),"
    " CASE WHEN doc_id%9=4 THEN 'gen lost' ELSE concat('  gen 0 processing ', CAST(doc_id%50 AS STRING), ' fringe cands -> area ', CAST(n_chars AS STRING), ' vx^2') END, chr(10),"
    " 'dyld[12]: <A> /opt/a/libvc_core.dylib', chr(10), 'dyld[12]: <B> /opt/', lang, '/libvc_tracer.dylib', chr(10),"
    " 'dyld[12]: <A> /opt/a/libvc_core.dylib', chr(10), 'other /opt/a/libvc_core.dylib', chr(10),"
    " 'area est: ', CAST(n_chars AS STRING), ' vx^2 (', CAST(n_chars%100 AS STRING), '.5 cm^2)', chr(10), text)"
)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def grid_raw(self) -> DataFrame:
        return (
            self.table("embeddings")
            .selectExpr("vec_id", "posexplode(embedding) AS (pos, val)")
            .selectExpr(
                "CAST(floor(vec_id/50) AS BIGINT) AS package_id",
                "CAST(vec_id%50 AS INT) AS r",
                "CAST(pos AS INT) AS c",
                "CAST(val AS DOUBLE) AS e",
            )
        )

    @cached_property
    def vertices(self) -> DataFrame:
        return self.grid_raw.selectExpr(*VERTEX_COLUMNS)

    @cached_property
    def mask_samples(self) -> DataFrame:
        exact = self.grid_raw.where("package_id%3=1").selectExpr(
            "package_id",
            "r AS mrow",
            "c AS mcol",
            "CAST(CASE WHEN (r+2*c)%53=0 THEN 0 WHEN (r*2+c)%211=1 THEN 1 ELSE 255 END AS DOUBLE) AS value",
        )
        double = (
            self.grid_raw.where("package_id%3=2")
            .withColumn("ij", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .selectExpr("*", "CAST(floor(ij/2) AS INT) AS i", "CAST(ij%2 AS INT) AS j")
            .selectExpr(
                "package_id",
                "2*r+i AS mrow",
                "2*c+j AS mcol",
                "CAST(CASE WHEN (r*5+c+i+j)%67=0 THEN 0 ELSE 255 END AS DOUBLE) AS value",
            )
        )
        return exact.unionByName(double)

    @cached_property
    def surf(self) -> DataFrame:
        return load_surface(self.vertices, self.mask_samples)

    @cached_property
    def package_meta(self) -> DataFrame:
        return (
            self.table("embeddings")
            .selectExpr("CAST(floor(vec_id/50) AS BIGINT) AS package_id")
            .distinct()
            .selectExpr("package_id", f"{META_JSON} AS raw_json")
        )

    @cached_property
    def files(self) -> DataFrame:
        """Directory listing: one file per document."""
        return self.table("documents").where(FILE_KEPT).selectExpr(
            f"{DIR_NAME} AS dir", f"{FILE_NAME} AS filename", "n_chars AS bytes", "text AS content", "doc_id"
        )

    @cached_property
    def requested_dirs(self) -> DataFrame:
        return self.table("documents").selectExpr(f"{DIR_NAME} AS dir").distinct()

    @cached_property
    def channels(self) -> DataFrame:
        return (
            self.table("embeddings")
            .select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
            .selectExpr(*CHANNEL_COLUMNS)
        )

    @cached_property
    def registry(self) -> DataFrame:
        return self.table("documents").selectExpr(*REGISTRY_COLUMNS)

    @cached_property
    def overlap_edges(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "n_chars")
        near = docs.where("n_chars%5<2").selectExpr("doc_id AS left_id", "doc_id+1+n_chars%3 AS doc_id")
        return near.join(docs.select("doc_id"), "doc_id", "left_semi").selectExpr(
            "CAST(left_id AS STRING) AS a", "CAST(doc_id AS STRING) AS b"
        )

    @cached_property
    def overlap_nodes(self) -> DataFrame:
        return self.table("documents").selectExpr("CAST(doc_id AS STRING) AS node")

    @cached_property
    def scores(self) -> DataFrame:
        return (
            self.table("lineitem")
            .selectExpr(
                "concat(l_returnflag,l_linestatus) AS run",
                "round(0.30D+0.05D*CAST(l_linenumber AS INT),2) AS threshold",
                "l_suppkey AS patch",
                "l_discount",
            )
            .groupBy("run", "threshold", "patch")
            .agg(F.avg("l_discount").alias("blend"))
        )

    @cached_property
    def annotations(self) -> DataFrame:
        """All events, spread over the packages as annotation samples."""
        return self.table("events").selectExpr(
            "event_id%10 AS package_id",
            "event_id AS point_id",
            "event_type<>'error' AS valid",
            "(event_id*37%4900)/1e2 AS h",
            "(event_id*91%6300)/1e2 AS w",
        )

    @cached_property
    def annotation_json(self) -> DataFrame:
        """One document per user with a list of points, as the annotation files carry them."""
        point = (
            "concat('{\"valid\":', CASE WHEN event_type='error' THEN 'false' WHEN event_id%7=0 THEN 'null' ELSE 'true' END,"
            " ',\"model_locations\":[', CASE WHEN event_id%5=0 THEN '' ELSE concat('{\"h\":', CAST((event_id*37%4900) AS STRING), '.5',"
            " CASE WHEN event_id%11=0 THEN '' ELSE concat(',\"w\":', CASE WHEN event_id%13=0 THEN '\"x\"' ELSE CAST((event_id*91%6300) AS STRING) END) END, '}') END, ']}')"
        )
        return self.table("events").selectExpr(
            "event_id AS doc", "event_id%10 AS package_id", f"concat('{{\"points_list\":[', {point}, ']}}') AS raw_json"
        )

    @cached_property
    def instance_map(self) -> DataFrame:
        return self.grid_raw.selectExpr(
            "package_id",
            "r AS y",
            "c AS x",
            "CASE WHEN c%9=3 THEN 11+package_id*10+CAST(floor(c/9) AS INT) ELSE 0 END AS label",
        )

    @cached_property
    def rays(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "CAST(label AS STRING) AS cell",
            "vec_id AS ray_id",
            "transform(embedding, v -> 5e-1+2*CAST(v AS DOUBLE)) AS prob",
            "transform(sequence(0,size(embedding)-1), i -> CAST(CASE WHEN abs(i-31)<=2 THEN 1 WHEN vec_id%3<>0 AND i=31+4+vec_id%7 THEN 2 ELSE 0 END AS INT)) AS turn",
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "n_chars", f"{LOG_TEXT} AS log")


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


CTES: dict[str, str] = {
    "grid_raw": "SELECT CAST(floor(vec_id/50) AS BIGINT) package_id, CAST(vec_id%50 AS INT) r, CAST(i-1 AS INT) c, CAST(embedding[i] AS DOUBLE) e"
    " FROM (SELECT vec_id, embedding, unnest(generate_series(1,len(embedding))) i FROM embeddings)",
    "vertices": f"SELECT {', '.join(VERTEX_COLUMNS)} FROM grid_raw",
    "mask_samples": "SELECT package_id, r AS mrow, c AS mcol, CAST(CASE WHEN (r+2*c)%53=0 THEN 0 WHEN (r*2+c)%211=1 THEN 1 ELSE 255 END AS DOUBLE) AS value"
    " FROM grid_raw WHERE package_id%3=1 UNION ALL"
    " SELECT package_id, 2*r+i AS mrow, 2*c+j AS mcol, CAST(CASE WHEN (r*5+c+i+j)%67=0 THEN 0 ELSE 255 END AS DOUBLE) AS value"
    " FROM grid_raw CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) ii CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) jj WHERE package_id%3=2",
    "shapes": "SELECT package_id, max(row)+1 AS height, max(col)+1 AS width FROM vertices GROUP BY 1",
    "relation": """
        SELECT s.package_id, height, width, mask_height, mask_width,
          CASE WHEN mask_height IS NULL THEN 'absent' WHEN mask_height=height AND mask_width=width THEN 'exact'
               WHEN mask_height%height=0 AND mask_width%width=0 THEN 'integer_multiple' ELSE 'incompatible' END AS relation
        FROM shapes s LEFT JOIN (SELECT package_id, max(mrow)+1 AS mask_height, max(mcol)+1 AS mask_width FROM mask_samples GROUP BY 1) m
          ON m.package_id=s.package_id""",
    "surf": """
        SELECT v.package_id, v.row, v.col, CAST(CAST(v.x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(v.y AS FLOAT) AS DOUBLE) AS y,
          CAST(CAST(v.z AS FLOAT) AS DOUBLE) AS z, m.value<>0 AS explicit_mask,
          coalesce(m.value<>0, isfinite(CAST(v.z AS FLOAT)) AND CAST(v.z AS FLOAT)>0) AS valid
        FROM vertices v JOIN relation r ON r.package_id=v.package_id
        LEFT JOIN mask_samples m ON r.relation='exact' AND m.package_id=v.package_id AND m.mrow=v.row AND m.mcol=v.col""",
    "package_meta": f"SELECT package_id, {META_JSON} AS raw_json FROM (SELECT DISTINCT package_id FROM grid_raw)",
    "files_fx": _duck(f"SELECT {DIR_NAME} AS dir, {FILE_NAME} AS filename, n_chars AS bytes, text AS content, doc_id FROM documents WHERE {FILE_KEPT}"),
    "requested_dirs": _duck(f"SELECT DISTINCT {DIR_NAME} AS dir FROM documents"),
    "channels": f"SELECT {', '.join(CHANNEL_COLUMNS)} FROM embeddings CROSS JOIN (SELECT unnest(generate_series(0,3)) AS k)",
    "registry_fx": f"SELECT {', '.join(REGISTRY_COLUMNS)} FROM documents",
    "overlap_fx": "SELECT CAST(a.doc_id AS VARCHAR) AS a, CAST(b.doc_id AS VARCHAR) AS b FROM documents a JOIN documents b"
    " ON b.doc_id=a.doc_id+1+a.n_chars%3 WHERE a.n_chars%5<2",
    "scores_fx": "SELECT concat(l_returnflag,l_linestatus) AS run, round(3e-1+5e-2*CAST(l_linenumber AS INT),2) AS threshold, l_suppkey AS patch,"
    " avg(l_discount) AS blend FROM lineitem GROUP BY 1,2,3",
    "annotations_fx": "SELECT event_id%10 AS package_id, event_id AS point_id, event_type<>'error' AS valid, (event_id*37%4900)/1e2 AS h,"
    " (event_id*91%6300)/1e2 AS w FROM events",
    "instance_map": "SELECT package_id, r AS y, c AS x, CASE WHEN c%9=3 THEN 11+package_id*10+CAST(floor(c/9) AS INT) ELSE 0 END AS label FROM grid_raw",
    "rays_fx": "SELECT CAST(label AS VARCHAR) AS cell, vec_id AS ray_id, list_transform(embedding, lambda v: 5e-1+2*CAST(v AS DOUBLE)) AS prob,"
    " list_transform(generate_series(0,63), lambda i: CASE WHEN abs(i-31)<=2 THEN 1 WHEN vec_id%3<>0 AND i=31+4+vec_id%7 THEN 2 ELSE 0 END) AS turn FROM embeddings",
    "logs_fx": _duck(f"SELECT doc_id, n_chars, {LOG_TEXT} AS log FROM documents"),
}

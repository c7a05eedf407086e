"""Contract rules, reports and collection checks."""

from pyspark.sql import functions as F

from latticeqc.functions.numeric import rounded
from latticeqc.operators import contract as C
from latticeqc.operators import masks as M
from latticeqc.operators.grid import quad_counts
from latticeqc.plans import contract_report as R
from latticeqc.queries.registry import define, query
from latticeqc.queries.vertex_queries import relation, validity
from latticeqc.session import materialize
from latticeqc.sources import packages as P
from latticeqc.sources.metadata import parse_metadata, sanitized_metadata

# --- SQL side ------------------------------------------------------------------------------------

define(
    "presence",
    """SELECT r.dir, count(f.filename)>0 AS exists_, coalesce(bool_or(filename='x.tif'),false) AS has_x, coalesce(bool_or(filename='y.tif'),false) AS has_y,
       coalesce(bool_or(filename='z.tif'),false) AS has_z, coalesce(bool_or(filename='meta.json'),false) AS has_meta, coalesce(bool_or(filename='mask.tif'),false) AS has_mask
       FROM requested_dirs r LEFT JOIN files_fx f ON f.dir=r.dir GROUP BY 1""",
)
define("meta_text", "SELECT *, regexp_replace(raw_json,'-?Infinity|NaN','[]','g') AS js FROM package_meta")
define(
    "meta_ok",
    """SELECT package_id, raw_json, CASE WHEN json_valid(js) THEN js END AS js, json_valid(js) AS readable, CASE WHEN json_valid(js) THEN json_type(js) END AS root,
       len(regexp_extract_all(regexp_replace(raw_json,'"[^"]*"','','g'),'-?Infinity|NaN')) AS nonfinite FROM meta_text""",
)
_NUM = "json_type(js,'$.{p}') IN ('BIGINT','UBIGINT','DOUBLE','HUGEINT')"


def _num(path: str) -> str:
    return f"(CASE WHEN {_NUM.format(p=path)} THEN CAST(js->>'$.{path}' AS DOUBLE) END)"


def _present(path: str) -> str:
    return f"coalesce(json_type(js,'$.{path}') NOT IN ('NULL'),false)"


define(
    "meta_obj",
    f"""SELECT package_id, nonfinite, CASE WHEN json_type(js,'$.uuid')='VARCHAR' AND trim(js->>'$.uuid')<>'' THEN js->>'$.uuid' END AS uuid,
      CASE WHEN json_type(js,'$.format')='VARCHAR' THEN js->>'$.format' END AS format, CASE WHEN json_type(js,'$.type')='VARCHAR' THEN js->>'$.type' END AS type,
      {_num('scale[0]')} AS s0, {_num('scale[1]')} AS s1, {_present('bbox')} AS bbox_present,
      {', '.join(f"{_num(f'bbox[{i}][{j}]')} AS b{i}{a}" for i in (0, 1) for j, a in enumerate('xyz'))},
      {', '.join(f"{_present(f)} AS {f}_present, CASE WHEN {_num(f)}>=0 THEN {_num(f)} END AS {f}" for f in ('area', 'area_vx2', 'area_cm2'))}
      FROM meta_ok WHERE root='OBJECT'""",
)
define(
    "meta_san",
    """SELECT *, CASE WHEN s0>0 AND s1>0 THEN s0 END AS scale_x, CASE WHEN s0>0 AND s1>0 THEN s1 END AS scale_y,
      coalesce(b0x<=b1x AND b0y<=b1y AND b0z<=b1z,false) AS box_ok FROM meta_obj""",
)
define("pquad", "SELECT package_id, count(*) FILTER (ok) AS face_count FROM portable_quad GROUP BY 1")
define(
    "box_cmp",
    """SELECT package_id, comparable, CASE WHEN comparable THEN dx<=tx AND dy<=ty AND dz<=tz AND ex<=tx AND ey<=ty AND ez<=tz END AS matches,
      CASE WHEN comparable THEN greatest(dx,dy,dz,ex,ey,ez) END AS max_delta, CASE WHEN comparable THEN tx END AS tolerance_x,
      CASE WHEN comparable THEN ty END AS tolerance_y, CASE WHEN comparable THEN tz END AS tolerance_z FROM (SELECT b.package_id,
      coalesce(m.box_ok AND min_x IS NOT NULL,false) AS comparable, """
    + ", ".join(f"abs(b0{a}-min_{a}) AS d{a}, abs(b1{a}-max_{a}) AS e{a}, 1e-4+1e-6*greatest(abs(min_{a}),abs(max_{a}),1e0) AS t{a}" for a in "xyz")
    + " FROM bbox b LEFT JOIN meta_san m ON m.package_id=b.package_id)",
)


def _rule(source: str, severity: str, code: str, hit: str, file: str = "NULL", count: str = "NULL", key: str = "package_id") -> str:
    return (
        f"SELECT {key}, '{severity}' AS severity, '{code}' AS code, CAST({file} AS VARCHAR) AS file, CAST({count} AS BIGINT) AS count FROM {source} WHERE {hit}"
    )


_USABLE = "readable AND ndim=2"
_NUMERIC = "dtype<>'complex64'"
_CH = "concat(channel,'.tif')"
FILE_RULES = {
    "path-not-directory": _rule("presence", "error", "path-not-directory", "NOT exists_", key="dir"),
    "missing-required-file": " UNION ALL ".join(
        _rule("presence", "error", "missing-required-file", f"exists_ AND NOT has_{n.split('.')[0]}", f"'{n}'", key="dir") for n in P.REQUIRED
    ),
}
CHANNEL_RULES = {
    "tiff-unreadable": _rule("channels", "error", "tiff-unreadable", "NOT readable", _CH),
    "tiff-multiple-images": _rule("channels", "error", "tiff-multiple-images", "readable AND frames<>1", _CH, "frames"),
    "tiff-not-2d": _rule("channels", "error", "tiff-not-2d", "readable AND ndim<>2", _CH),
    "tiff-nonnumeric": _rule("channels", "error", "tiff-nonnumeric", f"{_USABLE} AND NOT {_NUMERIC}", _CH),
    "coordinate-dtype-nonstandard": _rule("channels", "warning", "coordinate-dtype-nonstandard", f"{_USABLE} AND {_NUMERIC} AND channel<>'mask' AND dtype<>'float32'", _CH),
    "mask-dtype-nonstandard": _rule("channels", "warning", "mask-dtype-nonstandard", f"{_USABLE} AND {_NUMERIC} AND channel='mask' AND dtype<>'uint8'", _CH),
}
define(
    "gate",
    f"""SELECT package_id, count(*) FILTER ({_USABLE} AND {_NUMERIC})=3 AS decoded, count(DISTINCT height*1000+width)=1 AS same_shape
        FROM channels WHERE channel<>'mask' GROUP BY 1""",
)
SHAPE_RULES = {"coordinate-shape-mismatch": _rule("gate", "error", "coordinate-shape-mismatch", "decoded AND NOT same_shape")}
_M = "'meta.json'"
META_RULES = {
    "metadata-json-invalid": _rule("meta_ok", "error", "metadata-json-invalid", "NOT readable", _M),
    "metadata-not-object": _rule("meta_ok", "error", "metadata-not-object", "readable AND root<>'OBJECT'", _M),
    "metadata-nonfinite-number": _rule("meta_san", "error", "metadata-nonfinite-number", "nonfinite>0", _M, "nonfinite"),
    "metadata-uuid-invalid": _rule("meta_san", "error", "metadata-uuid-invalid", "uuid IS NULL", _M),
    "metadata-format-nonstandard": _rule("meta_san", "warning", "metadata-format-nonstandard", "format IS DISTINCT FROM 'tifxyz'", _M),
    "metadata-type-nonstandard": _rule("meta_san", "warning", "metadata-type-nonstandard", "type IS DISTINCT FROM 'seg'", _M),
    "metadata-scale-invalid": _rule("meta_san", "error", "metadata-scale-invalid", "scale_x IS NULL", _M),
    "metadata-bbox-invalid": _rule("meta_san", "error", "metadata-bbox-invalid", "bbox_present AND NOT box_ok", _M),
    "metadata-area-invalid": _rule("meta_san", "warning", "metadata-area-invalid", "area_present AND area IS NULL", _M),
    "metadata-area-vx2-invalid": _rule("meta_san", "warning", "metadata-area-vx2-invalid", "area_vx2_present AND area_vx2 IS NULL", _M),
    "metadata-area-cm2-invalid": _rule("meta_san", "warning", "metadata-area-cm2-invalid", "area_cm2_present AND area_cm2 IS NULL", _M),
    "metadata-area-schema-divergence": _rule("meta_san", "warning", "metadata-area-schema-divergence", "NOT area_present AND (area_vx2 IS NOT NULL OR area_cm2 IS NOT NULL)", _M),
}
COORDINATE_RULES = {
    "nonfinite-coordinate": _rule("vcounts", "error", "nonfinite-coordinate", "nonfinite_count>0", count="nonfinite_count"),
    "partial-sentinel": _rule("vcounts", "error", "partial-sentinel", "partial_sentinel_count>0", count="partial_sentinel_count"),
    "noncanonical-invalid-coordinate": _rule("vcounts", "warning", "noncanonical-invalid-coordinate", "noncanonical_count>0", count="noncanonical_count"),
}
define("mask_facts", "SELECT m.*, r.relation AS rel FROM mvalues m JOIN relation r ON r.package_id=m.package_id")
_K = "'mask.tif'"
MASK_RULES = {
    "mask-nonfinite": _rule("mask_facts", "error", "mask-nonfinite", "nonfinite>0", _K, "nonfinite"),
    "mask-low-nonzero-interoperability": _rule("mask_facts", "error", "mask-low-nonzero-interoperability", "low_nonzero_below_255>0", _K, "low_nonzero_below_255"),
    "mask-shape-python-incompatible": _rule("mask_facts", "error", "mask-shape-python-incompatible", "rel='integer_multiple'", _K),
    "mask-shape-incompatible": _rule("mask_facts", "error", "mask-shape-incompatible", "rel='incompatible'", _K),
}
define("valid_facts", "SELECT s.*, coalesce(face_count,0) AS face_count FROM vsummary s LEFT JOIN pquad q ON q.package_id=s.package_id")
VALIDITY_RULES = {
    "mask-revalidates-nonpositive-or-nonfinite-z": _rule("valid_facts", "error", "mask-revalidates-nonpositive-or-nonfinite-z", "revalidated_count>0", _K, "revalidated_count"),
    "python-cpp-validity-disagreement": _rule("valid_facts", "error", "python-cpp-validity-disagreement", "point_disagreement_count>0", count="point_disagreement_count"),
    "no-portable-valid-vertex": _rule("valid_facts", "error", "no-portable-valid-vertex", "portable_count=0"),
    "no-valid-face": _rule("valid_facts", "error", "no-valid-face", "face_count=0"),
}
BOX_RULES = {"metadata-bbox-mismatch": _rule("box_cmp", "warning", "metadata-bbox-mismatch", "comparable AND NOT matches", _M)}

# --- one query per rule --------------------------------------------------------------------------


# Masks with NaN and odd shapes, so that every mask rule meets both outcomes.
ODD = "CASE WHEN package_id%6=1 AND mrow=3 AND mcol=4 THEN CAST('NaN' AS DOUBLE) ELSE value END"
define("mask_odd", f"SELECT package_id, mrow, mcol, {ODD} AS value FROM mask_samples WHERE NOT (package_id%6=2 AND mrow=99)")
define(
    "odd_facts",
    """SELECT o.*, CASE WHEN mask_height=height AND mask_width=width THEN 'exact' WHEN mask_height%height=0 AND mask_width%width=0 THEN 'integer_multiple' ELSE 'incompatible' END AS rel
       FROM (SELECT package_id, max(mrow)+1 AS mask_height, max(mcol)+1 AS mask_width, count(*) FILTER (NOT isfinite(value)) AS nonfinite,
         count(*) FILTER (isfinite(value) AND value<>0 AND value<255) AS low_nonzero_below_255 FROM mask_odd GROUP BY 1) o JOIN shapes s ON s.package_id=o.package_id""",
)
# Packages whose faces or vertices are wiped out, for the two emptiness rules.
define("wiped", "SELECT package_id, row, col, portable AND package_id%4<>1 AND (package_id%4<>2 OR (row%2=0 AND col%2=0)) AS portable, python_valid<>cpp_finite AS pd, coalesce(python_mask AND NOT positive_finite_z,false) AS rv FROM validity")
define(
    "wiped_facts",
    """SELECT w.package_id, portable_count, point_disagreement_count, revalidated_count, coalesce(face_count,0) AS face_count FROM
      (SELECT package_id, count(*) FILTER (portable) AS portable_count, count(*) FILTER (pd) AS point_disagreement_count, count(*) FILTER (rv) AS revalidated_count FROM wiped GROUP BY 1) w
      LEFT JOIN (SELECT a.package_id, count(*) AS face_count FROM wiped a JOIN wiped b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col+1 AND b.portable
        JOIN wiped c ON c.package_id=a.package_id AND c.row=a.row+1 AND c.col=a.col AND c.portable JOIN wiped d ON d.package_id=a.package_id AND d.row=a.row+1 AND d.col=a.col+1 AND d.portable
        WHERE a.portable GROUP BY 1) q ON q.package_id=w.package_id""",
)


def _register(rules, facts, swap=None):
    for code, sql in rules.items():
        for old, new in (swap or {}).items():
            sql = sql.replace(f"FROM {old} ", f"FROM {new} ")

        @query(f"rule_{code.replace('-', '_')}", sql)
        def run(fx, code=code):
            return facts(fx).where(F.col("code") == code)


def _odd_masks(fx):
    masks = fx.mask_samples.where("NOT (package_id%6=2 AND mrow=99)").selectExpr("package_id", "mrow", "mcol", f"{ODD} AS value")
    rel = M.mask_relation(R.grid_shapes(fx.vertices), masks)
    return C.mask_findings(M.mask_values(masks), rel)


def _wiped(fx):
    keep = (F.col("package_id") % 4 != 1) & ((F.col("package_id") % 4 != 2) | ((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)))
    valid = validity(fx).withColumn("portable", F.col("portable") & keep)
    return C.validity_findings(M.validity_summary(valid), quad_counts(valid, "portable"))


def _boxes(fx):
    return C.bbox_compare(sanitized_metadata(parse_metadata(fx.package_meta)), M.measured_bbox(validity(fx)))


_register(FILE_RULES, lambda fx: C.file_findings(P.file_presence(fx.requested_dirs, fx.files)))
_register(CHANNEL_RULES, lambda fx: C.channel_findings(fx.channels))
_register(SHAPE_RULES, lambda fx: C.shape_findings(C.coordinate_gate(fx.channels)))
_register(META_RULES, lambda fx: C.metadata_findings(fx.package_meta))
_register(COORDINATE_RULES, lambda fx: C.coordinate_findings(M.vertex_counts(M.vertex_flags(fx.vertices))))
_register(MASK_RULES, _odd_masks, {"mask_facts": "odd_facts"})
_register(VALIDITY_RULES, _wiped, {"valid_facts": "wiped_facts"})
_register(BOX_RULES, lambda fx: C.bbox_findings(_boxes(fx)))

# --- whole reports -------------------------------------------------------------------------------

define("pkg", "SELECT DISTINCT package_id FROM grid_raw")
define("pkg_files", "SELECT package_id, f AS filename FROM pkg CROSS JOIN (SELECT unnest(['x.tif','y.tif','z.tif','meta.json','mask.tif']) AS f) ff WHERE NOT (f='mask.tif' AND package_id%3=0) AND NOT (f='y.tif' AND package_id%9=8)")
define("pkg_channels", "SELECT c.* FROM channels c JOIN pkg p ON p.package_id=c.package_id WHERE NOT (channel='mask' AND c.package_id%3=0)")
define("sound", "SELECT g.package_id FROM gate g JOIN pkg p ON p.package_id=g.package_id WHERE decoded AND same_shape")


def _whole_findings() -> str:
    parts = [
        f"SELECT package_id, 'error' AS severity, 'missing-required-file' AS code, f AS file, CAST(NULL AS BIGINT) AS count FROM pkg CROSS JOIN (SELECT unnest(['x.tif','y.tif','z.tif','meta.json']) AS f) ff WHERE NOT EXISTS (SELECT 1 FROM pkg_files k WHERE k.package_id=pkg.package_id AND k.filename=f)"
    ]
    parts += [s.replace("FROM channels ", "FROM pkg_channels ") for s in CHANNEL_RULES.values()]
    parts += [s.replace("FROM gate ", "FROM (SELECT g.* FROM gate g JOIN pkg p ON p.package_id=g.package_id) gg ") for s in SHAPE_RULES.values()]
    parts += list(META_RULES.values())
    for group in (COORDINATE_RULES, MASK_RULES, VALIDITY_RULES, BOX_RULES):
        parts += [f"SELECT * FROM ({s}) WHERE package_id IN (SELECT package_id FROM sound)" for s in group.values()]
    return " UNION ALL ".join(parts)


define("all_findings", _whole_findings())
define(
    "pkg_status",
    """SELECT p.package_id, count(*) FILTER (severity='error') AS errors, count(*) FILTER (severity='warning') AS warnings,
       CASE WHEN count(*) FILTER (severity='error')>0 THEN 'error' WHEN count(*) FILTER (severity='warning')>0 THEN 'warning' ELSE 'pass' END AS status
       FROM pkg p LEFT JOIN all_findings f ON f.package_id=p.package_id GROUP BY 1""",
)


def packages(fx):
    return fx.package_meta.select("package_id")


def whole(fx) -> R.ContractReport:
    names = F.array(*[F.lit(n) for n in (*P.REQUIRED, P.MASK)])
    files = packages(fx).select(F.col("package_id").alias("dir"), F.explode(names).alias("filename")).where(
        "NOT (filename='mask.tif' AND dir%3=0) AND NOT (filename='y.tif' AND dir%9=8)"
    )
    channels = fx.channels.join(packages(fx), "package_id", "left_semi").where("NOT (channel='mask' AND package_id%3=0)")
    return R.contract_report(packages(fx), files, channels, fx.package_meta, fx.vertices, fx.mask_samples)


@query(
    "contract_report",
    """SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code, coalesce(file,'')) AS place FROM all_findings""",
)
def contract(fx):
    return whole(fx).findings


@query(
    "finding_order",
    """SELECT dir, severity, code, file, row_number() OVER (PARTITION BY dir ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code, coalesce(file,'')) AS place
       FROM (""" + " UNION ALL ".join(FILE_RULES.values()) + ")",
)
def finding_order(fx):
    found = C.file_findings(P.file_presence(fx.requested_dirs, fx.files))
    return C.finding_order(found, ["dir"]).select("dir", "severity", "code", "file", "place")


@query(
    "package_status",
    """SELECT s.*, f.vertex_count, f.portable_count, f.face_count FROM pkg_status s LEFT JOIN
       (SELECT c.package_id, vertex_count, portable_count, face_count FROM vcounts c JOIN valid_facts v ON v.package_id=c.package_id JOIN sound o ON o.package_id=c.package_id) f ON f.package_id=s.package_id""",
)
def package_status(fx):
    report = whole(fx)
    return report.status.join(report.facts.select("package_id", "vertex_count", "portable_count", "face_count"), "package_id", "left")


_STATUS = "count(*) AS surfaces, count(*) FILTER (status='pass') AS pass, count(*) FILTER (status='warning') AS warning, count(*) FILTER (status='error') AS error"


@query(
    "scan_summary",
    f"""SELECT s.*, d.n AS duplicate_ids FROM (SELECT {_STATUS} FROM pkg_status) s CROSS JOIN
        (SELECT count(*) AS n FROM (SELECT uuid FROM meta_san WHERE uuid IS NOT NULL GROUP BY 1 HAVING count(*)>1)) d""",
)
def scan_summary(fx):
    found = R.collection_findings(packages(fx), fx.package_meta).where("code = 'duplicate-uuid'")
    counts = C.status_counts(whole(fx).status)
    # Two one-row tables side by side.
    one = F.lit(1).alias("_k")
    return counts.select("*", one).join(found.agg(F.count_distinct("uuid").alias("duplicate_ids")).select("*", one), "_k").drop("_k")


@query("status_counts", f"SELECT {_STATUS} FROM (SELECT CASE WHEN bool_or(severity='error') THEN 'error' ELSE 'warning' END AS status FROM ({' UNION ALL '.join(CHANNEL_RULES.values())}) GROUP BY package_id UNION ALL SELECT 'pass' FROM embeddings WHERE vec_id NOT IN (SELECT package_id FROM ({' UNION ALL '.join(CHANNEL_RULES.values())})))")
def status_counts(fx):
    every = fx.table("embeddings").select(F.col("vec_id").alias("package_id"))
    return C.status_counts(C.package_status(every, C.channel_findings(fx.channels)))


@query(
    "exit_status",
    """SELECT strict, CASE WHEN bool_or(errors>0 OR (strict AND warnings>0)) OR (strict AND (SELECT count(*) FROM meta_san a JOIN meta_san b ON a.uuid=b.uuid AND a.package_id<>b.package_id)>0) THEN 2 ELSE 0 END AS exit_code
       FROM pkg_status CROSS JOIN (SELECT unnest([true,false]) AS strict) s GROUP BY 1""",
)
def exit_status(fx):
    status = materialize(whole(fx).status)
    found = R.collection_findings(packages(fx), fx.package_meta)
    runs = [C.exit_status(status, found, strict).select(F.lit(strict).alias("strict"), "exit_code") for strict in (True, False)]
    return runs[0].unionByName(runs[1])


@query(
    "rule_duplicate_uuid",
    """SELECT 'warning' AS severity, 'duplicate-uuid' AS code, uuid, count, CAST(package_id AS VARCHAR) AS path FROM (SELECT *, count(*) OVER (PARTITION BY uuid) AS count FROM registry_fx WHERE uuid IS NOT NULL AND uuid<>'') WHERE count>1""",
)
def duplicate_uuid(fx):
    return C.duplicate_uuids(fx.registry.select("uuid", F.col("package_id").cast("string").alias("path")))


@query("rule_no_packages", "SELECT 'warning' AS severity, 'no-tifxyz-directories' AS code WHERE (SELECT count(*) FROM files_fx WHERE filename='absent.tif')=0")
def no_packages(fx):
    nothing = fx.files.where("filename = 'absent.tif'").select(F.col("dir").alias("package_id"))
    return R.collection_findings(nothing, fx.package_meta).where("code <> 'duplicate-uuid'").select("severity", "code")


@query(
    "bbox_compare",
    "SELECT package_id, comparable, matches, " + ", ".join(f"round({c},6)+0e0 AS {c}" for c in ("max_delta", "tolerance_x", "tolerance_y", "tolerance_z")) + " FROM box_cmp",
)
def bbox_compare(fx):
    return _boxes(fx).withColumns({c: rounded(F.col(c)) for c in ("max_delta", "tolerance_x", "tolerance_y", "tolerance_z")})


@query(
    "read_metadata",
    """SELECT package_id, readable, lower(root) AS root_type, s.uuid, s.format, s.type, s.scale_x, s.scale_y, CASE WHEN box_ok THEN b0x END AS box_min_x, s.area, s.area_vx2, s.area_cm2,
       CASE WHEN root='OBJECT' THEN o.nonfinite END AS nonfinite_count FROM meta_ok o LEFT JOIN (SELECT package_id AS pid, * EXCLUDE (package_id, nonfinite) FROM meta_san) s ON s.pid=o.package_id""",
)
def read_metadata(fx):
    parsed = parse_metadata(fx.package_meta)
    fields = sanitized_metadata(parsed).select("package_id", "uuid", "format", "type", "scale_x", "scale_y", "box_min_x", "area", "area_vx2", "area_cm2")
    return parsed.select("package_id", "readable", "root_type", "nonfinite_count").join(fields, "package_id", "left")


# --- geometry against metadata, manifests, regressions -------------------------------------------

define("faces", "SELECT package_id, count(*) FILTER (ok) AS n FROM quad GROUP BY 1")
define("surf_box", "SELECT package_id, " + ", ".join(f"{f}({a}) AS {f}_{a}" for f in ("min", "max") for a in "xyz") + " FROM surf WHERE valid AND isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY 1")


@query(
    "metadata_checks",
    """SELECT package_id, scale_x AS declared_scale_x, round(cell_area,6)+0e0 AS cell_area, round(n*cell_area,6)+0e0 AS parametric_area, declared_area,
       CASE WHEN declared_area<>0 THEN round(abs(n*cell_area-declared_area)/declared_area,6)+0e0 END AS area_relative_error,
       CASE WHEN box_ok THEN round(greatest("""
    + ", ".join(f"abs(min_{a}-b0{a}), abs(max_{a}-b1{a})" for a in "xyz")
    + """),6)+0e0 END AS bbox_max_abs_error FROM (SELECT s.package_id, scale_x, 1/(scale_x*scale_y) AS cell_area, f.n, CASE WHEN area_vx2_present THEN area_vx2 ELSE area END AS declared_area,
       box_ok, b0x, b0y, b0z, b1x, b1y, b1z, min_x, min_y, min_z, max_x, max_y, max_z FROM meta_san s LEFT JOIN faces f ON f.package_id=s.package_id LEFT JOIN surf_box b ON b.package_id=s.package_id)""",
)
def metadata_checks(fx):
    from latticeqc.plans.summaries import metadata_checks as checks

    out = checks(fx.surf, sanitized_metadata(parse_metadata(fx.package_meta)))
    return out.withColumns({c: rounded(F.col(c)) for c in ("cell_area", "parametric_area", "area_relative_error", "bbox_max_abs_error")})


MANIFEST = [
    "dir", "filename",
    "concat(CASE WHEN doc_id%19=3 THEN 'http' ELSE 'https' END, '://host/', filename) AS url",
    "CASE WHEN doc_id%7=1 THEN NULL WHEN doc_id%13=2 THEN n_chars+1 ELSE n_chars END AS bytes",
]


@query(
    "verify_manifest",
    f"""SELECT coalesce(e.dir,o.dir) AS dir, coalesce(e.filename,o.filename) AS filename, CASE WHEN e.dir IS NULL THEN 'unlisted' WHEN NOT starts_with(url,'https://') THEN 'insecure-url'
       WHEN o.dir IS NULL THEN 'missing' WHEN e.bytes IS NOT NULL AND e.bytes<>o.bytes THEN 'size-mismatch' WHEN e.sha<>o.sha THEN 'hash-mismatch' ELSE 'verified' END AS status
       FROM (SELECT {', '.join(MANIFEST)}, sha256(CASE WHEN doc_id%23=4 THEN 'other' ELSE text END) AS sha FROM manifest_docs WHERE doc_id%29<>5) e
       FULL JOIN (SELECT dir, filename, bytes, sha256(content) AS sha FROM files_fx) o ON o.dir=e.dir AND o.filename=e.filename""".replace("manifest_docs", "(SELECT m.*, dir, filename FROM (SELECT *, concat(CASE WHEN CAST(floor(doc_id/8) AS BIGINT)%3=0 THEN 'same_wrap_' ELSE 'other_' END, CAST(CAST(floor(doc_id/8) AS BIGINT) AS VARCHAR)) AS dir, CASE CAST(doc_id%8 AS INT) WHEN 0 THEN 'x.tif' WHEN 1 THEN 'y.tif' WHEN 2 THEN 'z.tif' WHEN 3 THEN 'meta.json' WHEN 4 THEN 'mask.tif' WHEN 5 THEN 'notes.txt' WHEN 6 THEN 'report.json' ELSE 'index.json' END AS filename FROM documents) m)"),
)
def verify_manifest(fx):
    from latticeqc.queries.fixtures import DIR_NAME, FILE_NAME

    listed = fx.table("documents").selectExpr("*", f"{DIR_NAME} AS dir", f"{FILE_NAME} AS filename").where("doc_id%29<>5")
    expected = listed.selectExpr(*MANIFEST, "sha2(CASE WHEN doc_id%23=4 THEN 'other' ELSE text END, 256) AS sha256")
    observed = fx.files.selectExpr("dir", "filename", "bytes", "sha2(content, 256) AS sha256")
    return P.verify_manifest(expected, observed, ["dir", "filename"])


@query(
    "regression_expectations",
    """SELECT package_id, status_ok, faces_ok, codes_ok, status_ok AND faces_ok AND codes_ok AS passed FROM (SELECT s.package_id, s.status=CASE WHEN s.package_id%2=0 THEN 'error' ELSE 'warning' END AS status_ok,
       coalesce(CASE WHEN o.package_id IS NOT NULL THEN v.face_count END=CASE WHEN s.package_id%3=0 THEN 2716 ELSE 2712 END,false) AS faces_ok,
       (SELECT count(DISTINCT code) FROM all_findings f WHERE f.package_id=s.package_id AND code IN ('partial-sentinel','nonfinite-coordinate'))=2 AS codes_ok
       FROM pkg_status s LEFT JOIN valid_facts v ON v.package_id=s.package_id LEFT JOIN sound o ON o.package_id=s.package_id)""",
)
def regression_expectations(fx):
    from latticeqc.plans.summaries import regression_expectations as check

    expected = packages(fx).selectExpr(
        "package_id", "CASE WHEN package_id%2=0 THEN 'error' ELSE 'warning' END AS want_status",
        "CASE WHEN package_id%3=0 THEN 2716 ELSE 2712 END AS want_faces", "array('partial-sentinel','nonfinite-coordinate') AS want_codes",
    )
    report = whole(fx)
    return check(expected, report.status, report.facts, report.findings)


@query(
    "registry_census",
    """SELECT sample, variant, count(*) AS packages, count(DISTINCT uuid) AS uuids, count(*)-count(DISTINCT uuid) AS surplus, count(area) AS with_area,
       count(area_vx2) AS with_area_vx2, count(*) FILTER (area IS NULL AND area_vx2 IS NOT NULL) AS divergent FROM registry_fx GROUP BY 1,2""",
)
def registry_census(fx):
    from latticeqc.plans.summaries import registry_census as census

    return census(fx.registry)

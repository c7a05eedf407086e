"""Geometry findings, example lists, cue unions and whole geometry reports."""

from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.functions.numeric import finite_or_null, rounded
from latticeqc.operators import components as C
from latticeqc.operators import geometry as G
from latticeqc.operators import grid
from latticeqc.plans.full_review import DOUBLE, SINGLE, full_review
from latticeqc.plans import geometry_report as R
from latticeqc.plans import reporting as P
from latticeqc.queries.contract_queries import whole
from latticeqc.queries.grid_queries import CFG, K, METRIC_SQL, cells, frame
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import above, below, r6
from latticeqc.queries.topology_queries import DIGEST_SQL, REGION_RANKS, component_blocks, near_pairs
from latticeqc.session import materialize

# --- SQL: one summary row per package ------------------------------------------------------------

define(
    "std_pairs",
    """SELECT a.package_id, a.row AS a_row, a.col AS a_col, b.row AS b_row, b.col AS b_col FROM usable a JOIN refs r ON r.package_id=a.package_id
       JOIN usable b ON b.package_id=a.package_id AND (b.row>a.row OR (b.row=a.row AND b.col>a.col)) WHERE greatest(abs(a.row-b.row),abs(a.col-b.col))>4
       AND sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))<25e-2*sqrt(obs_h*obs_v)""",
)
define("usable", "SELECT package_id, row, col, x, y, z FROM surf WHERE valid AND isfinite(x) AND isfinite(y) AND isfinite(z)")
define(
    "integrity",
    """SELECT package_id, count(*) FILTER (valid AND NOT (isfinite(x) AND isfinite(y) AND isfinite(z))) AS nonfinite_valid,
       count(*) FILTER ((x=-1 OR y=-1 OR z=-1) AND NOT (x=-1 AND y=-1 AND z=-1)) AS partial_sentinel,
       count(*) FILTER (explicit_mask IS NOT NULL AND valid<>(isfinite(z) AND z>0)) AS mask_disagreement FROM surf GROUP BY 1""",
)
define(
    "cell_count",
    """SELECT package_id, count(*) FILTER (ok) AS valid_quads, CAST(sum(CAST(degenerate_a AS INT)+CAST(degenerate_b AS INT)) AS BIGINT) AS degenerate_triangles, count(*) FILTER (folded) AS folded_quads,
       count(*) FILTER (split_sensitive) AS split_sensitive, count(*) FILTER (high_condition) AS high_condition, count(*) FILTER (high_stretch) AS high_stretch,
       count(*) FILTER (low_area OR high_area) AS area_distortion, count(*) FILTER (high_shear) AS high_shear, count(*) FILTER (high_dirichlet) AS high_dirichlet FROM cells GROUP BY 1""",
)
define("edge_count", "SELECT package_id, count(*) FILTER (long) AS long_edges, count(*) FILTER (short) AS short_edges FROM edge_ratio GROUP BY 1")
define("jump_count", "SELECT package_id, count(*) FILTER (jump) AS normal_jumps FROM jumps GROUP BY 1")
define(
    "geo_facts",
    """SELECT i.*, c.* EXCLUDE (package_id), long_edges, short_edges, coalesce(normal_jumps,0) AS normal_jumps, coalesce(vcn,0) AS vertex_components, coalesce(hn,0) AS enclosed_regions,
       coalesce(bn,0) AS coherent_components, coalesce(bcells,0) AS coherent_cells, coalesce(pn,0) AS pair_count
       FROM integrity i JOIN cell_count c ON c.package_id=i.package_id JOIN edge_count e ON e.package_id=i.package_id LEFT JOIN jump_count j ON j.package_id=i.package_id
       LEFT JOIN (SELECT package_id, count(*) AS vcn FROM vc_size GROUP BY 1) v ON v.package_id=i.package_id
       LEFT JOIN (SELECT package_id, count(DISTINCT label) AS hn FROM holes GROUP BY 1) h ON h.package_id=i.package_id
       LEFT JOIN (SELECT package_id, count(*) AS bn, CAST(sum(size) AS BIGINT) AS bcells FROM bc_size WHERE size>=8 GROUP BY 1) b ON b.package_id=i.package_id
       LEFT JOIN (SELECT package_id, count(*) AS pn FROM std_pairs GROUP BY 1) p ON p.package_id=i.package_id""",
)
RULES = {c: r for c, r in R.FINDING_RULES.items() if not c.startswith("global-spacing")}
define("geo_findings", " UNION ALL ".join(f"SELECT package_id, '{level}' AS level, '{code}' AS code FROM geo_facts WHERE {hit}" for code, (level, hit) in RULES.items()))

# --- one query per cue ---------------------------------------------------------------------------


def _cue(code, facts, table):
    level, hit = R.FINDING_RULES[code]

    @query(f"cue_{code.replace('-', '_')}", f"SELECT package_id, '{level}' AS level, '{code}' AS code FROM {table} WHERE {hit.replace('D', 'e0') if 'spacing' in code else hit}")
    def run(fx):
        return R.geometry_findings(facts(fx), codes=[code])


def _counted(fx):
    return G.cell_counts(frame(fx), CFG)


for _code in ("nonfinite-valid", "partial-sentinel", "mask-coordinate-disagreement"):
    _cue(_code, lambda fx: G.vertex_integrity(fx.surf), "integrity")
for _code in (
    "degenerate-triangles", "folded-quads", "triangulation-sensitive", "anisotropic-cells", "symmetric-stretch", "area-distortion", "high-shear", "high-distortion",
):
    _cue(_code, _counted, "cell_count")
_cue("long-edges", _counted, "edge_count")
# The surfaces have no edge of half the median length; the rule is shown with a narrower limit.
NARROW = ReviewConfig(short_edge_ratio=0.98)
_cue(
    "short-edges",
    lambda fx: G.cell_counts(G.surface_frame(fx.surf, G.spacing_reference(fx.surf, NARROW), NARROW), NARROW),
    "(SELECT package_id, count(*) FILTER (ratio<98e-2) AS short_edges FROM edge_ratio GROUP BY 1)",
)
_cue("normal-jumps", _counted, "jump_count")
TARGET = ReviewConfig(expected_spacing_x=0.8, expected_spacing_y=1.1)
define("spaced", "SELECT package_id, sqrt(fx*fy) AS isotropic, greatest(fx/fy,fy/fx) AS anisotropy FROM (SELECT package_id, obs_h/8e-1 AS fx, obs_v/11e-1 AS fy FROM refs)")
_cue("global-spacing-anisotropy", lambda fx: G.target_spacing(G.spacing_reference(fx.surf, TARGET), TARGET), "spaced")
FAR_TARGET = ReviewConfig(expected_spacing_x=0.5, expected_spacing_y=0.5)
_cue(
    "global-spacing-drift",
    lambda fx: G.target_spacing(G.spacing_reference(fx.surf, FAR_TARGET), FAR_TARGET),
    "(SELECT package_id, sqrt((obs_h/5e-1)*(obs_v/5e-1)) AS isotropic FROM refs)",
)


def _sized(name, table):
    return f"(SELECT package_id, count(*) AS {name} FROM {table} GROUP BY 1)"


# Without every ninth column the valid vertices fall apart in strips.
STRIPS = "valid AND col%9<>3"
component_blocks("strip", f"SELECT package_id, row, col FROM surf WHERE {STRIPS}", 4)
_cue("disconnected-vertices", lambda fx: C.component_sizes(C.label_runs(fx.surf.where(STRIPS))).groupBy("package_id").agg(F.count("*").alias("vertex_components")), _sized("vertex_components", "strip_size"))
_cue(
    "enclosed-gaps",
    lambda fx: R.hole_runs(grid.quad_cells(fx.surf), R.cell_shapes(fx.surf)).groupBy("package_id").agg(F.count_distinct("label").alias("enclosed_regions")),
    "(SELECT package_id, count(DISTINCT label) AS enclosed_regions FROM holes GROUP BY 1)",
)
_cue(
    "coherent-normal-step",
    lambda fx: C.component_sizes(R.coherent_bands(frame(fx), CFG)).groupBy("package_id").agg(F.count("*").alias("coherent_components")),
    "(SELECT package_id, count(*) AS coherent_components FROM bc_size WHERE size>=8 GROUP BY 1)",
)
_cue("nonlocal-proximity", lambda fx: near_pairs(fx).groupBy("package_id").agg(F.count("*").alias("pair_count")), _sized("pair_count", "near_pairs"))

# --- example lists -------------------------------------------------------------------------------

_TWO = {"long-edges": ("long", "ratio", "DESC"), "short-edges": ("short", "ratio", "ASC")}
define(
    "flagged",
    " UNION ALL ".join(
        [f"SELECT package_id, '{c}' AS cue, direction AS tag, row, col, ratio AS v, {d == 'DESC'} AS largest FROM edge_ratio WHERE {f}" for c, (f, _, d) in _TWO.items()]
        + [f"SELECT package_id, 'degenerate-triangles' AS cue, 'official_{t}' AS tag, row, col, sine_{t} AS v, false AS largest FROM cells WHERE degenerate_{t}" for t in "ab"]
        + [f"SELECT package_id, '{c}' AS cue, direction AS tag, row, col, angle AS v, true AS largest FROM jumps WHERE {f}" for c, f in (("normal-jumps", "jump"), ("orientation-flips", "flip"))]
        + ["SELECT package_id, 'normal-steps' AS cue, direction AS tag, row, col, score AS v, true AS largest FROM step_hits"]
        + [
            f"SELECT package_id, '{c}' AS cue, '' AS tag, row, col, {v} AS v, {str(big).lower()} AS largest FROM cells WHERE {f}"
            for c, f, v, big in (
                ("folded-quads", "folded", "fold_cosine", False), ("triangulation-sensitive", "split_sensitive", "sensitive_value", False),
                ("anisotropic-cells", "high_condition", "condition_number", True), ("symmetric-stretch", "high_stretch", "symmetric_stretch", True),
                ("low-area-ratio", "low_area", "area_ratio", False), ("high-area-ratio", "high_area", "area_ratio", True),
                ("high-shear", "high_shear", "shear", True), ("high-distortion", "high_dirichlet", "symmetric_dirichlet", True),
            )
        ]
    ),
)
# Values compared at nine digits, so that equal locations rank equally in both engines.
define(
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY package_id, cue, tag ORDER BY CASE WHEN largest THEN -w ELSE w END, CASE WHEN largest THEN -row ELSE row END, CASE WHEN largest THEN -col ELSE col END) AS rank
       FROM (SELECT *, CASE WHEN isnan(v) THEN CAST('NaN' AS DOUBLE) ELSE round(v,9) END AS w FROM flagged)""",
)
LISTED = "CASE WHEN isfinite(w) THEN round(w,6)+0e0 END AS value, CASE WHEN isnan(w) THEN 'nan' WHEN isinf(w) AND w>0 THEN 'positive_infinity' WHEN isinf(w) THEN 'negative_infinity' END AS nonfinite"


def _found(fx, cues):
    return G.example_candidates(frame(fx), cues, CFG).withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(F.round("value", 9)))


def _names(cues):
    return ",".join(f"'{c}'" for c in cues)


def _out(df):
    value, tag = G.tagged_value(F.col("value"))
    return df.select("package_id", "cue", "tag", "rank", "row", "col", rounded(value).alias("value"), tag.alias("nonfinite"))


@query("top_locations", f"SELECT package_id, cue, tag, rank, row, col, {LISTED} FROM ranked WHERE rank<=50 AND cue IN ({_names(SINGLE)})")
def top_locations(fx):
    return _out(G.top_locations(_found(fx, SINGLE), 50))


@query(
    "merged_examples",
    f"""SELECT package_id, cue, tag, place AS rank, row, col, {LISTED} FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY package_id, cue ORDER BY CASE WHEN isfinite(w) THEN 1 ELSE 0 END,
       CASE WHEN NOT isfinite(w) THEN 0e0 WHEN largest THEN -w ELSE w END, tag, row, col) AS place FROM ranked WHERE rank<=25 AND cue IN ({_names(DOUBLE)})) WHERE place<=50""",
)
def merged_examples(fx):
    return _out(G.merged_examples(_found(fx, DOUBLE)))


@query("area_ratio_examples", f"SELECT package_id, cue, tag, rank, row, col, {LISTED} FROM ranked WHERE rank<=10 AND cue IN ('low-area-ratio','high-area-ratio')")
def area_ratio_examples(fx):
    return _out(G.top_locations(_found(fx, ["low-area-ratio", "high-area-ratio"]), 10))


# --- cue sets ------------------------------------------------------------------------------------


@query("cue_union", "SELECT DISTINCT package_id, row, col FROM (SELECT package_id, row, col FROM cells WHERE folded UNION ALL SELECT package_id, row, col FROM cells WHERE high_shear UNION ALL SELECT package_id, row, col FROM local_cells WHERE jump_cue)")
def cue_union(fx):
    # One frame, several flags: the union of families is an OR, not a union of scans.
    return G.cells_where(frame(fx), "folded OR high_shear OR jump_cue")


@query("mask_intersection", "SELECT l.package_id, l.row, l.col FROM local_cells l JOIN annotated a ON a.package_id=l.package_id AND a.row=l.row AND a.col=l.col WHERE local_cue AND ok")
def mask_intersection(fx):
    from latticeqc.sources.annotations import neighborhoods

    near = neighborhoods(fx.annotations.where("valid"), R.cell_shapes(fx.vertices), radius=1)
    return G.cells_where(frame(fx), "local_cue AND cell_valid").join(near, K, "left_semi")


define("band_set", "SELECT DISTINCT package_id, row, col FROM band_cells")


@query("mask_difference", "SELECT b.package_id, b.row, b.col FROM band_set b JOIN local_cells l ON l.package_id=b.package_id AND l.row=b.row AND l.col=b.col WHERE NOT local_cue")
def mask_difference(fx):
    every = materialize(cells(fx).select(*K, "cell", "step_candidate", "local_cue"))
    bands = C.expand_runs(R.coherent_bands(every, CFG)).select(*K)
    return bands.join(every.where("local_cue"), K, "left_anti")


# --- whole reports -------------------------------------------------------------------------------


@query("geometry_report", "SELECT package_id, level, code FROM geo_findings")
def geometry_report(fx):
    return R.geometry_report(fx.surf, CFG).findings


NEAR_CELLS = """SELECT DISTINCT e.package_id, e.row-i AS row, e.col-j AS col FROM (SELECT package_id, a_row AS row, a_col AS col FROM std_pairs UNION SELECT package_id, b_row, b_col FROM std_pairs) e
  CROSS JOIN (SELECT unnest([0,1]) AS i) ii CROSS JOIN (SELECT unnest([0,1]) AS j) jj"""
define("near_cells", NEAR_CELLS)
define(
    "final_cells",
    """SELECT s.package_id, s.row, s.col, local_cue OR (n.row IS NOT NULL AND ok) AS cue_before, local_cue OR (n.row IS NOT NULL AND ok) OR b.row IS NOT NULL AS cue, b.row IS NOT NULL AS band,
       CASE WHEN (n.row IS NOT NULL AND ok) OR b.row IS NOT NULL THEN 1e0 ELSE local_score END AS score FROM scored_cells s
       LEFT JOIN near_cells n ON n.package_id=s.package_id AND n.row=s.row AND n.col=s.col LEFT JOIN band_set b ON b.package_id=s.package_id AND b.row=s.row AND b.col=s.col""",
)


@query("cue_mask_before_new_family", f"SELECT package_id, row, col, cue_before, cue, {r6('score')} AS score FROM final_cells")
def cue_mask_before_new_family(fx):
    return R.geometry_report(fx.surf, CFG).cells.select(*K, "cue_before", "cue", rounded(F.col("score")).alias("score"))


define("cue_text", "SELECT package_id, row, col, CASE WHEN cue THEN '1' ELSE '0' END AS text FROM final_cells")
define("cue_digest", DIGEST_SQL.format(text="text", source="cue_text"))
SIGNED = "valid_quads, long_edges, short_edges, degenerate_triangles, folded_quads, normal_jumps, coherent_components, coherent_cells, high_condition, high_stretch, high_dirichlet, area_distortion, high_shear, pair_count"


@query(
    "audit_signature",
    f"""SELECT g.package_id, {SIGNED}, codes, d.digest AS cue_digest FROM geo_facts g JOIN (SELECT package_id, string_agg(code,',' ORDER BY code) AS codes FROM geo_findings GROUP BY 1) c ON c.package_id=g.package_id
       JOIN cue_digest d ON d.package_id=g.package_id""",
)
def audit_signature(fx):
    return R.signature(R.geometry_report(fx.surf, CFG))


def _review(fx):
    return full_review(fx.surf, CFG)


@query("review_distributions", METRIC_SQL)
def review_distributions(fx):
    rows = _review(fx).distributions
    return rows.select("package_id", "metric", "count", *[rounded(F.col(c)).alias(c) for c in ("min", "p05", "p50", "p95", "max")])


@query("review_locations", f"SELECT package_id, cue, tag, rank, row, col, {LISTED} FROM ranked WHERE rank<=50 AND cue IN ({_names(SINGLE)})")
def review_locations(fx):
    return _out(_review(fx).locations)


@query("review_regions", REGION_RANKS)
def review_regions(fx):
    return _review(fx).regions.withColumns({c: rounded(F.col(c)) for c in ("centroid_row", "centroid_col")})


@query(
    "benchmark_snapshot",
    """SELECT g.package_id, s.status AS contract_status, CAST(s.errors AS BIGINT) AS contract_errors, vertex_components, enclosed_regions, long_edges, folded_quads, normal_jumps, high_shear, codes FROM geo_facts g
       JOIN pkg_status s ON s.package_id=g.package_id JOIN (SELECT package_id, string_agg(code,',' ORDER BY code) AS codes FROM geo_findings GROUP BY 1) c ON c.package_id=g.package_id""",
)
def benchmark_snapshot(fx):
    report = R.geometry_report(fx.surf, CFG)
    codes = report.findings.groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    contract = whole(fx).status.select("package_id", F.col("status").alias("contract_status"), F.col("errors").alias("contract_errors"))
    facts = ["vertex_components", "enclosed_regions", "long_edges", "folded_quads", "normal_jumps", "high_shear"]
    return report.summary.select("package_id", *facts).join(contract, "package_id").join(codes, "package_id")


@query("finding_prevalence", "SELECT code, count(DISTINCT package_id) AS packages FROM all_findings GROUP BY 1")
def finding_prevalence(fx):
    return whole(fx).findings.select("package_id", "code").distinct().groupBy("code").agg(F.count("*").alias("packages"))


_TEXTS = {
    "Grid shape": "concat(height,' x ',width)", "Valid vertices": "format('{:,}',valid_count)", "Valid quads": "format('{:,}',valid_quads)",
    "Vertex components": "format('{:,}',vertex_components)", "Enclosed gaps": "format('{:,}',enclosed_regions)", "Long / short edges": "concat(long_edges,' / ',short_edges)",
    "Folded quads": "format('{:,}',folded_quads)", "Normal jumps": "format('{:,}',normal_jumps)", "Nonlocal pairs": "format('{:,}',pair_count)",
    "Area": "format('{:,}.{:03d}',CAST(floor(round(area*1000)/1000) AS BIGINT),CAST(round(area*1000) AS BIGINT)%1000)",
}


@query(
    "headline_rows",
    f"""SELECT package_id, u.label, u.value FROM (SELECT g.package_id, unnest([{','.join(f"{{'label': '{k}', 'value': {v}}}" for k, v in _TEXTS.items())}]) AS u FROM geo_facts g
       JOIN (SELECT package_id, max(row)+1 AS height, max(col)+1 AS width, count(*) FILTER (valid) AS valid_count FROM surf GROUP BY 1) s ON s.package_id=g.package_id
       JOIN (SELECT package_id, coalesce(sum(area) FILTER (isfinite(area)),0) AS area FROM cells GROUP BY 1) a ON a.package_id=g.package_id)""",
)
def headline_rows(fx):
    return P.headline_rows(R.geometry_report(fx.surf, CFG).summary)

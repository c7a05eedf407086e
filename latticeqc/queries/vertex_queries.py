"""Row predicates on vertices and masks."""

from pyspark.sql import functions as F

from latticeqc.functions.numeric import rounded
from latticeqc.operators import masks as M
from latticeqc.queries.registry import define, query
from latticeqc.queries.sql import fin
from latticeqc.session import materialize
from latticeqc.sources.surfaces import grid_shapes

define(
    "flags",
    f"""SELECT *, finite_x AND finite_y AND finite_z AS finite_all, sentinel_any AND NOT sentinel_all AS partial_sentinel,
      NOT isnan(z) AND z<=0 AND NOT sentinel_all AS nonpositive_z, finite_z AND z>0 AS positive_finite_z FROM (
      SELECT *, isfinite(x) AS finite_x, isfinite(y) AS finite_y, isfinite(z) AS finite_z, isnan(x) OR isnan(y) OR isnan(z) AS any_nan,
        x=-1 AND y=-1 AND z=-1 AS sentinel_all, x=-1 OR y=-1 OR z=-1 AS sentinel_any FROM vertices)""",
)
define(
    "resampled",
    f"""SELECT m.package_id, CAST(floor(mrow/(mask_height/height)) AS INT) AS row, CAST(floor(mcol/(mask_width/width)) AS INT) AS col,
      bool_and(NOT isnan(value) AND value>=255) AS retained
      FROM mask_samples m JOIN relation r ON r.package_id=m.package_id WHERE relation IN ('exact','integer_multiple') GROUP BY 1,2,3""",
)
define(
    "validity",
    """SELECT *, python_valid AND cpp_finite AS portable FROM (SELECT *, cpp_valid AND finite_all AND NOT sentinel_any AS cpp_finite FROM (
      SELECT f.*, m.value<>0 AS python_mask, coalesce(m.value<>0, positive_finite_z) AS python_valid,
        NOT (NOT isnan(z) AND z<=0) AND NOT any_nan AND NOT sentinel_all AND coalesce(retained,true) AS cpp_valid
      FROM flags f JOIN relation r ON r.package_id=f.package_id
      LEFT JOIN mask_samples m ON r.relation='exact' AND m.package_id=f.package_id AND m.mrow=f.row AND m.mcol=f.col
      LEFT JOIN resampled s ON s.package_id=f.package_id AND s.row=f.row AND s.col=f.col))""",
)

FLAGS = ["finite_x", "finite_y", "finite_z", "finite_all", "any_nan", "sentinel_all", "sentinel_any", "partial_sentinel", "nonpositive_z", "positive_finite_z"]


@query("vertex_flags", f"SELECT package_id, row, col, {', '.join(FLAGS)} FROM flags")
def vertex_flags(fx):
    return M.vertex_flags(fx.vertices).select("package_id", "row", "col", *FLAGS)


COUNTS_SQL = """SELECT package_id, CAST(max(row)+1 AS BIGINT) AS height, CAST(max(col)+1 AS BIGINT) AS width, count(*) AS vertex_count,
  count(*) FILTER (finite_all) AS finite_count, count(*) FILTER (NOT finite_all) AS nonfinite_count,
  count(*) FILTER (NOT finite_x) AS nonfinite_x, count(*) FILTER (NOT finite_y) AS nonfinite_y, count(*) FILTER (NOT finite_z) AS nonfinite_z,
  count(*) FILTER (sentinel_all) AS sentinel_count, count(*) FILTER (partial_sentinel) AS partial_sentinel_count,
  count(*) FILTER (nonpositive_z) AS noncanonical_count FROM flags GROUP BY 1"""
define("vcounts", COUNTS_SQL)


@query("vertex_counts", COUNTS_SQL)
def vertex_counts(fx):
    return M.vertex_counts(M.vertex_flags(fx.vertices))


def relation(fx):
    return materialize(M.mask_relation(grid_shapes(fx.vertices), fx.mask_samples))


def validity(fx):
    return M.validity(fx.vertices, fx.mask_samples, relation(fx))


def _model(name, column):
    @query(name, f"SELECT package_id, row, col, {column} AS valid FROM validity")
    def run(fx):
        return validity(fx).select("package_id", "row", "col", F.col(column).alias("valid"))


_model("python_valid", "python_valid")
_model("cpp_valid", "cpp_valid")
_model("cpp_finite_point", "cpp_finite")


@query(
    "portable_valid",
    "SELECT package_id, row, col, portable, python_valid<>cpp_valid AS mask_disagrees, python_valid<>cpp_finite AS point_disagrees FROM validity",
)
def portable_valid(fx):
    return validity(fx).select(
        "package_id",
        "row",
        "col",
        "portable",
        M.differs("python_valid", "cpp_valid").alias("mask_disagrees"),
        M.differs("python_valid", "cpp_finite").alias("point_disagrees"),
    )


define(
    "vsummary",
    """SELECT package_id, count(*) FILTER (python_valid) AS python_valid_count, count(*) FILTER (cpp_valid) AS cpp_valid_count,
      count(*) FILTER (cpp_finite) AS cpp_finite_count, count(*) FILTER (python_valid<>cpp_valid) AS mask_disagreement_count,
      count(*) FILTER (python_valid<>cpp_finite) AS point_disagreement_count, count(*) FILTER (portable) AS portable_count,
      count(*) FILTER (coalesce(python_mask AND NOT positive_finite_z,false)) AS revalidated_count FROM validity GROUP BY 1""",
)


@query(
    "validity_summary",
    """SELECT s.*, relation, CASE WHEN relation='exact' THEN 'exact-size mask != 0' ELSE 'finite(z) and z > 0' END AS python_rule
       FROM vsummary s JOIN relation r ON r.package_id=s.package_id""",
)
def validity_summary(fx):
    rel = relation(fx)
    rule = F.when(F.col("relation") == "exact", "exact-size mask != 0").otherwise("finite(z) and z > 0")
    return (
        M.validity_summary(M.validity(fx.vertices, fx.mask_samples, rel))
        .join(rel.select("package_id", "relation"), "package_id")
        .withColumn("python_rule", rule)
    )


@query(
    "mask_relation",
    """SELECT package_id, height, width, mask_height, mask_width, relation,
       CASE WHEN relation IN ('exact','integer_multiple') THEN CAST(mask_height//height AS BIGINT) END AS factor_y,
       CASE WHEN relation IN ('exact','integer_multiple') THEN CAST(mask_width//width AS BIGINT) END AS factor_x FROM relation""",
)
def mask_relation(fx):
    return M.mask_relation(grid_shapes(fx.vertices), fx.mask_samples)


@query("mask_resample", "SELECT package_id, row, col, retained FROM resampled")
def mask_resample(fx):
    return M.mask_resample(fx.mask_samples, relation(fx))


define(
    "mvalues",
    f"""SELECT package_id, count(*) FILTER ({fin('value')} AND value=0) AS zero, count(*) FILTER ({fin('value')} AND value<>0 AND value<255) AS low_nonzero_below_255,
      count(*) FILTER ({fin('value')} AND value>=255) AS at_least_255, count(*) FILTER (NOT {fin('value')}) AS nonfinite FROM mask_samples GROUP BY 1""",
)


@query("mask_values", "SELECT * FROM mvalues")
def mask_values(fx):
    return M.mask_values(fx.mask_samples)


BOX = ", ".join(f"{f}({c}) FILTER (portable) AS {f}_{c}" for f in ("min", "max") for c in "xyz")
define("bbox", f"SELECT package_id, {BOX} FROM validity GROUP BY 1")


@query("bbox_measured", "SELECT package_id, " + ", ".join(f"round({f}_{c},6)+0e0 AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM bbox")
def bbox_measured(fx):
    box = M.measured_bbox(validity(fx))
    return box.select("package_id", *[rounded(F.col(c)).alias(c) for c in box.columns[1:]])


@query(
    "load_surface",
    "SELECT package_id, row, col, CASE WHEN isfinite(x) THEN round(x,6)+0e0 END AS x, round(y,6)+0e0 AS y, round(z,6)+0e0 AS z, valid, explicit_mask FROM surf",
)
def load_surface(fx):
    x = F.col("x")
    return fx.surf.select(
        "package_id", "row", "col", F.when(~F.isnan(x), rounded(x)).alias("x"), rounded(F.col("y")).alias("y"), rounded(F.col("z")).alias("z"), "valid", "explicit_mask"
    )

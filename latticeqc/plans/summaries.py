"""Summaries that combine report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import is_finite
from latticeqc.operators.grid import quad_counts


def metadata_checks(surf: DataFrame, meta: DataFrame) -> DataFrame:
    """Declared against derived area and bounds of the loaded surface, one row per readable metadata object."""
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    box = surf.where(F.col("valid") & finite).groupBy("package_id").agg(
        *[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    )
    joined = meta.join(quad_counts(surf), "package_id", "left").join(box, "package_id", "left")
    cell = "try_divide(1D, scale_x * scale_y)"
    declared = "CASE WHEN area_vx2_present THEN area_vx2 ELSE area END"
    gaps = ", ".join(f"abs({e}_{a} - box_{e}_{a})" for e in ("min", "max") for a in "xyz")
    return joined.selectExpr(
        "package_id",
        "scale_x AS declared_scale_x",
        f"{cell} AS cell_area",
        f"face_count * {cell} AS parametric_area",
        f"{declared} AS declared_area",
        f"try_divide(abs(face_count * {cell} - {declared}), {declared}) AS area_relative_error",
        f"CASE WHEN box_min_x IS NOT NULL AND min_x IS NOT NULL THEN greatest({gaps}) END AS bbox_max_abs_error",
    )


def regression_expectations(expected: DataFrame, status: DataFrame, facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Per case: status, face count and a required subset of finding codes, and whether all hold."""
    found = findings.select("package_id", "code").distinct()
    wanted = expected.select("package_id", F.explode("want_codes").alias("code")).distinct()
    missing = wanted.join(found, ["package_id", "code"], "left_anti").groupBy("package_id").agg(F.count("*").alias("missing"))
    no = F.lit(False)
    joined = (
        expected.join(status, "package_id").join(facts.select("package_id", "face_count"), "package_id", "left")
        .join(missing, "package_id", "left")
    )
    checks = joined.select(
        "package_id",
        (F.col("status") == F.col("want_status")).alias("status_ok"),
        F.coalesce(F.col("face_count") == F.col("want_faces"), no).alias("faces_ok"),
        F.col("missing").isNull().alias("codes_ok"),
    )
    return checks.withColumn("passed", F.col("status_ok") & F.col("faces_ok") & F.col("codes_ok"))


def registry_census(registry: DataFrame) -> DataFrame:
    """Packages, distinct ids and presence of the area fields by sample and variant."""
    return registry.groupBy("sample", "variant").agg(
        F.count("*").alias("packages"),
        F.count_distinct("uuid").alias("uuids"),
        (F.count("*") - F.count_distinct("uuid")).alias("surplus"),
        F.count("area").alias("with_area"),
        F.count("area_vx2").alias("with_area_vx2"),
        F.count_if(F.col("area").isNull() & F.col("area_vx2").isNotNull()).alias("divergent"),
    )


def load_failures(gate: DataFrame) -> DataFrame:
    """Packages the geometry review cannot load, as findings instead of a failed job."""
    return gate.where("NOT (decoded AND same_shape)").selectExpr(
        "package_id", "'error' AS severity", "'geometry-load-failed' AS code"
    )


def preregistered(vertices: DataFrame, height: int, width: int, valid_vertices: int) -> DataFrame:
    """Rules a fixture surface has to meet before it is used, one row per package."""
    from latticeqc.operators.masks import vertex_flags
    from latticeqc.operators.project import boundary_counts

    off = lambda a: F.isnan(a) | (F.col(a) != -1)
    planes = vertex_flags(vertices).groupBy("package_id").agg(
        (F.count_if(~F.col("finite_all")) == 0).alias("finite_ok"),
        ((F.count_if(off("x") != off("y")) == 0) & (F.count_if(off("x") != off("z")) == 0)).alias("sentinels_agree"),
    )
    edge = boundary_counts(vertices).selectExpr(
        "package_id", f"height = {height} AND width = {width} AS shape_ok", f"valid_vertices = {valid_vertices} AS vertices_ok",
        "added_quads = last_row_quads + last_col_quads - corner_quad AS boundary_ok",
    )
    return edge.join(planes, "package_id")


def trace_integrity(meta: DataFrame, logs: DataFrame, key: str) -> DataFrame:
    """Metadata area is a finite non-negative number and equals the area the log ends with."""
    from latticeqc.sources.metadata import json_number

    parsed = meta.withColumn("v", F.try_parse_json("raw_json")).select(key, json_number("$.area_vx2").alias("area"))
    area_ok = F.coalesce(F.col("area") >= 0, F.lit(False))
    close = F.abs(F.col("area") - F.col("final_area_vx2")) <= 1e-9
    return parsed.join(logs, key).select(
        key, F.col("complete").alias("log_ok"), area_ok.alias("area_ok"), F.coalesce(area_ok & F.col("complete") & close, F.lit(False)).alias("area_matches_log")
    )

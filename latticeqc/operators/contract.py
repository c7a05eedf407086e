"""Contract rules: each finding is one predicate over a row of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.session import materialize
from latticeqc.sources.metadata import FORMAT_NAME, TYPE_NAME, parse_metadata, sanitized_metadata
from latticeqc.sources.packages import MASK, REQUIRED

# Rule: severity, code, predicate, file, count (SQL text; file and count may be None).
Rule = tuple[str, str, str, str | None, str | None]

NUMERIC = "'^(u?int[0-9]+|float[0-9]+|bool)$'"


def emit(facts: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``keys, severity, code, file, count`` for every rule that holds; one pass, no shuffle."""
    entries = ", ".join(
        f"named_struct('severity', '{severity}', 'code', '{code}', 'file', CAST({file or 'NULL'} AS STRING),"
        f" 'count', CAST({count or 'NULL'} AS BIGINT), 'hit', coalesce({hit}, false))"
        for severity, code, hit, file, count in rules
    )
    return facts.selectExpr(*keys, f"inline(filter(array({entries}), r -> r.hit))").drop("hit")


def file_findings(presence: DataFrame, key: str = "dir") -> DataFrame:
    rules: list[Rule] = [("error", "path-not-directory", "NOT exists", None, None)]
    rules += [
        ("error", "missing-required-file", f"exists AND NOT has_{n.split('.')[0]}", f"'{n}'", None) for n in REQUIRED
    ]
    return emit(presence, [key], rules)


def channel_findings(channels: DataFrame) -> DataFrame:
    file = "concat(channel, '.tif')"
    flat, numeric = "readable AND ndim = 2", f"dtype RLIKE {NUMERIC}"
    return emit(
        channels,
        ["package_id"],
        [
            ("error", "tiff-unreadable", "NOT readable", file, None),
            ("error", "tiff-multiple-images", "readable AND frames <> 1", file, "frames"),
            ("error", "tiff-not-2d", "readable AND ndim <> 2", file, None),
            ("error", "tiff-nonnumeric", f"{flat} AND NOT {numeric}", file, None),
            ("warning", "coordinate-dtype-nonstandard", f"{flat} AND {numeric} AND channel <> 'mask' AND dtype <> 'float32'", file, None),
            ("warning", "mask-dtype-nonstandard", f"{flat} AND {numeric} AND channel = 'mask' AND dtype <> 'uint8'", file, None),
        ],
    )


def coordinate_gate(channels: DataFrame) -> DataFrame:
    """``package_id, decoded, same_shape``: all three planes usable, and of one shape."""
    usable = F.col("readable") & (F.col("ndim") == 2) & F.col("dtype").rlike(NUMERIC.strip("'"))
    shape = F.struct("height", "width")
    return channels.where("channel IN ('x', 'y', 'z')").groupBy("package_id").agg(
        (F.count_if(usable) == 3).alias("decoded"), (F.min(shape) == F.max(shape)).alias("same_shape")
    )


def shape_findings(gate: DataFrame) -> DataFrame:
    return emit(gate, ["package_id"], [("error", "coordinate-shape-mismatch", "decoded AND NOT same_shape", None, None)])


def metadata_findings(meta: DataFrame) -> DataFrame:
    file = "'meta.json'"
    parsed = parse_metadata(meta)
    shape = emit(
        parsed,
        ["package_id"],
        [
            ("error", "metadata-json-invalid", "NOT readable", file, None),
            ("error", "metadata-not-object", "readable AND root_type <> 'object'", file, None),
        ],
    )
    fields = emit(
        sanitized_metadata(parsed),
        ["package_id"],
        [
            ("error", "metadata-nonfinite-number", "nonfinite_count > 0", file, "nonfinite_count"),
            ("error", "metadata-uuid-invalid", "uuid IS NULL", file, None),
            ("warning", "metadata-format-nonstandard", f"NOT (format <=> '{FORMAT_NAME}')", file, None),
            ("warning", "metadata-type-nonstandard", f"NOT (type <=> '{TYPE_NAME}')", file, None),
            ("error", "metadata-scale-invalid", "scale_x IS NULL", file, None),
            ("error", "metadata-bbox-invalid", "bbox_present AND box_min_x IS NULL", file, None),
            ("warning", "metadata-area-invalid", "area_present AND area IS NULL", file, None),
            ("warning", "metadata-area-vx2-invalid", "area_vx2_present AND area_vx2 IS NULL", file, None),
            ("warning", "metadata-area-cm2-invalid", "area_cm2_present AND area_cm2 IS NULL", file, None),
            (
                "warning", "metadata-area-schema-divergence",
                "NOT area_present AND (area_vx2 IS NOT NULL OR area_cm2 IS NOT NULL)", file, None,
            ),
        ],
    )
    return shape.unionByName(fields)


def coordinate_findings(counts: DataFrame) -> DataFrame:
    return emit(
        counts,
        ["package_id"],
        [
            ("error", "nonfinite-coordinate", "nonfinite_count > 0", None, "nonfinite_count"),
            ("error", "partial-sentinel", "partial_sentinel_count > 0", None, "partial_sentinel_count"),
            ("warning", "noncanonical-invalid-coordinate", "noncanonical_count > 0", None, "noncanonical_count"),
        ],
    )


def mask_findings(values: DataFrame, relation: DataFrame) -> DataFrame:
    file = f"'{MASK}'"
    return emit(
        relation.where("relation <> 'absent'").join(values, "package_id"),
        ["package_id"],
        [
            ("error", "mask-nonfinite", "nonfinite > 0", file, "nonfinite"),
            ("error", "mask-low-nonzero-interoperability", "low_nonzero_below_255 > 0", file, "low_nonzero_below_255"),
            ("error", "mask-shape-python-incompatible", "relation = 'integer_multiple'", file, None),
            ("error", "mask-shape-incompatible", "relation = 'incompatible'", file, None),
        ],
    )


def validity_findings(summary: DataFrame, faces: DataFrame) -> DataFrame:
    """``summary`` from ``validity_summary``; ``faces`` may lack packages without any cell."""
    joined = summary.join(faces, "package_id", "left").fillna(0, subset=["face_count"])
    return emit(
        joined,
        ["package_id"],
        [
            ("error", "mask-revalidates-nonpositive-or-nonfinite-z", "revalidated_count > 0", f"'{MASK}'", "revalidated_count"),
            ("error", "python-cpp-validity-disagreement", "point_disagreement_count > 0", None, "point_disagreement_count"),
            ("error", "no-portable-valid-vertex", "portable_count = 0", None, None),
            ("error", "no-valid-face", "face_count = 0", None, None),
        ],
    )


def bbox_compare(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """Declared against measured bounds, with a tolerance per axis that grows with the coordinates."""
    tolerance = {a: f"(1e-4D + 1e-6D * greatest(abs(min_{a}), abs(max_{a}), 1D))" for a in "xyz"}
    delta = {(e, a): f"abs(box_{e}_{a} - {e}_{a})" for e in ("min", "max") for a in "xyz"}
    joined = measured.join(declared, "package_id", "left")
    return joined.selectExpr(
        "package_id",
        "coalesce(box_min_x IS NOT NULL AND min_x IS NOT NULL, false) AS comparable",
        " AND ".join(f"{d} <= {tolerance[a]}" for (_, a), d in delta.items()) + " AS matches",
        f"greatest({', '.join(delta.values())}) AS max_delta",
        *[f"{t} AS tolerance_{a}" for a, t in tolerance.items()],
    ).selectExpr(
        "package_id", "comparable",
        *[f"CASE WHEN comparable THEN {c} END AS {c}" for c in ("matches", "max_delta", "tolerance_x", "tolerance_y", "tolerance_z")],
    )


def bbox_findings(compared: DataFrame) -> DataFrame:
    return emit(
        compared, ["package_id"],
        [("warning", "metadata-bbox-mismatch", "comparable AND NOT matches", "'meta.json'", None)],
    )


def duplicate_uuids(uuids: DataFrame) -> DataFrame:
    """Packages whose id is used more than once: one row per package, with the number of uses.

    One id may be shared by most packages, so its packages stay rows and are never gathered in a list.
    """
    named = uuids.where("uuid IS NOT NULL AND uuid <> ''")
    # Written, so that the join is between tables and AQE can split an id that most packages share.
    reused = materialize(named.groupBy("uuid").agg(F.count("*").alias("count")).where("count > 1"))
    return named.join(reused, "uuid").select(
        F.lit("warning").alias("severity"), F.lit("duplicate-uuid").alias("code"), "uuid", "count", "path"
    )


def finding_order(findings: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Findings of a package numbered by severity, code and file."""
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = Window.partitionBy(*keys).orderBy(severity, "code", F.coalesce("file", F.lit("")))
    return findings.withColumn("place", F.row_number().over(order))


def package_status(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """``errors, warnings, status`` per package; a package without findings passes."""
    counts = findings.groupBy("package_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    zero = F.lit(0)
    joined = packages.join(counts, "package_id", "left").withColumns(
        {"errors": F.coalesce("errors", zero), "warnings": F.coalesce("warnings", zero)}
    )
    status = F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("pass")
    return joined.withColumn("status", status)


def status_counts(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("surfaces"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warning", "error")],
    )


def exit_status(status: DataFrame, collection_findings: DataFrame, fail_on_warning: bool) -> DataFrame:
    """2 when something failed, else 0; warnings count as failures on request."""
    bad = (F.col("errors") > 0) | (F.lit(fail_on_warning) & (F.col("warnings") > 0))
    loud = (F.col("severity") == "error") | F.lit(fail_on_warning)
    flags = status.select(bad.alias("bad")).unionByName(collection_findings.select(loud.alias("bad")))
    return flags.agg(F.when(F.coalesce(F.bool_or("bad"), F.lit(False)), 2).otherwise(0).alias("exit_code"))

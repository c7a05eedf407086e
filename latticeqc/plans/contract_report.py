"""The raw contract check for many packages at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.operators import contract as C
from latticeqc.operators import masks as M
from latticeqc.operators.grid import quad_counts
from latticeqc.session import materialize
from latticeqc.sources.metadata import parse_metadata, sanitized_metadata
from latticeqc.sources.packages import discover_packages, file_presence
from latticeqc.sources.surfaces import grid_shapes


@dataclass(frozen=True)
class ContractReport:
    findings: DataFrame
    status: DataFrame
    facts: DataFrame


def contract_report(
    packages: DataFrame, files: DataFrame, channels: DataFrame, meta: DataFrame, vertices: DataFrame, masks: DataFrame
) -> ContractReport:
    """All findings, the status of each package, and the numbers behind them.

    Coordinate rules only run for packages whose three planes decode and share a shape.
    """
    present = file_presence(packages.select(F.col("package_id").alias("dir")).distinct(), files)
    gate = materialize(C.coordinate_gate(channels))
    sound = gate.where("decoded AND same_shape").select("package_id")
    inside = vertices.join(sound, "package_id", "left_semi")
    mask_rows = masks.join(sound, "package_id", "left_semi")
    relation = materialize(M.mask_relation(grid_shapes(inside), mask_rows))
    valid = materialize(
        M.validity(inside, mask_rows, relation).select(
            "package_id", "row", "col", "x", "y", "z", "finite_all", "finite_x", "finite_y", "finite_z", "sentinel_all",
            "partial_sentinel", "nonpositive_z", "positive_finite_z", "python_mask", "python_valid", "cpp_valid", "cpp_finite", "portable",
        )
    )
    counts = M.vertex_counts(valid)
    summary = M.validity_summary(valid)
    faces = quad_counts(valid, "portable")
    box = M.measured_bbox(valid)
    facts = materialize(
        counts.join(summary, "package_id").join(faces, "package_id", "left").join(box, "package_id").fillna(0, subset=["face_count"])
    )
    compared = C.bbox_compare(sanitized_metadata(parse_metadata(meta)), facts.select("package_id", *box.columns[1:]))
    parts = [
        C.file_findings(present).withColumnRenamed("dir", "package_id"),
        C.channel_findings(channels),
        C.shape_findings(gate),
        C.metadata_findings(meta),
        C.coordinate_findings(facts),
        C.mask_findings(M.mask_values(mask_rows), relation),
        C.validity_findings(facts.drop("face_count"), facts.select("package_id", "face_count")),
        C.bbox_findings(compared),
    ]
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    findings = materialize(findings)
    status = C.package_status(packages.select("package_id").distinct(), findings)
    return ContractReport(C.finding_order(findings), status, facts)


@dataclass(frozen=True)
class ScanReport:
    report: ContractReport
    collection_findings: DataFrame
    counts: DataFrame


def collection_findings(packages: DataFrame, meta: DataFrame) -> DataFrame:
    """Reused ids, and a warning when there is no package at all."""
    uuids = sanitized_metadata(parse_metadata(meta)).select("uuid", F.col("package_id").cast("string").alias("path"))
    empty = packages.agg(F.count("*").alias("n")).where("n = 0").selectExpr(
        "'warning' AS severity", "'no-tifxyz-directories' AS code", "CAST(NULL AS STRING) AS uuid",
        "CAST(NULL AS BIGINT) AS count", "CAST(NULL AS STRING) AS path",
    )
    return C.duplicate_uuids(uuids).unionByName(empty)


def scan_report(
    files: DataFrame, channels: DataFrame, meta: DataFrame, vertices: DataFrame, masks: DataFrame
) -> ScanReport:
    """Discover every package in a listing ``dir, filename`` and check them together."""
    packages = materialize(discover_packages(files).withColumnRenamed("dir", "package_id"))
    report = contract_report(packages, files, channels, meta, vertices, masks)
    return ScanReport(report, collection_findings(packages, meta), C.status_counts(report.status))


def root_findings(spark: SparkSession, root: str) -> DataFrame:
    """An error finding when the scan root is missing or not a directory; empty otherwise."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [] if files.exists(path) and files.getFileStatus(path).isDirectory() else [("error", "scan-root-not-directory", root)]
    return spark.createDataFrame(found, "severity string, code string, path string")

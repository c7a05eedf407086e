"""From a folder of packages to surfaces and reports in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.plans.contract_report import ScanReport, root_findings, scan_report
from latticeqc.plans.geometry_report import GeometryReport, geometry_report
from latticeqc.session import materialize
from latticeqc.sources import rasters
from latticeqc.sources.packages import list_files
from latticeqc.sources.ranges import opens
from latticeqc.sources.surfaces import load_surface


@dataclass(frozen=True)
class FolderTables:
    """The tables of all packages below a root; ``package_id`` is the folder of the package."""

    listing: DataFrame
    channels: DataFrame
    meta: DataFrame
    vertices: DataFrame
    masks: DataFrame


def read_folder(spark: SparkSession, root: str, decoder: rasters.Decoder = rasters.decode_strips) -> FolderTables:
    """Listing, decoding facts, metadata texts, vertices and mask samples of every package below ``root``.

    The default decoder reads rasters by ranges of bytes; another one, or a store that Python workers do not
    know, gets each raster whole (2 GB at most).
    """
    files = list_files(spark, root, content=True)
    planes = files.where("filename LIKE '%.tif'").selectExpr("dir AS package_id", "replace(filename, '.tif', '') AS channel", "concat(dir, '/', filename) AS path", "bytes", "content")
    one = planes.select("path").first() if decoder is rasters.decode_strips else None
    decoded = materialize(rasters.ingest_raster_files(planes.drop("content")) if one and opens(one.path) else rasters.ingest_rasters(planes, decoder))
    meta = files.where("filename = 'meta.json'").select(F.col("dir").alias("package_id"), F.col("content").cast("string").alias("raw_json"))
    listing = list_files(spark, root).select("dir", "filename")
    return FolderTables(listing, rasters.channel_table(decoded), materialize(meta), rasters.vertex_table(decoded), rasters.mask_table(decoded))


def scan_folder(spark: SparkSession, root: str, decoder: rasters.Decoder = rasters.decode_strips) -> ScanReport:
    """The contract check of every package below ``root``; a root that is no directory is a collection finding."""
    missing = root_findings(spark, root)
    if missing.isEmpty():
        tables = read_folder(spark, root, decoder)
        return scan_report(tables.listing, tables.channels, tables.meta, tables.vertices, tables.masks)
    empty = _empty_tables(spark)
    scan = scan_report(empty.listing, empty.channels, empty.meta, empty.vertices, empty.masks)
    nulls = {"uuid": F.lit(None).cast("string"), "count": F.lit(None).cast("bigint")}
    return ScanReport(scan.report, missing.withColumns(nulls).select("severity", "code", "uuid", "count", "path"), scan.counts)


def _empty_tables(spark: SparkSession) -> FolderTables:
    def table(ddl: str) -> DataFrame:
        return spark.createDataFrame([], ddl)

    return FolderTables(
        table("dir string, filename string"),
        table("package_id string, channel string, readable boolean, error string, dtype string, frames int, ndim int, height int, width int"),
        table("package_id string, raw_json string"),
        table("package_id string, row int, col int, x double, y double, z double"),
        table("package_id string, mrow int, mcol int, value double"),
    )


def load_folder(spark: SparkSession, root: str, decoder: rasters.Decoder = rasters.decode_strips) -> DataFrame:
    """Surfaces of the packages whose three planes decode to one shape (see ``load_surface``)."""
    tables = read_folder(spark, root, decoder)
    planes = tables.channels.where(F.col("channel").isin("x", "y", "z"))
    sound = planes.groupBy("package_id").agg(
        F.count_if("readable").alias("n"), F.count_distinct("height", "width").alias("shapes"), F.min(F.col("ndim") == 2).alias("flat")
    )
    sound = materialize(sound.where("n = 3 AND shapes = 1 AND flat").select("package_id"))
    return load_surface(tables.vertices.join(sound, "package_id", "left_semi"), tables.masks.join(sound, "package_id", "left_semi"))


def review_folder(
    spark: SparkSession, root: str, cfg: ReviewConfig = ReviewConfig(), decoder: rasters.Decoder = rasters.decode_strips
) -> GeometryReport:
    """The geometry review of every readable package below ``root``."""
    return geometry_report(load_folder(spark, root, decoder), cfg)

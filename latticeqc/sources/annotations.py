"""Annotation documents and the cell neighbourhoods of their samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import is_finite
from latticeqc.operators.diff import dilate


def _points(docs: DataFrame) -> DataFrame:
    """One row per point of ``points_list`` that is not marked invalid, with its locations."""
    points = F.try_variant_get(F.try_parse_json("raw_json"), "$.points_list", "array<variant>")
    listed = docs.withColumn("p", F.explode(points))
    valid = F.try_variant_get("p", "$.valid", "variant")
    is_false = (F.schema_of_variant(valid) == "BOOLEAN") & ~F.try_variant_get("p", "$.valid", "boolean")
    return listed.where(~F.coalesce(is_false, F.lit(False))).withColumn(
        "locations", F.try_variant_get("p", "$.model_locations", "array<variant>")
    )


def annotation_points(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, h, w`` of every usable sample; text and booleans that read as numbers count, as in a float cast."""
    h, w = F.try_variant_get("l", "$.h", "double"), F.try_variant_get("l", "$.w", "double")
    flat = _points(docs).select(*keys, F.explode("locations").alias("l")).select(*keys, h.alias("h"), w.alias("w"))
    return flat.where(is_finite(F.col("h")) & is_finite(F.col("w")))


def annotation_point_count(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Points with at least one location that carries both h and w, whatever their values."""
    def complete(l):
        has = lambda f: F.schema_of_variant(F.try_variant_get(l, f"$.{f}", "variant")).isNotNull()
        return has("h") & has("w")

    ok = F.coalesce(F.exists("locations", complete), F.lit(False))
    counted = _points(docs).groupBy(*keys).agg(F.count_if(ok).alias("points"))
    return docs.select(*keys).distinct().join(counted, keys, "left").select(*keys, F.coalesce("points", F.lit(0)).alias("points"))


def neighborhoods(points: DataFrame, shapes: DataFrame, radius: int = 4) -> DataFrame:
    """Cells around each sample: up to four that touch the location, then dilated."""
    corner = F.array(*[F.struct((F.floor("h") - i).cast("int").alias("row"), (F.floor("w") - j).cast("int").alias("col")) for i in (0, 1) for j in (0, 1)])
    seeds = points.select("package_id", F.explode(corner).alias("s")).select("package_id", "s.row", "s.col").distinct()
    on = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    return dilate(seeds.join(shapes, "package_id").where(on).drop("height", "width"), radius, shapes)

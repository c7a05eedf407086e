"""Masks, vertex flags and the validity models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import flag_count, is_finite

KEYS = ["package_id", "row", "col"]


def mask_relation(shapes: DataFrame, masks: DataFrame) -> DataFrame:
    """``package_id, height, width, mask_height, mask_width, relation, factor_y, factor_x``."""
    sizes = masks.groupBy("package_id").agg(
        (F.max("mrow") + 1).alias("mask_height"), (F.max("mcol") + 1).alias("mask_width")
    )
    same = (F.col("mask_height") == F.col("height")) & (F.col("mask_width") == F.col("width"))
    # The lattice has at least one vertex, so height and width are never zero.
    multiple = (F.col("mask_height") % F.col("height") == 0) & (F.col("mask_width") % F.col("width") == 0)
    relation = (
        F.when(F.col("mask_height").isNull(), "absent")
        .when(same, "exact")
        .when(multiple, "integer_multiple")
        .otherwise("incompatible")
    )
    usable = F.col("relation").isin("exact", "integer_multiple")
    return (
        shapes.join(sizes, "package_id", "left")
        .withColumn("relation", relation)
        .withColumn("factor_y", F.when(usable, F.expr("cast(mask_height div height as bigint)")))
        .withColumn("factor_x", F.when(usable, F.expr("cast(mask_width div width as bigint)")))
    )


def mask_resample(masks: DataFrame, relation: DataFrame) -> DataFrame:
    """Mask at vertex resolution: kept where every sample of the block is at least 255."""
    placed = masks.join(
        relation.where("factor_y is not null").select("package_id", "factor_y", "factor_x"), "package_id"
    )
    value = F.col("value")
    return (
        placed.groupBy(
            "package_id",
            F.expr("cast(mrow div factor_y as int)").alias("row"),
            F.expr("cast(mcol div factor_x as int)").alias("col"),
        )
        .agg(F.bool_and(is_finite(value) & (value >= 255) | (value == float("inf"))).alias("retained"))
    )


def mask_values(masks: DataFrame) -> DataFrame:
    v = F.col("value")
    finite = is_finite(v)
    return masks.groupBy("package_id").agg(
        flag_count(finite & (v == 0)).alias("zero"),
        flag_count(finite & (v != 0) & (v < 255)).alias("low_nonzero_below_255"),
        flag_count(finite & (v >= 255)).alias("at_least_255"),
        flag_count(~finite).alias("nonfinite"),
    )


def vertex_flags(vertices: DataFrame) -> DataFrame:
    x, y, z = (F.col(a) for a in "xyz")
    sentinel = [(c == -1) for c in (x, y, z)]
    return (
        vertices.withColumns(
            {
                "finite_x": is_finite(x),
                "finite_y": is_finite(y),
                "finite_z": is_finite(z),
                "any_nan": F.isnan(x) | F.isnan(y) | F.isnan(z),
                "sentinel_all": sentinel[0] & sentinel[1] & sentinel[2],
                "sentinel_any": sentinel[0] | sentinel[1] | sentinel[2],
            }
        )
        .withColumns(
            {
                "finite_all": F.col("finite_x") & F.col("finite_y") & F.col("finite_z"),
                "partial_sentinel": F.col("sentinel_any") & ~F.col("sentinel_all"),
                "nonpositive_z": ~F.isnan(z) & (z <= 0) & ~F.col("sentinel_all"),
                "positive_finite_z": F.col("finite_z") & (z > 0),
            }
        )
    )


def vertex_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("package_id").agg(
        (F.max("row") + 1).cast("bigint").alias("height"),
        (F.max("col") + 1).cast("bigint").alias("width"),
        F.count("*").alias("vertex_count"),
        flag_count(F.col("finite_all")).alias("finite_count"),
        flag_count(~F.col("finite_all")).alias("nonfinite_count"),
        *[flag_count(~F.col(f"finite_{a}")).alias(f"nonfinite_{a}") for a in "xyz"],
        flag_count(F.col("sentinel_all")).alias("sentinel_count"),
        flag_count(F.col("partial_sentinel")).alias("partial_sentinel_count"),
        flag_count(F.col("nonpositive_z")).alias("noncanonical_count"),
    )


def validity(vertices: DataFrame, masks: DataFrame, relation: DataFrame) -> DataFrame:
    """Every validity model per vertex.

    ``python_valid`` trusts a mask of equal size; ``cpp_valid`` keeps z as a hard gate and lets a mask
    only remove; ``cpp_finite`` also wants finite coordinates without a sentinel; ``portable`` is
    where the first and the last agree.
    """
    exact = relation.where("relation = 'exact'").select("package_id")
    raw = masks.join(exact, "package_id", "left_semi").select(
        "package_id", F.col("mrow").alias("row"), F.col("mcol").alias("col"), (F.col("value") != 0).alias("python_mask")
    )
    # One shuffle on the vertex key serves both mask forms.
    both = raw.withColumn("retained", F.lit(None).cast("boolean")).unionByName(
        mask_resample(masks, relation).withColumn("python_mask", F.lit(None).cast("boolean"))
    )
    mask = both.groupBy(*KEYS).agg(
        F.bool_or("python_mask").alias("python_mask"), F.bool_or("retained").alias("cpp_mask")
    )
    z = F.col("z")
    gate = ~(~F.isnan(z) & (z <= 0)) & ~F.col("any_nan") & ~F.col("sentinel_all")
    return (
        vertex_flags(vertices)
        .join(mask, KEYS, "left")
        .withColumn("python_valid", F.coalesce("python_mask", "positive_finite_z"))
        .withColumn("cpp_valid", gate & F.coalesce("cpp_mask", F.lit(True)))
        .withColumn("cpp_finite", F.col("cpp_valid") & F.col("finite_all") & ~F.col("sentinel_any"))
        .withColumn("portable", F.col("python_valid") & F.col("cpp_finite"))
    )


def differs(a: str, b: str) -> Column:
    return F.col(a) != F.col(b)


def validity_summary(valid: DataFrame) -> DataFrame:
    revalidated = F.coalesce(F.col("python_mask") & ~F.col("positive_finite_z"), F.lit(False))
    return valid.groupBy("package_id").agg(
        flag_count(F.col("python_valid")).alias("python_valid_count"),
        flag_count(F.col("cpp_valid")).alias("cpp_valid_count"),
        flag_count(F.col("cpp_finite")).alias("cpp_finite_count"),
        flag_count(differs("python_valid", "cpp_valid")).alias("mask_disagreement_count"),
        flag_count(differs("python_valid", "cpp_finite")).alias("point_disagreement_count"),
        flag_count(F.col("portable")).alias("portable_count"),
        flag_count(revalidated).alias("revalidated_count"),
    )


def measured_bbox(valid: DataFrame) -> DataFrame:
    """Bounds over portable vertices; null where a package has none."""
    cells = [F.min(F.when(F.col("portable"), F.col(a))).alias(f"min_{a}") for a in "xyz"]
    cells += [F.max(F.when(F.col("portable"), F.col(a))).alias(f"max_{a}") for a in "xyz"]
    return valid.groupBy("package_id").agg(*cells)

"""Surface loading: vertex rows plus an optional validity mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import flag_count, is_finite
from latticeqc.operators.masks import mask_relation
from latticeqc.session import materialize


def grid_shapes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("package_id").agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )


def load_surface(vertices: DataFrame, masks: DataFrame) -> DataFrame:
    """``package_id, row, col, x, y, z, valid, explicit_mask`` with float32 coordinates as doubles.

    A mask of the same shape decides validity; any other mask is ignored and a vertex is valid where
    z is finite and positive.
    """
    relation = materialize(mask_relation(grid_shapes(vertices), masks))
    exact = relation.where(F.col("relation") == "exact").select("package_id")
    marked = masks.join(exact, "package_id", "left_semi").select(
        "package_id", F.col("mrow").alias("row"), F.col("mcol").alias("col"), (F.col("value") != 0).alias("explicit_mask")
    )
    lifted = vertices.select(
        "package_id", "row", "col", *[F.col(a).cast("float").cast("double").alias(a) for a in "xyz"]
    )
    z = F.col("z")
    return lifted.join(marked, ["package_id", "row", "col"], "left").withColumn(
        "valid", F.coalesce("explicit_mask", is_finite(z) & (z > 0))
    )


def strict_surface_report(
    vertices: DataFrame,
    channels: DataFrame,
    meta: DataFrame,
    producer: str,
    format_name: str,
    max_side: int = 256,
) -> DataFrame:
    """Rule columns of the strict loader, one row per package; ``accepted`` when all hold."""
    x = F.col("x")
    finite = is_finite(x) & is_finite(F.col("y")) & is_finite(F.col("z"))
    grids = vertices.groupBy("package_id").agg(
        (F.max("row") + 1).alias("height"),
        (F.max("col") + 1).alias("width"),
        flag_count(~finite).alias("nonfinite"),
        flag_count(F.isnan(x) | (x != -1)).alias("valid_vertices"),
    )
    types = channels.where(F.col("channel").isin("x", "y", "z")).groupBy("package_id").agg(
        F.bool_and(F.col("dtype") == "float32").alias("dtype_ok")
    )
    offset = "$.grid_offset"
    v = F.try_parse_json("raw_json")
    both_integer = F.lit(True)
    for i in (0, 1):
        both_integer = both_integer & (F.schema_of_variant(F.try_variant_get(v, f"{offset}[{i}]", "variant")) == "BIGINT")
    items = F.try_variant_get(v, offset, "array<variant>")
    tags = meta.select(
        "package_id",
        F.coalesce(F.try_variant_get(v, "$.format", "string") == format_name, F.lit(False)).alias("format_ok"),
        F.coalesce(F.try_variant_get(v, "$.source", "string") == producer, F.lit(False)).alias("producer_ok"),
        F.coalesce((F.size(items) == 2) & both_integer, F.lit(False)).alias("offset_ok"),
        F.try_variant_get(v, f"{offset}[0]", "bigint").alias("offset_col"),
        F.try_variant_get(v, f"{offset}[1]", "bigint").alias("offset_row"),
    )
    no = F.lit(False)
    joined = grids.join(types, "package_id", "left").join(tags, "package_id", "left")
    rules = {
        "shape_ok": F.col("height").between(1, max_side) & F.col("width").between(1, max_side),
        "finite_ok": F.col("nonfinite") == 0,
        "dtype_ok": F.coalesce("dtype_ok", no),
        "format_ok": F.coalesce("format_ok", no),
        "producer_ok": F.coalesce("producer_ok", no),
        "offset_ok": F.coalesce("offset_ok", no),
    }
    accepted = F.lit(True)
    for rule in rules.values():
        accepted = accepted & rule
    return joined.select(
        "package_id",
        "valid_vertices",
        *[rule.alias(name) for name, rule in rules.items()],
        F.when(rules["offset_ok"], F.col("offset_col")).alias("offset_col"),
        F.when(rules["offset_ok"], F.col("offset_row")).alias("offset_row"),
        accepted.alias("accepted"),
    )

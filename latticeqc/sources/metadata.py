"""Package metadata: lenient three-way JSON reading and field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.functions.numeric import is_finite

# Names a conforming metadata file has to carry.
FORMAT_NAME = "tifxyz"
TYPE_NAME = "seg"

# JSON text cut into string literals and the text between them. The quantifiers are possessive: a backtracking group
# recurses once per character in the JVM and overflows its stack on long strings.
_SEGMENT = r'"(?:[^"\\]++|\\.)*+"|[^"]++'
_TOKEN = r"-?Infinity|NaN"
NUMBER_TYPES = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``package_path, raw_json`` of every meta.json below ``root``."""
    text = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").text(root, wholetext=True)
    )
    return text.select(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("package_path"),
        F.col("value").alias("raw_json"),
    )


def _segments(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(_SEGMENT), F.lit(0))


def _outside_strings(raw: Column, change) -> Column:
    return F.array_join(
        F.transform(_segments(raw), lambda s: F.when(F.startswith(s, F.lit('"')), s).otherwise(change(s))), ""
    )


def nonfinite_tokens(raw: Column) -> Column:
    """Number of NaN and infinity tokens outside string literals."""
    outside = F.array_join(F.filter(_segments(raw), lambda s: ~F.startswith(s, F.lit('"'))), " ")
    return F.regexp_count(outside, F.lit(_TOKEN))


def parse_metadata(meta: DataFrame) -> DataFrame:
    """Adds ``v`` (variant or null), ``readable``, ``root_type`` and ``nonfinite_count``.

    Of a key that comes twice the last value counts, as in the readers that the rules speak for.
    Non-finite tokens are legal for lenient readers; they become an empty list, which no field rule
    accepts as a number, a string or an absent value.
    """
    meta.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    tolerant = _outside_strings(F.col("raw_json"), lambda s: F.regexp_replace(s, _TOKEN, "[]"))
    bare_token = F.regexp_like(F.trim("raw_json"), F.lit(f"^({_TOKEN})$"))
    shape = F.schema_of_variant(F.col("v"))
    root = (
        F.when(F.col("v").isNull(), F.lit(None).cast("string"))
        .when(bare_token, "number")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .otherwise("number")
    )
    return (
        meta.withColumn("v", F.try_parse_json(tolerant))
        .withColumn("root_type", root)
        .withColumn("readable", F.col("v").isNotNull())
        .withColumn("nonfinite_count", F.when(F.col("root_type") == "object", nonfinite_tokens(F.col("raw_json"))).cast("bigint"))
    )


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("MISSING"))


def json_number(path: str) -> Column:
    """The value when it is a real, finite JSON number; booleans and numeric text are not."""
    value = F.try_variant_get("v", path, "double")
    return F.when(F.rlike(_kind(path), F.lit(NUMBER_TYPES)) & is_finite(value), value)


def json_text(path: str) -> Column:
    return F.when(_kind(path) == "STRING", F.try_variant_get("v", path, "string"))


def _present(path: str) -> Column:
    return ~_kind(path).isin("MISSING", "VOID")


def sanitized_metadata(parsed: DataFrame) -> DataFrame:
    """Checked fields of object-shaped metadata; a field that breaks its rule is null.

    ``*_present`` tells an absent field from a rejected one.  A box is read the way array libraries
    coerce it, so numeric text and booleans inside it do count.
    """
    objects = parsed.where(F.col("root_type") == "object")
    scale = [json_number(f"$.scale[{i}]") for i in (0, 1)]
    scale_ok = _kind("$.scale").startswith("ARRAY") & F.coalesce((scale[0] > 0) & (scale[1] > 0), F.lit(False))
    sides = F.try_variant_get("v", "$.bbox", "array<array<variant>>")
    corners = [[F.try_variant_get("v", f"$.bbox[{i}][{j}]", "double") for j in range(3)] for i in (0, 1)]
    box_ok = (F.size(sides) == 2) & (F.size(sides[0]) == 3) & (F.size(sides[1]) == 3)
    for j in range(3):
        box_ok = box_ok & is_finite(corners[0][j]) & is_finite(corners[1][j]) & (corners[0][j] <= corners[1][j])
    box_ok = F.coalesce(box_ok, F.lit(False))
    uuid = json_text("$.uuid")
    out = objects.select(
        "package_id",
        "nonfinite_count",
        F.when(F.trim(uuid) != "", uuid).alias("uuid"),
        json_text("$.format").alias("format"),
        json_text("$.type").alias("type"),
        F.when(scale_ok, scale[0]).alias("scale_x"),
        F.when(scale_ok, scale[1]).alias("scale_y"),
        _present("$.bbox").alias("bbox_present"),
        *[F.when(box_ok, corners[i][j]).alias(f"box_{n}_{a}") for i, n in ((0, "min"), (1, "max")) for j, a in enumerate("xyz")],
        *[_present(f"$.{f}").alias(f"{f}_present") for f in ("area", "area_vx2", "area_cm2")],
        *[_non_negative(f).alias(f) for f in ("area", "area_vx2", "area_cm2")],
    )
    return out


def _non_negative(field: str) -> Column:
    value = json_number(f"$.{field}")
    return F.when(value >= 0, value)

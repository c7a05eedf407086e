"""Top-k lists, deterministic splits and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.functions.numeric import flag_count
from latticeqc.operators.digest import grid_digest

KEYS = ("package_id",)


def first_locations(cells: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, total, truncated, sample, digest``: the first places in row-major order, all of them digested."""
    keys = list(keys)
    place = F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"))
    placed = cells.select(*keys, "row", "col", place.alias("place"))
    order = Window.partitionBy(*keys).orderBy("row", "col")
    head = placed.withColumn("i", F.row_number().over(order)).where(F.col("i") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("i", "place")))
    sample = head.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["place"]), ";").alias("sample"))
    total = placed.groupBy(*keys).agg(F.count("*").alias("total"))
    return (
        total.withColumn("truncated", F.col("total") > limit).join(sample, keys).join(grid_digest(placed, "place", keys), keys)
    )


def grids_equal(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Places where two vertex tables differ; NaN equals nothing, as in byte-wise array comparison of values."""
    at = [*keys, "row", "col"]
    pair = left.select(*at, F.struct("x", "y", "z").alias("p")).join(
        right.select(*at, F.struct("x", "y", "z").alias("q")), at, "full_outer"
    )
    bad = F.col("p").isNull() | F.col("q").isNull()
    for a in "xyz":
        u, v = F.col(f"p.{a}"), F.col(f"q.{a}")
        bad = bad | F.coalesce(F.isnan(u) | F.isnan(v) | (u != v), F.lit(True))
    return pair.groupBy(*keys).agg(flag_count(bad).alias("differing")).withColumn("equal", F.col("differing") == 0)


def rank_panels(panels: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("compressed_share"), F.asc("median_spacing"), F.asc("image")]
    top = panels.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def choose_threshold(means: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Highest mean; ties go to the threshold nearest 0.5, then to the lower one."""
    order = F.struct(-F.col("mean_blend"), F.abs(F.col("threshold") - 0.5), F.col("threshold"))
    return means.groupBy(*keys).agg(
        F.min_by("threshold", order).alias("selected_threshold"), F.max("mean_blend").alias("mean_blend")
    )


def hash_ranked_split(names: DataFrame, count: int, train_group: str) -> DataFrame:
    """``count`` names of the training group with the lowest SHA-256 validate, the rest trains; other groups test."""
    order = Window.orderBy("_h", "name")
    hashed = names.withColumn("_h", F.sha2("name", 256))
    # Ordering with a limit first keeps only ``count`` rows per task.
    chosen = (
        hashed.where(F.col("group") == train_group).orderBy("_h", "name").limit(count)
        .withColumn("rank", F.row_number().over(order)).select("name", "rank")
    )
    split = (
        F.when(F.col("group") != train_group, "test").when(F.col("rank").isNotNull(), "validation").otherwise("train")
    )
    return hashed.join(chosen, "name", "left").withColumn("split", split).drop("_h")


def hash_sample(sites: DataFrame, limit: int, minimum: int, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Per group the ``limit`` sites with the lowest hash; groups with fewer than ``minimum`` sites fail.

    A hash order replaces the seeded generator: the same distribution, and the same sites everywhere.
    """
    draw = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, *identity]]))
    counts = sites.groupBy(*keys).agg(F.count("*").alias("sites"))
    order = Window.partitionBy(*keys).orderBy("_h", *identity)
    picked = sites.withColumn("_h", draw).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= limit)
    return picked.drop("_h").join(counts.where(F.col("sites") >= minimum), list(keys))


def count_flags(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cases"), *[flag_count(c).alias(n) for n, c in flags.items()])

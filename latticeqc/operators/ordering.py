"""Global positions and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.session import materialize


def with_global_position(
    df: DataFrame,
    order: Sequence[str],
    weight: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``pos`` (0-based place in ``order``, per key group) and ``running`` (weight up to here).

    Rows are range-partitioned and numbered inside each partition; one offset per partition (and
    key) turns these into global places.  Only the offset table, one row per partition and key
    present in it, is shuffled to a group.
    """
    keys = list(keys)
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    ranged = df.repartitionByRange(*keys, *order) if keys else df.repartitionByRange(*order)
    frozen = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_w", amount))
    totals = frozen.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = frozen.withColumn("_i", F.row_number().over(inside)).withColumn("_r", F.sum("_w").over(running))
    return (
        numbered.join(materialize(offsets), [*keys, "_part"])
        .withColumn("pos", (F.col("_n0") + F.col("_i") - 1).cast("bigint"))
        .withColumn("running", F.col("_t0") + F.col("_r"))
        .drop("_part", "_w", "_n0", "_t0", "_i", "_r")
    )


def row_count(df: DataFrame) -> int:
    return df.count()


def evenly_spaced(n: int, limit: int, pos: Column) -> Column:
    """True for positions ``floor(i * (n - 1) / (limit - 1))``, i < limit; all when limit >= n."""
    if limit >= n:
        return F.lit(True)
    if limit <= 1:
        return (pos == 0) & F.lit(limit == 1)
    # pos is hit by i = ceil(pos * (limit-1) / (n-1)) when that i maps back onto pos.
    i = F.floor((pos * (limit - 1) + (n - 2)) / (n - 1)).cast("bigint")
    return F.floor(i * (n - 1) / (limit - 1)).cast("bigint") == pos

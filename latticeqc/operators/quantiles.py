"""Exact interpolated quantiles that do not depend on one group fitting into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.session import materialize

GROUP_LIMIT = 2_000_000
BUCKETS = 4096


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    group_rows: int | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``keys, n, q ARRAY<DOUBLE>``: linear interpolation between order statistics.

    ``group_rows`` is a known bound on the group size.  Up to ``group_limit`` rows per group the
    built-in exact aggregate is used; it keeps a value map per group, so larger groups are narrowed
    by histograms first and only the two order statistics around each rank are looked up.
    """
    keys = list(keys)
    if group_rows is None:
        df = materialize(df.select(*keys, value))
        group_rows = largest_group(df, keys)
    if group_rows <= group_limit:
        points = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.percentile(value, points).alias("q")
        )
    return _by_histogram(materialize(df.select(*keys, value).where(F.col(value).isNotNull())), keys, value, probs, group_limit)


def _by_histogram(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], group_limit: int) -> DataFrame:
    # One target per wanted order statistic: the rank below and above each quantile.
    sized = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    )
    base = sized.withColumn("_w", wanted).select(
        *keys, "n", "lo", "hi", F.col("_w.i").alias("i"), (F.col("_w.p") * (F.col("n") - 1)).alias("at")
    )
    targets = materialize(
        base.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            *keys,
            "i",
            "side",
            "lo",
            "hi",
            F.when(F.col("side") == 0, F.floor("at")).otherwise(F.ceil("at")).cast("bigint").alias("rank"),
            F.col("n").alias("inside"),
        )
    )
    while True:
        open_targets = targets.where((F.col("inside") > group_limit) & (F.col("hi") > F.col("lo")))
        if open_targets.isEmpty():
            break
        targets = materialize(_narrow(df, keys, value, targets, group_limit))
    return _look_up(df, keys, value, targets, base)


def _bucket(value, lo, hi):
    step = (hi / BUCKETS) - (lo / BUCKETS)
    return F.least(F.floor(F.try_divide(value - lo, step)), F.lit(BUCKETS - 1)).cast("int")


def _narrow(df, keys, value, targets, group_limit):
    closed = targets.where((F.col("inside") <= group_limit) | (F.col("hi") <= F.col("lo")))
    still = targets.where((F.col("inside") > group_limit) & (F.col("hi") > F.col("lo")))
    ranges = still.select(*keys, "lo", "hi").distinct()
    placed = (
        df.join(ranges, keys)
        .where(F.col(value).between(F.col("lo"), F.col("hi")))
        .withColumn("b", _bucket(F.col(value), F.col("lo"), F.col("hi")))
    )
    bins = placed.groupBy(*keys, "lo", "hi", "b").agg(
        F.count("*").alias("c"), F.min(value).alias("blo"), F.max(value).alias("bhi")
    )
    # At most BUCKETS rows per range, so this window is bounded.
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
    hit = still.join(bins, [*keys, "lo", "hi"]).where(
        (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))
    )
    narrowed = hit.select(
        *keys,
        "i",
        "side",
        F.col("blo").alias("lo"),
        F.col("bhi").alias("hi"),
        (F.col("rank") - F.col("below")).alias("rank"),
        F.col("c").alias("inside"),
    )
    return closed.unionByName(narrowed)


def _look_up(df, keys, value, targets, base):
    flat = targets.where(F.col("lo") == F.col("hi")).select(*keys, "i", "side", F.col("lo").alias("v"))
    ranges = targets.where(F.col("lo") < F.col("hi")).select(*keys, "lo", "hi").distinct()
    order = Window.partitionBy(*keys, "lo", "hi").orderBy(value)
    ranked = (
        df.join(ranges, keys)
        .where(F.col(value).between(F.col("lo"), F.col("hi")))
        .withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    )
    found = (
        targets.where(F.col("lo") < F.col("hi"))
        .join(ranked, [*keys, "lo", "hi", "rank"])
        .select(*keys, "i", "side", F.col(value).alias("v"))
    )
    picked = (
        flat.unionByName(found)
        .groupBy(*keys, "i")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("v"))).alias("v0"),
            F.max(F.when(F.col("side") == 1, F.col("v"))).alias("v1"),
        )
    )
    # The same arithmetic as the built-in aggregate, so that both give the same bits.
    between = (F.ceil("at") - F.col("at")) * F.col("v0") + (F.col("at") - F.floor("at")) * F.col("v1")
    valued = picked.join(base.select(*keys, "i", "n", "at"), [*keys, "i"]).withColumn(
        "v", F.when(F.col("v0") == F.col("v1"), F.col("v0").cast("double")).otherwise(between)
    )
    return valued.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"),
    )


def summary(df: DataFrame, keys: Sequence[str], metric: str, value: str, group_rows: int | None = None) -> DataFrame:
    """count, min, p05, p50, p95, max over finite values, one row per keys and ``metric``."""
    from latticeqc.functions.numeric import is_finite

    finite = df.where(is_finite(F.col(value)))
    full = [*keys, metric]
    # min and max are the 0 and 1 quantiles, so one pass gives all five numbers.
    q = exact_quantiles(finite, full, value, (0.0, 0.05, 0.5, 0.95, 1.0), group_rows)
    names = ("min", "p05", "p50", "p95", "max")
    return q.select(
        *full, F.col("n").cast("bigint").alias("count"), *[F.col("q")[i].alias(a) for i, a in enumerate(names)]
    )

"""The whole review as tables: geometry report, distributions, example lists and regions, from one frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import components as C
from latticeqc.operators import geometry as G
from latticeqc.operators import tile_tables as T
from latticeqc.plans.geometry_report import KEYS, GeometryReport, geometry_report

SINGLE = tuple(c for c, e in G.EXAMPLES.items() if len(e) == 1)
DOUBLE = tuple(c for c, e in G.EXAMPLES.items() if len(e) == 2)


@dataclass(frozen=True)
class FullReview:
    """``distributions``: count, min, p05, p50, p95 and max by metric; ``locations`` and ``examples``: first places by
    cue; ``regions``: enclosed regions by size."""

    report: GeometryReport
    distributions: DataFrame
    locations: DataFrame
    examples: DataFrame
    regions: DataFrame


def full_review(
    surf: DataFrame, cfg: ReviewConfig = ReviewConfig(), keys: Sequence[str] = KEYS, locations: int = 50, examples: int = 50, each: int = 25, regions: int | None = None
) -> FullReview:
    """All tables of the review; the limits are those of the lists, each list says its ranks."""
    keys = list(keys)
    report = geometry_report(surf, cfg, keys, max(locations, each))

    def found(cues: Sequence[str]) -> DataFrame:
        # Nine digits, so that locations that differ by rounding only rank by place.
        candidates = T.tile_candidates(report.reviewed, keys, cues)
        return candidates.withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(F.round("value", 9)))

    quantiles = T.value_quantiles(report.reviewed, keys, (0.0, 0.05, 0.5, 0.95, 1.0))
    named = F.array(*[F.lit(m) for m in T.VALUES])[F.col("metric").cast("int")].alias("metric")
    numbers = [F.col("q")[i].alias(n) for i, n in enumerate(("min", "p05", "p50", "p95", "max"))]
    return FullReview(
        report,
        quantiles.select(*keys, named, F.col("n").alias("count"), *numbers),
        G.top_locations(found(SINGLE), locations, keys),
        G.merged_examples(found(DOUBLE), examples, each, keys),
        C.region_summary(report.holes, keys, regions),
    )

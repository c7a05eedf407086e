"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from latticeqc.config import ReviewConfig
from latticeqc.operators import geometry as G
from latticeqc.plans.full_review import full_review
from latticeqc.queries import all_queries
from latticeqc.queries.fixtures import Fixtures
from latticeqc.queries.grid_queries import frame
from latticeqc.session import build_session, clear_work, materialize

HEADLINE = [
    "package_status",
    "validity_summary",
    "valid_quads",
    "long_edges",
    "distortion_flags",
    "normal_jumps",
    "components4",
    "region_summary",
    "nonlocal_proximity",
    "surface_diff",
    "isolated_split",
    "cluster_bootstrap",
    "score_rays",
    "next_sheet_spacing",
    "overlap_blend",
]
COPIES = 12


def timed(make) -> float:
    start = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def frame_throughput(spark, sf: str) -> tuple[float, int]:
    """Spacing references and all per-cell review counters over the surfaces, repeated COPIES times in space."""
    cfg = ReviewConfig()
    base = Fixtures(spark, sf).surf
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    many = base.withColumn("k", copies).selectExpr(
        "package_id + 1000000 * k AS package_id", "row", "col", "x + 100 * k AS x", "y", "z", "valid", "explicit_mask"
    )
    surf = materialize(many)
    start = time.time()
    refs = G.spacing_reference(surf, cfg)
    faces = G.cell_counts(G.surface_frame(surf, refs, cfg), cfg).agg(F.sum("valid_quads")).first()[0]
    return round(time.time() - start, 3), int(faces)


def review_throughput(spark, sf: str) -> tuple[float, int]:
    """The full review (summary, findings, cells, distributions, lists, regions) over at least 700,000 faces, every table written."""
    base = Fixtures(spark, sf).surf
    faces = G.cell_counts(frame(Fixtures(spark, sf)), ReviewConfig()).agg(F.sum("valid_quads")).first()[0]
    copies = -(-700_000 // int(faces))
    many = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).selectExpr(
        "package_id + 1000000 * k AS package_id", "row", "col", "x + 100 * k AS x", "y", "z", "valid", "explicit_mask"
    )
    surf = materialize(many)
    start = time.time()
    review = full_review(surf)
    tables = [review.report.findings, review.report.cells, review.distributions, review.locations, review.examples, review.regions]
    for table in tables:
        table.write.format("noop").mode("overwrite").save()
    done = review.report.summary.agg(F.sum("valid_quads")).first()[0]
    return round(time.time() - start, 3), int(done)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "latticeqc-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["vertex_counts"](spark, sf).collect()
    took = {name: timed(lambda name=name: all_queries.QUERIES[name](spark, sf)) for name in HEADLINE}
    took["surface_frame_scaled"], faces = frame_throughput(spark, sf)
    took["full_review"], reviewed = review_throughput(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "review_faces": reviewed, "review_faces_per_sec": round(reviewed / took["full_review"]), "frame_faces": faces, "frame_faces_per_sec": round(faces / took["surface_frame_scaled"]),
            }
        )
    )
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()

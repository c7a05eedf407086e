"""Report tables for writing: JSON lines, hashes, coloured cells, summary and TSV rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.operators import project
from latticeqc.sources.packages import file_digests


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys; null members are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def payload_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def report_json(report: DataFrame, key: str) -> DataFrame:
    """One strict JSON document per row; non-finite numbers have to be null before this point."""
    return report.select(key, canonical_json(report.columns).alias("document"))


def write_report(report: DataFrame, key: str, path: str) -> None:
    """Documents as text, one per line, for readers outside Spark."""
    report_json(report, key).select("document").write.text(path)


def evidence_index(files: DataFrame) -> DataFrame:
    """Hash and size of every JSON output but the index itself."""
    return file_digests(files.where(F.endswith("filename", F.lit(".json")) & (F.col("filename") != "index.json")))


# Colours of the overlay as (red, green, blue).
BASE, INVALID, HOLE = (30, 38, 50), (16, 19, 25), (220, 40, 220)
LOW, MIDDLE, HIGH = (40.0, 145.0, 235.0), (255.0, 205.0, 45.0), (235.0, 50.0, 45.0)


def overlay_cells(cells: DataFrame, holes: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Colour per cell: surface, invalid, a two-part ramp by score on cue cells, holes on top."""
    at = [*keys, "row", "col"]
    marked = cells.join(holes.select(*at).distinct().withColumn("hole", F.lit(True)), at, "left")
    score = F.nanvl(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    active = F.col("cell_valid") & F.col("cue")
    s = F.col("s")
    scored = marked.withColumn("s", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))

    def channel(i: int) -> Column:
        lower = LOW[i] + (MIDDLE[i] - LOW[i]) * (s / 0.5)
        upper = MIDDLE[i] + (HIGH[i] - MIDDLE[i]) * ((s - 0.5) / 0.5)
        return (
            F.when(F.col("hole"), HOLE[i])
            .when(active, F.rint(F.when(s <= 0.5, lower).otherwise(upper)).cast("int"))
            .when(F.col("cell_valid"), BASE[i])
            .otherwise(INVALID[i])
        )

    return scored.select(*at, *[channel(i).alias(n) for i, n in enumerate("rgb")])


def overlay_downsample(pixels: DataFrame, shapes: DataFrame, max_side: int = 1800, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Nearest-neighbour shrink of overlays larger than ``max_side``; smaller ones stay as they are.

    A source cell knows which target cells take it, so no join with the target grid is needed.
    """
    longest = "greatest(height, width)"
    sized = pixels.join(shapes, list(keys))
    for axis, side in (("row", "height"), ("col", "width")):
        target = f"CASE WHEN {longest} > {max_side} THEN greatest(1, CAST(floor({side} * ({max_side}D / {longest})) AS INT)) ELSE {side} END"
        # Target t takes source floor((t + 1/2) * side / target): t from ceil(p * target / side - 1/2) on.
        near = f"sequence(greatest(CAST(floor({axis} * _n / {side}) AS INT) - 1, 0), least(CAST(ceil(({axis} + 1) * _n / {side}) AS INT) + 1, _n - 1))"
        takes = f"filter({near}, t -> CAST(floor((t + 0.5D) * {side} / _n) AS INT) = {axis})"
        sized = sized.selectExpr("*", f"{target} AS _n").selectExpr("*", f"explode({takes}) AS _t").drop(axis, "_n").withColumnRenamed("_t", axis)
    return sized.drop("height", "width").select(*keys, "row", "col", "r", "g", "b")


def unpivot_summary(table: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    return table.unpivot([*keys, "metric"], ["min", "p05", "p50", "p95", "max"], "stat", "value")


# Headline rows of a review report.
HEADLINES = {
    "Grid shape": "concat(height, ' x ', width)",
    "Valid vertices": "format_number(valid_count, 0)",
    "Valid quads": "format_number(valid_quads, 0)",
    "Vertex components": "format_number(vertex_components, 0)",
    "Enclosed gaps": "format_number(enclosed_regions, 0)",
    "Long / short edges": "concat(long_edges, ' / ', short_edges)",
    "Folded quads": "format_number(folded_quads, 0)",
    "Normal jumps": "format_number(normal_jumps, 0)",
    "Nonlocal pairs": "format_number(pair_count, 0)",
    "Area": "format_number(surface_area, 3)",
}


def headline_rows(summary: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    pairs = ", ".join(f"named_struct('label', '{label}', 'value', {text})" for label, text in HEADLINES.items())
    return summary.selectExpr(*keys, f"inline(array({pairs}))")


def boundary_lines(vertices: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """One tab-separated line per surface with the origins of its boundary quads in order.

    The list runs along two edges of the grid only, so it is as long as the sides, not the surface.
    """
    edge = project.boundary_cells(vertices, keys).where("last_row OR last_col")
    place = F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("row", "col", place.alias("p"))))
    origins = edge.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["p"]), ";").alias("origins"))
    names = [*keys, "height", "width", "valid_vertices", "valid_quads", "added_quads", "last_row_quads", "last_col_quads", "corner_quad"]
    joined = project.boundary_counts(vertices, keys).join(origins, list(keys), "left").fillna("", subset=["origins"])
    return joined.select(F.concat_ws("\t", *[F.col(n).cast("string") for n in names], "origins").alias("line"))

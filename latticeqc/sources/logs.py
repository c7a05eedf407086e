"""Fields of tracer logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Line patterns of the log format.
RESUME = (
    r"resume_growth initialized (\d+) low-res points, fringe (\d+).*?"
    r"used_area \[(\d+) x (\d+) from \((\d+), (\d+)\)\]"
)
GENERATION = r"gen 0 processing (\d+) fringe cands .*? area (\d+) vx\^2"
AREA = r"area est: (\d+) vx\^2 \(([^)]+) cm\^2\)"
LIBRARY = r"(/[^\n]+/libvc_(?:core|tracer)\.dylib)"
LINE_MARKS = ("resume_growth initialized", "gen 0 processing", "area est:")

FIELDS = {
    "resume_points": (RESUME, 1, "bigint"),
    "resume_fringe": (RESUME, 2, "bigint"),
    "area_width": (RESUME, 3, "bigint"),
    "area_height": (RESUME, 4, "bigint"),
    "area_x": (RESUME, 5, "bigint"),
    "area_y": (RESUME, 6, "bigint"),
    "generation_fringe": (GENERATION, 1, "bigint"),
    "generation_area": (GENERATION, 2, "bigint"),
    "final_area_vx2": (AREA, 1, "bigint"),
    "final_area_cm2": (AREA, 2, "double"),
}


def parse_trace_log(logs: DataFrame, keys: list[str], line_limit: int | None = None) -> DataFrame:
    """First match of each pattern; all fields are null unless every pattern is present.

    All marked lines are kept in ``selected_lines``, or the first ``line_limit`` of them where that is asked for.
    """
    log = F.col("log")
    complete = log.rlike(RESUME) & log.rlike(GENERATION) & log.rlike(AREA)
    lines = F.transform(F.split(log, "\r\n|\n|\r"), lambda line: F.trim(line))
    marked = F.filter(lines, lambda line: (
        F.contains(line, F.lit(LINE_MARKS[0])) | F.contains(line, F.lit(LINE_MARKS[1])) | F.contains(line, F.lit(LINE_MARKS[2]))
    ))
    return logs.select(
        *keys,
        complete.alias("complete"),
        *[F.when(complete, F.regexp_extract(log, p, g).cast(t)).alias(n) for n, (p, g, t) in FIELDS.items()],
        F.when(complete, F.array_join(marked if line_limit is None else F.slice(marked, 1, line_limit), "|")).alias("selected_lines"),
    )


def loaded_libraries(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct library paths of loader lines, in order of first appearance."""
    lines = F.filter(
        F.split("log", "\r\n|\n|\r"), lambda line: F.contains(line, F.lit("dyld[")) & F.contains(line, F.lit("libvc_"))
    )
    found = F.filter(F.transform(lines, lambda line: F.regexp_extract(line, LIBRARY, 1)), lambda p: p != "")
    return logs.select(*keys, F.array_join(F.array_distinct(found), "|").alias("libraries"))

"""Rays, sheet spacing, gap masks and tile blending on voxel tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.sqltext import stage

# Ray sampling and spacing limits.
RAY_SAMPLES, RAY_STEP, RAY_CENTER = 49, 0.5, 24
SPACING_CAP, COMPRESSED_MAX = 40, 8


def score_rays(rays: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """One row per ray with an own label at the centre; flags as 0/1 counters.

    The length is that of ``prob``, the centre its middle. A ray that meets another label is fused when every sample up to the nearest one clears the
    threshold; a ray that meets none is a false split when its own stretch does not.
    """
    c, last = "center", "last_place"
    t = f"double('{float(threshold)!r}')"
    at = f"sequence(0, {last})"
    out = stage(rays, {"last_place": "size(prob) - 1", "center": "(size(prob) - 1) div 2"})
    out = stage(out, {"own": f"turn[int({c})]"}).where("own > 0")
    out = stage(
        out,
        {
            "other": f"array_min(transform(filter({at}, i -> turn[i] > 0 AND turn[i] <> own), i -> struct(abs(i - {c}) AS d, i AS i))).i",
            "first": f"coalesce(array_max(filter({at}, i -> i < {c} AND turn[i] <> own)) + 1, 0)",
            "last": f"coalesce(array_min(filter({at}, i -> i > {c} AND turn[i] <> own)) - 1, {last})",
        },
    )
    out = stage(
        out,
        {
            "lo": f"CASE WHEN other IS NOT NULL THEN least(other, {c}) ELSE first END",
            "hi": f"CASE WHEN other IS NOT NULL THEN greatest(other, {c}) ELSE last END",
            "seen": f"prob[int({c})] >= {t}",
        },
    )
    out = stage(out, {"solid": f"forall(slice(prob, int(lo + 1), int(hi - lo + 1)), p -> p >= {t})"})
    flag = lambda text, name: f"CAST(coalesce({text}, false) AS INT) AS {name}"
    return out.selectExpr(
        *keys,
        flag("other IS NOT NULL", "neighbour_sites"),
        flag("other IS NOT NULL AND seen", "detected_sites"),
        flag("other IS NOT NULL AND seen AND solid", "fused_sites"),
        flag("other IS NULL", "control_sites"),
        flag("other IS NULL AND NOT solid", "false_splits"),
    )


def sample_rays(sites: DataFrame, voxels: DataFrame, shape: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels (nearest) and probabilities (trilinear) at 49 offsets along each site's normal.

    ``sites``: keys, site, z, y, x, nz, ny, nx.  ``voxels``: keys, z, y, x, label, prob.  ``shape``: keys, depth,
    height, width.  Positions off the volume read as zero.
    """
    keys = list(keys)
    step = F.explode(F.sequence(F.lit(0), F.lit(RAY_SAMPLES - 1)))
    rays = sites.withColumn("i", step).join(shape, keys)
    offset = f"({RAY_STEP}D * (i - {RAY_CENTER}))"
    rays = stage(rays, {f"p{a}": f"{a} + {offset} * n{a}" for a in "zyx"})
    inside = " AND ".join(f"p{a} BETWEEN 0 AND {n} - 1" for a, n in zip("zyx", ("depth", "height", "width")))
    ray = [*keys, "site", "i"]
    within = rays.where(inside).select(*ray, "pz", "py", "px")
    near = stage(within, {f"v{a}": f"CAST(floor(p{a} + 0.5D) AS INT)" for a in "zyx"}).select(*ray, "vz", "vy", "vx")
    # Voxels and samples grow with the volume, whatever Catalyst takes for their size before they are exploded: no broadcast.
    named = voxels.select(*keys, *[F.col(a).alias(f"v{a}") for a in "zyx"], "label", "prob")
    at = [*keys, "vz", "vy", "vx"]
    labels = near.join(named.drop("prob").hint("merge"), at, "left").select(*ray, F.coalesce("label", F.lit(0)).alias("label"))
    # Eight corners with their weights; corners of weight zero drop out.
    corner = [
        "struct(" + ", ".join(f"CAST(floor(p{a}) AS INT) + {d} AS v{a}" for a, d in zip("zyx", c))
        + ", " + " * ".join(f"(p{a} - floor(p{a}))" if d else f"(1D - (p{a} - floor(p{a})))" for a, d in zip("zyx", c)) + " AS w)"
        for c in product((0, 1), repeat=3)
    ]
    corners = within.selectExpr(*ray, f"inline(filter(array({', '.join(corner)}), c -> c.w > 0))")
    values = corners.join(named.drop("label").hint("merge"), at).groupBy(*ray).agg(F.sum(F.col("w") * F.col("prob")).alias("prob"))
    zero = F.lit(0)
    return (
        rays.select(*ray).join(labels.hint("merge"), ray, "left").join(values.hint("merge"), ray, "left")
        .select(*ray, F.coalesce("label", zero).alias("label"), F.coalesce("prob", F.lit(0.0)).alias("prob"))
    )


#: Powers of two of the sides of a block of voxels (z, y, x); along x a block has one word of bits.
BLOCK_BITS = (2, 5, 6)


def _packed(foreground: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, bz, by, bx, words``: the foreground of each block as bits, one word for each of its lines along x."""
    keys = list(keys)
    lines = 1 << (BLOCK_BITS[0] + BLOCK_BITS[1])
    there = foreground.selectExpr(*[f"`{k}`" for k in keys], *[f"CAST({a} AS BIGINT) AS v{a}" for a in "zyx"]).where("vz IS NOT NULL AND vy IS NOT NULL AND vx IS NOT NULL")
    placed = stage(there, {**{f"b{a}": f"shiftright(v{a}, {n})" for a, n in zip("zyx", BLOCK_BITS)}, "line": _line("vz", "vy"), "bit": f"shiftleft(1L, {_inside('vx', BLOCK_BITS[2])})"})
    block = [*keys, "bz", "by", "bx"]
    words = placed.groupBy(*block, "line").agg(F.bit_or("bit").alias("word"))
    listed = words.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct("line", "word"))).alias("m"))
    return listed.selectExpr(*[f"`{k}`" for k in block], f"transform(sequence(0, {lines - 1}), i -> coalesce(try_element_at(m, i), 0L)) AS words")


def _inside(place: str, bits: int) -> str:
    return f"CAST({place} & {(1 << bits) - 1} AS INT)"


def _line(z: str, y: str) -> str:
    return f"{_inside(z, BLOCK_BITS[0])} * {1 << BLOCK_BITS[1]} + {_inside(y, BLOCK_BITS[1])}"


def next_sheet_spacing(sites: DataFrame, foreground: DataFrame, shape: DataFrame, keys: Sequence[str], cap: int = SPACING_CAP) -> DataFrame:
    """Distance along the normal to the next sheet: first hit after leaving the own one, nearer of both sides.

    A site goes once to each block of voxels that its steps meet, and looks its steps up in the block's bits.
    """
    keys = list(keys)
    sides = dict(zip("zyx", ("depth", "height", "width")))
    row = [*keys, "site", "z", "y", "x"]
    full = [*row, *[f"n{a}" for a in "zyx"], *sides.values()]
    steps = f"flatten(transform(array(1, -1), s -> transform(sequence(1, {cap - 1}), d -> s * d)))"
    at = ", ".join(f"CAST(least(greatest(rint({a} + s * n{a}), 0D), {n} - 1) AS INT) AS v{a}" for a, n in sides.items())
    walk = f"transform({steps}, s -> struct(s, {at}))"
    block = ", ".join(f"shiftright(v.v{a}, {n}) AS b{a}" for a, n in zip("zyx", BLOCK_BITS))
    dealt = sites.join(shape, keys).select(*full).withColumn("_b", F.explode(F.expr(f"array_distinct(transform({walk}, v -> struct({block})))")))
    met = dealt.select(*full, *[F.col(f"_b.b{a}").cast("bigint").alias(f"b{a}") for a in "zyx"])
    # Blocks grow with the volume, whatever Catalyst takes for their size before they are exploded: no broadcast.
    met = met.join(_packed(foreground, keys).hint("merge"), [*keys, "bz", "by", "bx"], "left")
    here = " AND ".join(f"shiftright(v.v{a}, {n}) = b{a}" for a, n in zip("zyx", BLOCK_BITS))
    bit = f"shiftright(words[{_line('v.vz', 'v.vy')}], {_inside('v.vx', BLOCK_BITS[2])}) & 1L"
    hits = F.expr(f"CASE WHEN words IS NULL THEN array() ELSE transform(filter({walk}, v -> {here} AND ({bit}) = 1L), v -> v.s) END")
    # At most 2 * (cap - 1) steps per site, so the lists are bounded.
    # Dealt by site once, which serves both aggregates.
    walked = met.select(*full, hits.cast("array<int>").alias("_h")).repartition(*row).groupBy(*full).agg(F.flatten(F.collect_list("_h")).alias("_h"))
    walked = walked.select(*row, *[F.expr(f"transform(filter(_h, s -> s {'>' if sign > 0 else '<'} 0), s -> {sign} * s)").alias(n) for n, sign in (("_up", 1), ("_down", -1))])
    gap = lambda side: F.min(F.expr(f"array_min(array_except(sequence(1, {cap - 1}), {side}))"))
    out = walked.groupBy(*row).agg(*[f(n).alias(f"{n}_{what}") for n in ("_up", "_down") for what, f in (("gap", gap), ("hit", lambda n: F.flatten(F.collect_list(n))))])
    back = [F.expr(f"array_min(filter({n}_hit, d -> d > {n}_gap))") for n in ("_up", "_down")]
    return out.select(*row, F.coalesce(F.least(*back), F.lit(cap)).alias("spacing"))


def panel_measurements(spacing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share and number of compressed sites, median and tenth percentile."""
    from latticeqc.operators.quantiles import exact_quantiles
    from latticeqc.session import materialize

    # Read by the counts and by each pass of the quantiles.
    spacing = materialize(spacing.select(*keys, "spacing"))
    near = F.col("spacing") <= COMPRESSED_MAX
    counts = spacing.groupBy(*keys).agg(
        F.count("*").alias("sites"), F.count_if(near).alias("compressed_sites"), F.avg(near.cast("double")).alias("compressed_share")
    )
    q = exact_quantiles(spacing.withColumn("_s", F.col("spacing").cast("double")), keys, "_s", [0.5, 0.1])
    return counts.join(q.select(*keys, F.col("q")[0].alias("median_spacing"), F.col("q")[1].alias("spacing_p10")), list(keys))


def representative_center(spacing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compressed site nearest the coordinate-wise median, ties by z, y, x; closest sites if none is compressed."""
    from latticeqc.operators.quantiles import exact_quantiles
    from latticeqc.session import materialize

    keys = list(keys)
    spacing = materialize(spacing)
    least = spacing.groupBy(*keys).agg(F.min("spacing").alias("_m"))
    limit = F.greatest(F.col("_m"), F.lit(COMPRESSED_MAX))
    chosen = spacing.join(least, keys).where(F.col("spacing") <= limit)
    long = chosen.select(*keys, F.explode(F.expr("array(struct('z' AS a, double(z) AS v), struct('y' AS a, double(y) AS v), struct('x' AS a, double(x) AS v))")).alias("e")).select(*keys, "e.a", "e.v")
    medians = exact_quantiles(long, [*keys, "a"], "v", [0.5]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("a") == a, F.col("q")[0])).alias(f"m{a}") for a in "zyx"]
    )
    d2 = "(z - mz) * (z - mz) + (y - my) * (y - my) + (x - mx) * (x - mx)"
    best = F.min(F.struct(F.expr(d2).alias("d"), "z", "y", "x"))
    return chosen.join(medians, keys).groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{a}").alias(f"center_{a}") for a in "zyx"])


def inter_sheet_gap(instances: DataFrame, sizes: DataFrame, radius: int = 3, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Background pixels within ``radius`` of at least two instances.

    Two different labels in reach means min and max differ, which aggregates before the shuffle.
    """
    keys = list(keys)
    disk = [(dy, dx) for dy, dx in product(range(-radius, radius + 1), repeat=2) if dy * dy + dx * dx <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk])
    labelled = instances.where("label > 0")
    reached = labelled.withColumn("_o", F.explode(offsets)).select(
        *keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "label"
    )
    close = reached.groupBy(*keys, "y", "x").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    inside = close.join(sizes, keys).where("y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1")
    return inside.select(*keys, "y", "x").join(labelled, [*keys, "y", "x"], "left_anti")


def broadcast_gap(gap: DataFrame, depth: int) -> DataFrame:
    if depth < 1:
        raise ValueError("depth has to be 1 or more")
    return gap.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))


def window_starts(length: str, patch: int, step: int) -> str:
    """Array of window starts that covers ``length`` to its end exactly once more when needed."""
    regular = f"sequence(0, {length} - {patch}, {step})"
    return f"CASE WHEN {length} <= {patch} THEN array(0) ELSE array_union({regular}, array({length} - {patch})) END"


def blend_weight(row: str, col: str, patch: int) -> str:
    """Gaussian tile weight scaled to a peak of one, never below 1e-4."""
    sigma = patch / 8.0
    middle = (patch - 1) / 2.0
    nearest = middle - int(middle)
    bell = lambda p: f"exp(-0.5D * power(({p} - {middle}D) / {sigma}D, 2))"
    peak = f"power(exp(-0.5D * power({nearest}D / {sigma}D, 2)), 2)"
    return f"greatest({bell(row)} * {bell(col)} / {peak}, 1e-4D)"


def overlap_blend(tiles: DataFrame, patch: int, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """``keys, row, col, value``: weighted mean of all tile values at a position.

    ``tiles``: keys, row0, col0 (tile origin), row, col (global position), prob.
    """
    weight = blend_weight("(row - row0)", "(col - col0)", patch)
    weighted = stage(tiles, {"_w": weight})
    return weighted.groupBy(*keys, "row", "col").agg((F.sum(F.col("prob") * F.col("_w")) / F.sum("_w")).alias("value"))


def uncovered(lattice: DataFrame, blended: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Positions no tile reached: an error for the caller when not empty."""
    at = [*keys, "row", "col"]
    return lattice.select(*at).join(blended.select(*at), at, "left_anti")


# Intensity properties the normalization expects.
EXPECTED_PROPERTIES = {"mean": 129.09779357910156, "std": 42.188316345214844, "low": 44.0, "high": 236.0}


def ct_normalize(value: Column, properties: dict[str, float] = EXPECTED_PROPERTIES) -> Column:
    clipped = F.least(F.greatest(value, F.lit(properties["low"])), F.lit(properties["high"]))
    return (clipped - properties["mean"]) / (properties["std"] + 1e-8)


def property_contract(properties: DataFrame, key: str, tolerance: float = 1e-3) -> DataFrame:
    """Rule columns for recorded intensity properties, one row per record."""
    scheme = F.regexp_replace(F.lower("scheme"), "_", "")
    known = F.contains(scheme, F.lit("ctnormalization")) | (scheme == "ct")
    close = F.lit(True)
    for name, expected in EXPECTED_PROPERTIES.items():
        close = close & F.coalesce(F.abs(F.col(name) - expected) <= tolerance, F.lit(False))
    positive = F.coalesce(F.col("std") > 0, F.lit(False))
    ordered = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    return properties.select(
        key, known.alias("scheme_ok"), close.alias("values_ok"), positive.alias("std_ok"), ordered.alias("interval_ok"),
        (known & close & positive & ordered).alias("accepted"),
    )


def validate_prob_cache(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cached file: finite values, range [0, 1], binary labels."""
    p = F.col("prob")
    rules = samples.groupBy(*keys).agg(
        (F.count_if(F.isnan(p) | (F.abs(p) == float("inf")) | p.isNull()) == 0).alias("finite_ok"),
        F.coalesce((F.min("prob") >= 0) & (F.max("prob") <= 1), F.lit(False)).alias("range_ok"),
        (F.count_if(~F.col("gt").isin(0, 1)) == 0).alias("binary_ok"),
    )
    return rules.withColumn("accepted", F.col("finite_ok") & F.col("range_ok") & F.col("binary_ok"))

"""Benchmark and experiment scoring: rates, bootstrap intervals, thresholds, paired runs, gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.functions.numeric import flag_count
from latticeqc.operators.ordering import with_global_position
from latticeqc.operators.ranking import choose_threshold
from latticeqc.session import materialize, small_batches, spread


def rate(numerator: str | Column, denominator: str | Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.try_divide(numerator, denominator)


#: Units of a group that one row holds, and draws that one row asks for.
UNIT_CHUNK, DRAWS = 1 << 18, 1 << 20


def drawn_places(text: str, start: int, stop: int, n: int) -> Iterator[np.ndarray]:
    """The unit that each of the ``n`` draws takes, for iterations ``start`` to ``stop - 1``: the first 15 hex digits of
    md5(text|iteration|draw) modulo ``n``. Digests are made for iterations of one length and draws of one length together."""
    head = f"{text}|".encode()
    lengths = lambda lo, hi: [(max(lo, 10**k if k else 0), min(hi, 10 ** (k + 1)), k + 1) for k in range(20) if max(lo, 10**k if k else 0) < min(hi, 10 ** (k + 1))]
    for first, last, wide in lengths(start, stop):
        # A few iterations at a time, so that the places held are bounded.
        for lo in range(first, last, max(DRAWS // n, 1)):
            hi = min(last, lo + max(DRAWS // n, 1))
            places = np.empty((hi - lo, n), np.int64)
            for a, b, digits in lengths(0, n):
                if len(head) + wide + 1 + digits <= 55:
                    heads = md5_heads(head, np.arange(lo, hi), wide, np.arange(a, b), digits)
                else:
                    joined = b"".join([md5(head + f"{i}|{d}".encode()).digest()[:8] for i in range(lo, hi) for d in range(a, b)])
                    heads = np.frombuffer(joined, ">u8").reshape(hi - lo, b - a)
                places[:, a:b] = ((heads >> 4) % np.uint64(n)).astype(np.int64)
            yield from places


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint64).astype(np.uint32)
#: Messages whose MD5 is taken at once: their words and the state stay in the cache.
MESSAGES = 1 << 15


def _digit_words(numbers: np.ndarray, count: int, end: int) -> dict[int, np.ndarray]:
    """The words of a message block that the ``count`` decimal digits of the numbers touch, when the last one stands before ``end``."""
    words: dict[int, np.ndarray] = {}
    for at in range(end - 1, end - 1 - count, -1):
        digit = (numbers % 10 + 48).astype(np.uint32) << np.uint32(at % 4 * 8)
        words[at // 4] = words[at // 4] | digit if at // 4 in words else digit
        numbers = numbers // 10
    return words


def _md5_block(words: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of one-block messages; a word is an array, or a number where all messages agree."""
    size = max(np.size(w) for w in words)
    a, b, c, d = (np.full(size, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    mixed = np.empty(size, np.uint32)
    for step in range(64):
        turn, inner = divmod(step, 16)
        if turn < 2:
            # b chooses between c and d; in the second turn d chooses between b and c.
            chooser, one, other, word = (b, c, d, inner) if turn == 0 else (d, b, c, (5 * inner + 1) % 16)
            np.bitwise_xor(one, other, out=mixed)
            mixed &= chooser
            mixed ^= other
        elif turn == 2:
            word = (3 * inner + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            word = 7 * inner % 16
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        a += mixed
        if isinstance(words[word], np.ndarray):
            a += words[word]
            a += _SINES[step]
        else:
            a += np.uint32((words[word] + int(_SINES[step])) & 0xFFFFFFFF)
        by = _TURNS[turn][step % 4]
        np.left_shift(a, np.uint32(by), out=mixed)
        a >>= np.uint32(32 - by)
        a |= mixed
        a += b
        a, d, c, b = d, c, b, a
    return a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)


def md5_heads(head: bytes, iterations: np.ndarray, wide: int, draws: np.ndarray, digits: int) -> np.ndarray:
    """The first 8 bytes, as big-endian numbers, of md5(head, iteration, ``|``, draw) for each iteration (rows) and draw.

    Iterations have ``wide`` digits and draws ``digits``, so every message has the same length, 55 bytes at most: one block.
    """
    size = len(head) + wide + 1 + digits
    fixed = bytearray(head + bytes(wide) + b"|" + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    fixed = [int(w) for w in np.frombuffer(bytes(fixed), "<u4")]
    down, across = _digit_words(iterations, wide, len(head) + wide), _digit_words(draws, digits, size)
    out = np.empty((len(iterations), len(draws)), np.uint64)
    rows, columns = max(MESSAGES // len(draws), 1), min(len(draws), MESSAGES)
    for i in range(0, len(iterations), rows):
        for d in range(0, len(draws), columns):
            part = out[i : i + rows, d : d + columns]
            words = list(fixed)
            for held, cut in ((down, lambda w: w[i : i + rows, None]), (across, lambda w: w[None, d : d + columns])):
                for at, word in held.items():
                    words[at] = words[at] | cut(word)
            words = [np.broadcast_to(w, part.shape).ravel() if isinstance(w, np.ndarray) else w for w in words]
            low, high = _md5_block(words)
            part[:] = (low.byteswap().astype(np.uint64) << np.uint64(32) | high.byteswap().astype(np.uint64)).reshape(part.shape)
    return out


def _drawn_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, iteration, num, den``: sums over the units that the draws of each iteration take from one chunk of units.

    The draws of a range of iterations become multiplicities (iteration by unit) in one array, whose product with the
    units gives the sums, so no row per unit and iteration exists anywhere.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text, n, chunk, start, stop = (batch[c][at].as_py() for c in ("text", "n", "chunk", "start", "stop"))
                units = [batch[c][at].values.to_numpy() for c in ("num", "den")]
                sums = [[], []]
                for place in drawn_places(text, start, stop, n):
                    place = place - chunk * UNIT_CHUNK
                    times = np.bincount(place[(place >= 0) & (place < len(units[0]))], minlength=len(units[0]))
                    for held, unit in zip(sums, units):
                        held.append(float(times @ unit))
                first = [batch[k].take(pa.array(np.full(stop - start, at))) for k in keys]
                yield pa.RecordBatch.from_arrays([*first, pa.array(np.arange(start, stop)), *map(pa.array, sums)], [*keys, "iteration", "num", "den"])

    return rows.mapInArrow(draw, ", ".join(filter(None, [kinds, "iteration bigint, num double, den double"])))


def cluster_bootstrap(
    units: DataFrame, keys: Sequence[str], unit: str, seed: str, iterations: int = 10_000, bounds: Sequence[float] = (0.025, 0.975)
) -> DataFrame:
    """Percentile interval of sum(num)/sum(den) over units drawn with replacement, per key group.

    ``units`` has ``keys, unit, num, den``, one row per unit.  Draw ``d`` of iteration ``i`` takes the unit at
    place ``md5(seed|keys|i|d) mod n``, so draws need no generator state and can run anywhere. A null num or den counts as 0.
    Units are held in chunks of UNIT_CHUNK; a group of more chunks makes its draws once for each of them.
    """
    keys = list(keys)
    small_batches(units.sparkSession)
    placed = materialize(with_global_position(units.select(*keys, unit, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("num", "den")]), [unit], keys=keys))
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "num", "den")))
    chunks = placed.groupBy(*keys, F.floor(F.col("pos") / UNIT_CHUNK).alias("chunk")).agg(listed.alias("u"))
    chunks = chunks.join(sizes, keys) if keys else chunks.crossJoin(sizes)
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    span = F.greatest(F.lit(1), F.floor(F.lit(DRAWS) / F.col("n"))).cast("int")
    starts = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), span))
    rows = chunks.select(*keys, "chunk", "n", text.alias("text"), F.col("u.num").alias("num"), F.col("u.den").alias("den"), span.alias("span"), starts.alias("start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + F.col("span"), F.lit(iterations))).drop("span")
    summed = _drawn_sums(spread(rows, *keys, "chunk", "start"), keys).groupBy(*keys, "iteration").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    rates = summed.select(*keys, (F.col("num") / F.col("den")).alias("rate"))
    points = F.array(*[F.lit(float(b)) for b in bounds])
    total = units.groupBy(*keys).agg(F.count("*").alias("units"), (F.sum("num") / F.sum("den")).alias("estimate"))
    interval = rates.groupBy(*keys).agg(F.percentile("rate", points).alias("q"))
    joined = total.join(interval, keys) if keys else total.crossJoin(interval)
    return joined.select(*keys, "units", "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def detection_rates(cases: DataFrame) -> DataFrame:
    """Cases, components, detections and rates by split, offset and width."""
    flags = {"raw": "raw_detected", "incremental": "detected", "step": "step_detected", "before": "before_detected"}
    counted = cases.groupBy("split", "offset_voxels", "width_cells").agg(
        F.count("*").alias("cases"),
        F.count_distinct("component_id").alias("components"),
        *[flag_count(F.col(c)).alias(f"{n}_cases") for n, c in flags.items()],
        F.sum("evaluation_cells").alias("evaluation_cells"),
        F.sum("incremental_localized").alias("incremental_localized"),
    )
    return counted.withColumns({f"{n}_rate": F.col(f"{n}_cases") / F.col("cases") for n in flags})


def alert_summary(observations: DataFrame) -> DataFrame:
    """Alert counts and rates in annotated neighbourhoods, for all packages and for the holdout group."""
    holdout = F.col("evaluation_group") == "holdout"
    groups = F.array(F.lit("all"), F.when(holdout, F.lit("holdout")))
    spread = observations.withColumn("group", F.explode(F.filter(groups, lambda g: g.isNotNull())))
    marked = (F.col("points") > 0) & (F.col("near_cells") > 0)
    inside = lambda c: F.sum(F.when(marked, F.col(c)).otherwise(0))
    out = spread.groupBy("group").agg(
        F.count("*").alias("packages"),
        F.count_distinct("component_id").alias("components"),
        flag_count(marked).alias("annotated"),
        inside("points").alias("points"),
        inside("near_cells").alias("near_cells"),
        inside("cue_cells").alias("cue_cells"),
        flag_count(marked & (F.col("cue_cells") > 0)).alias("cue_packages"),
        flag_count(F.col("any_cue")).alias("packages_with_cue"),
    )
    return out.withColumns({"cue_cell_rate": rate("cue_cells", "near_cells"), "cue_package_rate": rate("cue_packages", "annotated")})


def null_control_summary(nulls: DataFrame, checks: Sequence[str]) -> DataFrame:
    return nulls.groupBy("split").agg(F.count("*").alias("cases"), *[flag_count(~F.col(c)).alias(f"{c}_mismatches") for c in checks])


COUNTS = ("neighbour_sites", "detected_sites", "fused_sites", "control_sites", "false_splits")


def pool_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts summed first, rates of the sums second; an empty denominator counts as one."""
    summed = rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return summed.withColumns(
        {
            "detection_rate": F.col("detected_sites") / one("neighbour_sites"),
            "fusion_rate": F.col("fused_sites") / one("detected_sites"),
            "false_split_rate": F.col("false_splits") / one("control_sites"),
        }
    )


def mean_by_threshold(scores: DataFrame) -> DataFrame:
    return scores.groupBy("run", "threshold").agg(F.avg("blend").alias("mean_blend"))


def threshold_selection(scores: DataFrame) -> DataFrame:
    """Frozen threshold per run from validation scores."""
    return choose_threshold(mean_by_threshold(scores))


def paired_delta(scores: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """``seed, patch, delta``: second arm minus first on the same seed and patch."""
    wide = scores.where(F.col("arm").isin(*arms)).groupBy("seed", "patch").agg(
        *[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(f"v{i}") for i, a in enumerate(arms)]
    )
    return wide.where("v0 IS NOT NULL AND v1 IS NOT NULL").select("seed", "patch", (F.col("v1") - F.col("v0")).alias("delta"))


def pooled_delta(deltas: DataFrame) -> DataFrame:
    """Mean over seeds per patch."""
    return deltas.groupBy("patch").agg(F.avg("delta").alias("delta"), F.count("*").alias("seeds"))


def bootstrap_mean_interval(values: DataFrame, keys: Sequence[str], unit: str, value: str, seed: str, iterations: int = 10_000) -> DataFrame:
    units = values.select(*keys, unit, F.col(value).alias("num"), F.lit(1.0).alias("den"))
    return cluster_bootstrap(units, keys, unit, seed, iterations)


def paired_report(scores: DataFrame, arms: tuple[str, str], seed: str, iterations: int = 10_000) -> DataFrame:
    """Per-seed and pooled mean differences with bootstrap intervals."""
    deltas = materialize(paired_delta(scores, arms))
    single = bootstrap_mean_interval(deltas.withColumn("scope", F.concat(F.lit("seed "), F.col("seed").cast("string"))), ["scope"], "patch", "delta", seed, iterations)
    pooled = bootstrap_mean_interval(pooled_delta(deltas).withColumn("scope", F.lit("pooled")), ["scope"], "patch", "delta", seed, iterations)
    return single.unionByName(pooled)


# Limits of the preregistered gates.
FUSION_LIMIT, DETECTION_LIMIT, SPLIT_LIMIT = -0.10, -0.02, 0.02


def rate_gates(pooled: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """Rate differences between two arms per seed, the three gates, and whether each holds for all seeds."""
    names = {"fusion": "fusion_rate", "detection": "detection_rate", "split": "false_split_rate"}
    arm = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    deltas = pooled.groupBy("seed").agg(*[(arm(arms[1], c) - arm(arms[0], c)).alias(f"{n}_delta") for n, c in names.items()])
    gated = deltas.withColumns(
        {
            "fusion_ok": F.col("fusion_delta") <= FUSION_LIMIT,
            "detection_ok": F.col("detection_delta") >= DETECTION_LIMIT,
            "split_ok": F.col("split_delta") <= SPLIT_LIMIT,
        }
    )
    return gated


def gate_totals(gated: DataFrame) -> DataFrame:
    return gated.agg(*[F.bool_and(f"{g}_ok").alias(f"all_{g}") for g in ("fusion", "detection", "split")])


def expected_vs_actual(expected: DataFrame, actual: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per case a flag for each column and their conjunction; a case missing on either side fails."""
    e = expected.select(*keys, F.lit(True).alias("_e"), *[F.col(c).alias(f"e_{c}") for c in columns])
    a = actual.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    there = F.coalesce(F.col("_e") & F.col("_a"), F.lit(False))
    flags = {c: there & F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in columns}
    passed = there
    for flag in flags.values():
        passed = passed & flag
    # Digests shrink so well in a shuffle that AQE would join many partitions into one task; a stated number stays.
    return spread(e, *keys).join(spread(a, *keys), list(keys), "full_outer").select(*keys, *[f.alias(f"{c}_ok") for c, f in flags.items()], passed.alias("passed"))


def set_match(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Ids on one side only."""
    missing = expected.select(key).distinct().join(observed.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = observed.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def frozen_gate(runs: DataFrame, manifest: DataFrame, status: str, grid: Sequence[float]) -> DataFrame:
    """Rules that have to hold before test data is touched, one row per run."""
    joined = runs.join(manifest, "run", "left")
    no = F.lit(False)
    rules = {
        "present": F.col("selected_threshold").isNotNull(),
        "status_ok": F.coalesce(F.col("status") == status, no),
        "split_ok": F.coalesce(F.col("manifest_split") == F.col("split_hash"), no),
        "threshold_ok": F.coalesce(F.col("selected_threshold").isin(*[float(g) for g in grid]), no),
    }
    passed = rules["present"]
    for rule in rules.values():
        passed = passed & rule
    return joined.select("run", *[r.alias(n) for n, r in rules.items()], passed.alias("open"))


def replicate_determinism(records: DataFrame) -> DataFrame:
    return records.groupBy("variant").agg(
        F.count("*").alias("replicates"), F.count_distinct("digest").alias("digests")
    ).withColumn("deterministic", F.col("digests") == 1)

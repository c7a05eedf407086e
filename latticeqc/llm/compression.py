"""Quality rules by compression bands.

The zstandard ratio (compressed over plain bytes) of a whole document, and of its fixed chunks, has to
lie within the limits for its length. The last chunk is the final ``chunk_bytes`` of the text; where it
overlaps the one before, it weighs as much as the bytes that it adds. A text below ``chunk_bytes`` is one piece,
which the limits for its length judge. Text that repeats itself falls below the band, text that does not
compress (encoded binary, keys, random characters) lies above it. Short texts compress badly by nature,
so the limits depend on the length. A document is rejected for its chunks when more than ``chunk_share``
of its bytes lie in chunks outside, so one table or list does not reject a long document.

``fit_rules`` moves the stated limits inwards to what the corpus shows: for each doubling of the length it takes the
5 % and 95 % points of the ratios of all different texts that pass the base rules (copies count once), leaves a margin beyond them, and
moves a limit by ``FitLimits.low_move`` or ``high_move`` at most, so that a length that is full of junk or of copies of one text
cannot turn the limits against the rest. Lengths with few texts keep the stated limits; so does an empty table.

A null text counts as empty; an empty text has ratio null, fails the word rule and is not kept. Repeated
rows give repeated results; other columns are ignored; whole texts are read, chunk by chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs

#: Bytes from which a band holds, lowest and highest ratio of a whole document.
BANDS = (
    (0, 0.0, 9.0),
    (64, 0.30, 1.30),
    (256, 0.33, 0.92),
    (1024, 0.25, 0.80),
    (4096, 0.20, 0.75),
    (16384, 0.15, 0.72),
)
SYMBOLS = b"#*$%&|<>"
SPACES = bytes([*range(9, 14), 32])
INSIDE = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class CompressionRules:
    """Limits of the compression bands; ``min_words`` and ``max_repeat_percent`` are the base rules."""

    level: int = 3
    chunk_bytes: int = 4096
    chunk_low: float = 0.15
    chunk_high: float = 0.72
    chunk_share: float = 0.2
    min_words: int = 50
    max_repeat_percent: int = 50
    bands: tuple[tuple[int, float, float], ...] = BANDS


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    code: dict[tuple, int] = {}
    at = np.array([code.setdefault(w, len(code)) for w in windows])
    starts = np.bincount(at)[at] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(starts)] |= starts
    return int(inside.sum())


def _judge(text: bytes, rules: CompressionRules, compressor) -> tuple:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    size = rules.chunk_bytes
    ratio = len(compressor.compress(text)) / len(text) if text else None
    starts = range(0, len(text), size) if len(text) >= size else ()
    chunks = [len(compressor.compress(text[at : at + size])) / size for at in (min(s, len(text) - size) for s in starts)]
    low, high = next((b[1], b[2]) for b in reversed(rules.bands) if len(text) >= b[0])
    outside = sum(min(size, len(text) - at) for at, c in zip(starts, chunks) if not rules.chunk_low <= c <= rules.chunk_high)
    if ratio is None:
        verdict = "empty"
    elif ratio < low:
        verdict = "repetitive"
    elif ratio > high:
        verdict = "incompressible"
    elif outside > rules.chunk_share * len(text):
        verdict = "chunks"
    else:
        verdict = "pass"
    return (
        len(words), len(text.translate(None, SPACES + INSIDE)), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeat, failed, verdict == "pass" and not failed, ratio, min(chunks, default=None), max(chunks, default=None), verdict,
    )


@dataclass(frozen=True)
class FitLimits:
    """How far ``fit_rules`` may move a limit, the margin it leaves, and the different texts that a length has to have."""

    low_margin: float = 0.8
    high_margin: float = 1.15
    low_move: float = 0.10
    high_move: float = 0.15
    min_texts: int = 100
    accuracy: int = 10_000


def fit_rules(docs: DataFrame, rules: CompressionRules = CompressionRules(), limits: FitLimits = FitLimits(), text_col: str = "text") -> CompressionRules:
    """``rules`` with bands and chunk limits fitted to all texts of ``docs``; at most one row per doubling of the length reaches the driver."""
    rows = inputs(docs, body_=text_col)
    rows = rows.withColumn("body_", rows["body_"].cast("binary"))
    size = rules.chunk_bytes

    def measure(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=rules.level)
        found: list[tuple[int, int, float]] = []
        for text in batch["body_"].to_pylist():
            words = text.split() if text else []
            if len(words) < rules.min_words or 100 * repeated_words(words) > rules.max_repeat_percent * len(words):
                continue
            found.append((len(text).bit_length() - 1, len(text), len(compressor.compress(text)) / len(text)))
            found += [(-1, size, len(compressor.compress(text[at : at + size])) / size) for at in range(0, len(text) - size + 1, size)]
        group, length, ratio = zip(*found) if found else ((), (), ())
        return {"doubling": pa.array(group, pa.int32()), "length": pa.array(length, pa.int64()), "ratio": pa.array(ratio, pa.float64())}

    points = F.percentile_approx("ratio", F.array(F.lit(0.05), F.lit(0.95)), limits.accuracy).alias("at")
    seen = arrow_pass(rows, measure, "doubling int, length bigint, ratio double").distinct().groupBy("doubling").agg(F.count("*").alias("n"), points)
    shown = {r.doubling: r["at"] for r in seen.where(F.col("n") >= limits.min_texts).collect()}

    def moved(low: float, high: float, at: list[float] | None) -> tuple[float, float]:
        if at is None:
            return low, high
        return min(max(low, at[0] * limits.low_margin), low + limits.low_move), max(min(high, at[1] * limits.high_margin), high - limits.high_move)

    starts = sorted({b[0] for b in rules.bands} | {1 << k for k in shown if k >= 0} | {2 << k for k in shown if k >= 0})
    bands = []
    for start in starts:
        stated = [b for b in rules.bands if b[0] <= start]
        if stated:
            bands.append((start, *moved(*max(stated)[1:], shown.get(start.bit_length() - 1) if start else None)))
    low, high = moved(rules.chunk_low, rules.chunk_high, shown.get(-1))
    return replace(rules, bands=tuple(bands), chunk_low=low, chunk_high=high)


COLUMNS = (
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("chunk_min", "double"), ("chunk_max", "double"), ("band", "string"),
)


def judge_documents(docs: DataFrame, rules: CompressionRules = CompressionRules(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, the counts, base_failed, kept, ratios and the band's verdict.

    Columns named in ``carry`` are passed along in front, under their own names, in place of ``doc_id``.
    """
    own = {f"c{i}": name for i, name in enumerate(carry)} or {"doc_id": id_col}
    rows = inputs(docs, **own, body_=text_col)
    rows = rows.withColumn("body_", rows["body_"].cast("binary"))
    made = [(f"{n}_" if carry else n, kind) for n, kind in COLUMNS]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in own], *[f"{n} {kind}" for n, kind in made]])

    def judge(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=rules.level)
        found = [_judge(t or b"", rules, compressor) for t in batch["body_"].to_pylist()]
        values = zip(*found) if found else [[] for _ in made]
        return {**{n: batch[n] for n in own}, **{n: pa.array(v, kinds[kind]) for (n, kind), v in zip(made, values)}}

    out = arrow_pass(rows, judge, schema)
    return out.withColumnsRenamed(own) if carry else out


def keep_documents(docs: DataFrame, rules: CompressionRules = CompressionRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    own = {name: f"in{i}" for i, name in enumerate(docs.columns)}
    rows = inputs(docs, **{v: k for k, v in own.items()})
    judged = judge_documents(rows, rules, text_col=own[text_col], carry=tuple(own.values()))
    return judged.where("kept_").select(*[judged[v].alias(k) for k, v in own.items()])

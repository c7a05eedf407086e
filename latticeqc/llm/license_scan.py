"""License scans by diagonal voting.

Templates are short license statements. Every run of k words of every text is hashed, and Spark joins
all hashes to the template positions with the same hash. A hit at text word i and template word j lies on
diagonal i - j; hits of one template on one diagonal vote for a copy of the template that starts there.
Words that were put in or left out move the rest to a neighbouring diagonal, so neighbouring diagonals
that overlap in the text are merged to one span. A span is verified on the words themselves: the share of the
template's words found in order (longest common subsequence) inside the span.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. The base phrases are found
exactly, word for word. A null text is empty: no words, no labels, null places. Repeated rows give
repeated results, also with the same id; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs, written
from latticeqc.llm.words import hash_words, window_hashes

#: Phrases of the base labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Statements that name or make up a license, by the label they give.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd license",
    ),
    "cc-by-4.0": ("licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0",),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "mit-statement": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLICE = 500


@dataclass(frozen=True)
class LicenseScan:
    """A span counts from ``min_share`` of the template's words in order; diagonals up to ``drift`` apart are neighbours."""

    k: int = 3
    drift: int = 4
    min_share: float = 0.85


def template_table(templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[bytes]]]:
    return [(label, text.encode().split()) for label in sorted(templates) for text in templates[label]]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())  # bytes.lower changes A-Z only


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, body, row_``; equal rows have the same ``row_``, which any number of scans gives alike."""
    rows = inputs(docs, doc_id=id_col, body=text_col).withColumn("body", F.col("body").cast("binary"))
    return rows.withColumn("row_", F.xxhash64("doc_id", "body"))


def phrase_places(words: list[bytes], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places where phrases stand, smallest and largest start, and their labels."""
    starts, labels = [], set()
    if not phrases.keys().isdisjoint(words):
        for at, word in enumerate(words):
            for phrase, label in phrases.get(word, ()):
                if words[at : at + len(phrase)] == phrase:
                    starts.append(at)
                    labels.add(label)
    return len(starts), min(starts, default=None), max(starts, default=None), labels


def run_hashes(rows: DataFrame, scan: LicenseScan) -> DataFrame:
    """``row_, at, hash`` for every run of k words of every text."""

    def hashes(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            words = [words_of(t) for t in part["body"].to_pylist()]
            count = np.array([len(w) for w in words])
            flat = hash_words(pa.array([x for w in words for x in w], pa.binary()))
            runs = window_hashes(flat, scan.k)
            ends = np.cumsum(count)
            at = np.arange(len(flat)) - np.repeat(ends - count, count)
            whole = (at + scan.k <= np.repeat(count, count))[: len(runs)]
            row = np.repeat(np.asarray(part["row_"]), count)[: len(runs)][whole]
            yield pa.RecordBatch.from_pydict({"row_": row, "at": at[: len(runs)][whole].astype(np.int64), "hash": runs[whole].view(np.int64)})

    return rows.select("row_", "body").mapInArrow(lambda batches: (out for b in batches for out in hashes(b)), "row_ bigint, at bigint, hash bigint")


def template_positions(spark, templates, scan: LicenseScan) -> DataFrame:
    """``hash, template, place``: as many rows as the templates have words, at most."""
    found = []
    for number, (_, words) in enumerate(templates):
        runs = window_hashes(hash_words(pa.array(words, pa.binary())), scan.k).view(np.int64)
        found += [(int(h), number, place) for place, h in enumerate(runs)]
    return spark.createDataFrame(found, "hash bigint, template int, place int")


def diagonal_spans(hits: DataFrame, scan: LicenseScan) -> DataFrame:
    """``row_, template, first, last, votes``: votes by diagonal, neighbouring diagonals that overlap merged."""
    diagonals = hits.withColumn("diagonal", F.col("at") - F.col("place")).groupBy("row_", "template", "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("votes"))
    along = Window.partitionBy("row_", "template").orderBy("first", "diagonal")
    before = Window.partitionBy("row_", "template").orderBy("first", "diagonal").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max("last").over(before)
    apart = F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > scan.drift
    # A new span begins where nothing before reaches, or on a diagonal that is no neighbour of the one before.
    begins = F.when(far.isNull() | (F.col("first") > far + scan.drift + scan.k) | apart, 1).otherwise(0)
    numbered = diagonals.withColumn("begins", begins).withColumn("span", F.sum("begins").over(along))
    return numbered.groupBy("row_", "template", "span").agg(F.min("first").alias("first"), (F.max("last") + scan.k - 1).alias("last"), F.sum("votes").alias("votes")).drop("span")


def common_in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def best_share(template: list[bytes], words: list[bytes], least: float) -> float:
    """Largest share of the template that stands in order in windows of four template lengths, each half over the next.

    So whatever fits into two lengths lies whole in a window. A window of a long span is compared only if it holds ``least`` of
    the template's words in any order.
    """
    size = 4 * len(template)
    if len(words) <= size:
        return common_in_order(template, words) / len(template)
    need, best = Counter(template), 0.0
    for start in range(0, len(words) - size // 2, size // 2):
        window = words[start : start + size]
        if (need & Counter(window)).total() >= max(least, best) * len(template):
            best = max(best, common_in_order(template, window) / len(template))
    return best


def scan_licenses(docs: DataFrame, scan: LicenseScan = LicenseScan(), templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and spans.

    Documents: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.
    Spans: ``row_, label, first, last, votes, share`` of what was verified, by the row's hash.
    """
    listed = template_table(templates)
    rows = _rows(docs, id_col, text_col)
    positions = F.broadcast(template_positions(docs.sparkSession, listed, scan))
    hits = written(run_hashes(rows, scan).join(positions, "hash").select("row_", "template", "place", "at"))
    spans = written(diagonal_spans(hits, scan).where(F.col("votes") >= 1).groupBy("row_").agg(F.collect_list(F.struct("template", "first", "last", "votes")).alias("spans")))
    phrases: dict[bytes, list] = {}
    for text, label in BASE.items():
        words = text.encode().split()
        phrases.setdefault(words[0], []).append((words, label))
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "row_", "left")

    def verify(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "verified")}
        for text, found in zip(batch["body"].to_pylist(), batch["spans"].to_pylist()):
            words = words_of(text)
            n, first, last, base = phrase_places(words, phrases)
            good = []
            for s in found or ():
                label, template = listed[s["template"]]
                # Ends of a template shorter than k are not in the hits: look at as many words around.
                wide = words[max(0, s["first"] - scan.k) : s["last"] + 1 + scan.k]
                share = best_share(template, wide, scan.min_share)
                if share >= scan.min_share:
                    good.append({"label": label, "first": s["first"], "last": s["last"], "votes": s["votes"], "share": share})
            out["n_words"].append(len(words))
            out["n_base"].append(n)
            out["first_word"].append(first)
            out["last_word"].append(last)
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {g["label"] for g in good})))
            out["score"].append(max([g["share"] for g in good] + [1.0 if n else 0.0]))
            out["verified"].append(good)
        long = pa.int64()
        kinds = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        span = pa.list_(pa.struct([("label", pa.string()), ("first", long), ("last", long), ("votes", long), ("share", pa.float64())]))
        return {"row_": batch["row_"], "doc_id": batch["doc_id"], **{c: pa.array(v, kinds.get(c, span)) for c, v in out.items()}}

    schema = f"row_ bigint, doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, verified array<struct<label:string,first:bigint,last:bigint,votes:bigint,share:double>>"
    judged = arrow_pass(joined.select("row_", "doc_id", "body", "spans"), verify, schema)
    return judged.drop("row_", "verified"), judged.select("row_", "doc_id", F.explode("verified").alias("s")).select("row_", "doc_id", "s.*")

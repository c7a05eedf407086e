"""Toxicity by a convolutional text classifier.

Words between ASCII white space, lower-cased and without punctuation at their ends, are hashed to rows of an embedding table:
the whole word and its first and last letters, whose rows are added. Filters of several widths run over the word vectors, the
largest response of each filter in the text goes through a logistic layer. The net learns from every labelled row: rows are
dealt to shards of bounded size by a hash of their id; the first shard trains the net by several rounds, all other shards go
on from there at once, one round each, and what they changed is averaged (an embedding row over the shards that changed it).
A part of the rows is held back; all of it is scored and counted by label, language and score to turn the output into a probability
and to choose a threshold for each language. Scores depend on the text alone; the language of a row only picks the threshold of ``flagged``.

A null text is empty; an empty text is padding only and has the score that the net gives to it. Texts of any length are scored
whole: words are numbered per Arrow batch and the filters run over bounded spans, so a long text costs time but no memory beyond its
own words. Repeated rows give repeated results. Without labels of both kinds the score is the share of label 1 (0 without any). An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs, written
from latticeqc.llm.words import split_words
from latticeqc.session import spread

STRIP = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’…*#$%&|~`^_=+/\\-–—¡¿@"
#: Words of a text that the filters see at once.
SPAN = 1 << 16


@dataclass(frozen=True)
class NetShape:
    buckets: int = 1 << 18
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 24


@dataclass(frozen=True)
class FitRules:
    """``shard_chars`` code points of text are meant for a shard, which is trained in one task."""

    shard_chars: int = 16_000_000
    #: Rounds over the first shard at least, and batches at least, as few rows need more rounds.
    epochs: int = 6
    batches: int = 400
    batch: int = 50
    rate: float = 0.08
    held_back: float = 0.2
    seed: int = 7
    #: Least number of calibration rows of label 1 for a threshold of a language's own.
    language_rows: int = 15


@dataclass
class Net:
    shape: NetShape
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    base_rate: float | None = None


def word_features(words: list[str], buckets: int) -> np.ndarray:
    """Rows of the embedding table for each word: the word, its first 3, 4 and 5 letters, its last 4; row 0 is padding."""
    plain = [w.lower().strip(STRIP) for w in words]
    parts = [[f"w{p}" for p in plain], [f"a{p[:3]}" for p in plain], [f"b{p[:4]}" for p in plain], [f"c{p[:5]}" for p in plain], [f"e{p[-4:]}" for p in plain]]
    if not words:
        return np.zeros((0, len(parts)), np.int32)
    hashes = [pd.util.hash_array(np.array(p, dtype=object), categorize=False) for p in parts]
    return np.stack([(h % np.uint64(buckets - 1)).astype(np.int32) + 1 for h in hashes], axis=1)


def numbered_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the number of each word in order, and where each text begins (one more at the end)."""
    flat, starts = split_words(texts)
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), starts


def new_net(shape: NetShape, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (shape.buckets, shape.size)).astype(np.float32)
    table[0] = 0
    out = rng.normal(0, 0.1, len(shape.widths) * shape.filters).astype(np.float32)
    kernels = [rng.normal(0, 0.3, (w, shape.size, shape.filters)).astype(np.float32) for w in shape.widths]
    return Net(shape, table, kernels, [np.zeros(shape.filters, np.float32) for _ in shape.widths], out)


def _responses(vectors: np.ndarray, at: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at each start; ``at`` are word numbers with padding (the last vector) behind every text."""
    out = np.broadcast_to(bias, (len(at), kernel.shape[2])).copy()
    for step in range(len(kernel)):
        part = vectors @ kernel[step]
        out[: len(at) - step] += part[at[step:]] if step else part[at]
    return out


def padded(at: np.ndarray, starts: np.ndarray, blank: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each followed by ``pad`` blanks, so that no filter sees two texts; and their new starts."""
    sizes = np.diff(starts)
    begin = np.concatenate([[0], np.cumsum(sizes + pad)])
    out = np.full(begin[-1], blank, np.int64)
    out[np.arange(len(at)) + np.repeat(begin[:-1] - starts[:-1], sizes)] = at
    return out, begin


def raw_scores(net: Net, features: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Output before calibration of each text; long texts pass in spans that overlap by the widest filter."""
    pad = max(net.shape.widths)
    vectors = np.vstack([net.table[features].sum(1), np.zeros((1, net.shape.size), np.float32)])
    line, begin = padded(at, starts, len(features), pad)
    texts = len(starts) - 1
    best = np.full((texts, len(net.out)), -np.inf, np.float32)
    parts = [[vectors @ k[step] for step in range(len(k))] for k in net.kernels]
    # The last blanks of a text see the next one.
    ends = (begin[1:, None] - np.arange(pad - 1, 0, -1)).ravel()
    for lo in range(0, len(line), SPAN):
        hi = min(lo + SPAN, len(line))
        blind = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, hi)] - lo
        first, last = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
        edges = np.maximum(begin[first:last], lo) - lo
        for k, (kernel, bias) in enumerate(zip(net.kernels, net.biases)):
            seen = parts[k][0][line[lo:hi]]
            for step in range(1, len(kernel)):
                more = line[lo + step : hi + step]
                seen[: len(more)] += parts[k][step][more]
            seen[blind] = -np.inf
            top = np.maximum.reduceat(seen, edges) + bias
            own = slice(k * net.shape.filters, (k + 1) * net.shape.filters)
            best[first:last, own] = np.maximum(best[first:last, own], top)
    return np.maximum(best, 0) @ net.out + net.offset


def _tops(vectors: np.ndarray, line: np.ndarray, begin: np.ndarray, kernel: np.ndarray, bias: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each text and its place; long texts pass in spans."""
    top = np.full((len(begin) - 1, kernel.shape[2]), -np.inf, np.float32)
    place = np.zeros(top.shape, np.int64)
    for lo in range(0, len(line), SPAN):
        hi = min(lo + SPAN, len(line))
        response = _responses(vectors, line[lo : hi + len(kernel) - 1], kernel, bias)
        for text in range(np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")):
            b, e = max(begin[text], lo), min(begin[text + 1] - pad + 1, hi)
            if b < e:
                at = response[b - lo : e - lo].argmax(0) + b
                value = response[at - lo, np.arange(len(at))]
                place[text] = np.where(value > top[text], at, place[text])
                top[text] = np.maximum(top[text], value)
    return top, place


def train(net: Net, features: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, rules: FitRules, rounds: int, seed: int, weight: float = 1.0) -> None:
    """Adagrad on the logistic loss, rows of label 1 times ``weight``; a gradient reaches only the words where a filter responds most."""
    shape = net.shape
    rng = np.random.default_rng(seed)
    pad, count = max(shape.widths), shape.filters
    seen = {"table": np.full((shape.buckets, 1), 1e-3, np.float32), "out": np.full_like(net.out, 1e-3), "offset": 1e-3}
    seen_k = [np.full_like(k, 1e-3) for k in net.kernels]
    seen_b = [np.full_like(b, 1e-3) for b in net.biases]
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), rules.batch):
            chosen = order[lo : lo + rules.batch]
            starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
            words, at = np.unique(np.concatenate([texts[i] for i in chosen]), return_inverse=True)
            rows = np.vstack([features[words], np.zeros((1, features.shape[1]), features.dtype)])
            vectors = net.table[rows].sum(1)
            vectors[-1] = 0
            line, begin = padded(at, starts, len(words), pad)
            tops, places = [], []
            for kernel, bias in zip(net.kernels, net.biases):
                top, place = _tops(vectors, line, begin, kernel, bias, pad)
                places.append(place)
                tops.append(top)
            hidden = np.maximum(np.concatenate(tops, axis=1), 0)
            error = (1 / (1 + np.exp(-(hidden @ net.out + net.offset))) - labels[chosen]) * np.where(labels[chosen] == 1, weight, 1.0)
            back = error[:, None] * net.out * (hidden > 0) / len(chosen)
            grad_out = hidden.T @ error / len(chosen)
            moved = np.zeros_like(vectors)
            for k, kernel in enumerate(net.kernels):
                own = back[:, k * count : (k + 1) * count]
                grad_k = np.zeros_like(kernel)
                for step in range(len(kernel)):
                    word = line[np.minimum(places[k] + step, len(line) - 1)]
                    grad_k[step] = np.einsum("nf,nfd->df", own, vectors[word])
                    np.add.at(moved, word.ravel(), (own[:, :, None] * kernel[step].T[None]).reshape(-1, shape.size))
                _adagrad(kernel, grad_k, seen_k[k], rules.rate)
                _adagrad(net.biases[k], own.sum(0), seen_b[k], rules.rate)
            _adagrad(net.out, grad_out, seen["out"], rules.rate)
            step = float(error.mean())
            seen["offset"] += step * step
            net.offset -= rules.rate * step / np.sqrt(seen["offset"])
            hit = np.flatnonzero(moved[:-1].any(1))
            flat, grad = rows[hit].ravel(), np.repeat(moved[hit], rows.shape[1], axis=0)
            used, inverse = np.unique(flat, return_inverse=True)
            total = np.zeros((len(used), shape.size), np.float32)
            np.add.at(total, inverse, grad)
            seen["table"][used] += (total * total).mean(1, keepdims=True)
            net.table[used] -= rules.rate * total / np.sqrt(seen["table"][used])


def _adagrad(value: np.ndarray, grad: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += grad * grad
    value -= rate * grad / np.sqrt(seen)


def calibrate(net: Net, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list[str], rules: FitRules) -> None:
    """Slope and shift of the probability by Newton steps, then the threshold of the best F1 per language; ``weights`` count rows."""
    slope, shift = 1.0, 0.0
    # Target values short of 0 and 1 keep the slope finite where the labels can be told apart entirely.
    n1, n0 = (labels * weights).sum(), ((1 - labels) * weights).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        g = weights * (p - target)
        h = weights * np.maximum(p * (1 - p), 1e-6)
        jac = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(jac, [(g * raw).sum() + 1e-3 * (slope - 1), g.sum()])
        # Steps of one at most, as full ones run away where the labels can nearly be told apart.
        move = np.clip(move, -1.0, 1.0)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    net.slope, net.shift = float(max(slope, 1e-3)), float(shift)
    scores = probabilities(net, raw)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(weights[own][labels[own] == k].sum() for k in (0, 1)) < rules.language_rows:
            continue
        order = np.argsort(-scores[own], kind="stable")
        ranked, hit, weight = scores[own][order], labels[own][order], weights[own][order]
        true = np.cumsum(hit * weight)
        f1 = 2 * true / (np.cumsum(weight) + (hit * weight).sum())
        # Only between different scores; the threshold lies halfway to the next one.
        ends = np.flatnonzero(np.append(np.diff(ranked) != 0, True))
        best = ends[f1[ends].argmax()]
        net.thresholds[lang] = float((ranked[best] + (ranked[best + 1] if best + 1 < len(ranked) else 0.0)) / 2)


def probabilities(net: Net, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -30, 30)))


def labelled_rows(docs: DataFrame, labels: DataFrame, learned: Column, rules: FitRules, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """``id, text, lang, label, back`` of every labelled row to learn from, once for each id and text; ``back`` rows are held back."""
    marks = inputs(labels, id=id_col, label=label_col).where("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    rows = inputs(docs.where(learned), id=id_col, text=text_col, lang=lang_col)
    rows = rows.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang")])
    known = rows.join(marks, "id").groupBy("id", "text").agg(F.max("lang").alias("lang"), F.max("label").alias("label"))
    back = F.pmod(F.xxhash64(F.lit("held back"), F.col("id"), F.lit(rules.seed)), F.lit(1000)) < int(1000 * rules.held_back)
    return known.withColumn("back", back)


#: Parts of the embedding table that travel apart; the last part has the other weights of the net.
PARTS = 64


def _dense(net: Net) -> np.ndarray:
    return np.concatenate([*[k.ravel() for k in net.kernels], *net.biases, net.out, [net.offset]]).astype(np.float32)


def _with_dense(net: Net, values: np.ndarray) -> None:
    at = 0
    for array in (*net.kernels, *net.biases, net.out):
        array[...] = values[at : at + array.size].reshape(array.shape)
        at += array.size
    net.offset = float(values[at])


def _changes(old: Net, new: Net) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``part, rows, change`` of every embedding row that changed, and the change of all other weights as one row."""
    changed = np.flatnonzero((old.table != new.table).any(1))
    part = changed * PARTS // len(old.table)
    for p in np.unique(part):
        rows = changed[part == p]
        yield int(p), rows, new.table[rows] - old.table[rows]
    yield PARTS, np.zeros(1, np.int64), (_dense(new) - _dense(old))[None]


CHANGED = "part int, rows binary, times binary, change binary"


def _record(part: int, rows: np.ndarray, times: np.ndarray, change: np.ndarray) -> dict:
    return {"part": part, "rows": rows.astype("<i4").tobytes(), "times": times.astype("<i8").tobytes(), "change": change.astype("<f4").tobytes()}


def _summed(changes: DataFrame, *keys: str) -> DataFrame:
    """The sum of the changes of each row and how many shards changed it, for each part and ``keys``."""

    def add(group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(r, "<i4") for r in group["rows"].to_pylist()]
        every, place = np.unique(np.concatenate(rows), return_inverse=True)
        ends = np.cumsum([0, *map(len, rows)])
        times, total = np.zeros(len(every), np.int64), None
        for i, (n, change) in enumerate(zip(group["times"].to_pylist(), group["change"].to_pylist())):
            own = place[ends[i] : ends[i + 1]]
            change = np.frombuffer(change, "<f4").reshape(len(own), -1)
            total = np.zeros((len(every), change.shape[1])) if total is None else total
            times[own] += np.frombuffer(n, "<i8")
            total[own] += change
        return pa.Table.from_pylist([_record(group["part"][0].as_py(), every, times, total)], schema=pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("rows", "times", "change")]]))

    return changes.groupBy("part", *keys).applyInArrow(add, CHANGED)


def _learned(texts: pa.Table, net: Net, rules: FitRules, weight: float, rounds: int | None, seed: int) -> Net:
    """A copy of the net, trained by the rows of a shard in an order that does not depend on how they came."""
    texts = texts.sort_by([("id", "ascending"), ("text", "ascending")])
    words, at, starts = numbered_words(texts["text"].cast(pa.large_string()).combine_chunks())
    new = Net(net.shape, net.table.copy(), [k.copy() for k in net.kernels], [b.copy() for b in net.biases], net.out.copy(), net.offset)
    if rounds is None:
        rounds = max(rules.epochs, -(-rules.batches * rules.batch // texts.num_rows))
    labels = texts["label"].to_numpy().astype(np.float64)
    train(new, word_features(words, net.shape.buckets), [at[b:e] for b, e in zip(starts[:-1], starts[1:])], labels, rules, rounds, seed, weight)
    return new


def _trained(rows: DataFrame, net: Net, rules: FitRules, weight: float, rounds: int | None) -> Net:
    """The net with the changes that training on the rows of each shard makes, averaged over the shards."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def work(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        new = _learned(group, sent.value, rules, weight, rounds, rules.seed + shard)
        made = [{"batch": shard // 64, **_record(part, at, np.ones(len(at)), change)} for part, at, change in _changes(sent.value, new)]
        return pa.Table.from_pylist(made, schema=pa.schema([("batch", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("rows", "times", "change")]]))

    changes = rows.groupBy("shard").applyInArrow(work, f"batch int, {CHANGED}")
    # Two steps, so that a task holds a part of the changes of 64 shards, then of sums.
    merged = _summed(_summed(changes, "batch"))
    new = Net(net.shape, net.table.copy(), [k.copy() for k in net.kernels], [b.copy() for b in net.biases], net.out.copy(), net.offset)
    # One row for each part, together as large as the net.
    for row in merged.collect():
        at, times = np.frombuffer(row.rows, "<i4"), np.frombuffer(row.times, "<i8")
        change = np.frombuffer(row.change, "<f4").reshape(len(at), -1) / times[:, None]
        if row.part == PARTS:
            _with_dense(new, _dense(net) + change[0])
        else:
            new.table[at] += change.astype(np.float32)
    return new


#: Steps of the output before calibration in which the held back rows are counted, and its limit.
BIN, LIMIT = 1 / 512, 64


def _judged(rows: DataFrame, net: Net, rules: FitRules) -> pd.DataFrame:
    """``lang, label, raw, n``: how many rows of each label and language have which output, in steps of BIN.

    Languages with too few rows for a threshold count together, under a null.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> dict:
        words, at, starts = numbered_words(batch["text"])
        raw = raw_scores(sent.value, word_features(words, sent.value.shape.buckets), at, starts)
        return {"lang": batch["lang"], "label": batch["label"], "bin": pa.array(np.round(np.clip(raw, -LIMIT, LIMIT) / BIN).astype(np.int32))}

    scored = written(arrow_pass(rows.select("text", "lang", "label"), run, "lang string, label int, bin int").groupBy("lang", "label", "bin").agg(F.count("*").alias("n")))
    sums = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) for k in (0, 1)]
    enough = scored.groupBy("lang").agg(F.least(*sums).alias("m")).where(F.col("m") >= rules.language_rows).select("lang", F.col("lang").alias("own"))
    counted = scored.join(enough, "lang", "left").groupBy(F.col("own").alias("lang"), "label", "bin").agg(F.sum("n").alias("n"))
    found = counted.toPandas().sort_values(["bin", "label"], kind="stable").reset_index(drop=True)
    return found.assign(raw=found["bin"] * BIN)


def fit(docs: DataFrame, labels: DataFrame, learned: Column, shape: NetShape = NetShape(), rules: FitRules = FitRules(), **columns: str) -> Net:
    """A calibrated net from all labelled rows of ``docs`` where ``learned`` holds."""
    known = written(labelled_rows(docs, labels, learned, rules, **columns))
    counts = known.groupBy("label", "back").agg(F.count("*").alias("n"), F.sum(F.length("text") + 1).alias("chars")).collect()
    totals = {k: sum(r.n for r in counts if r.label == k) for k in (0, 1)}
    net = new_net(shape, rules.seed)
    if not totals[0] or not totals[1]:
        net.base_rate = totals[1] / max(sum(totals.values()), 1)
        return net
    # Without both labels on both sides, all rows are learned from and judged.
    parted = len({(r.label, r.back) for r in counts}) == 4
    taught = known.where("NOT back") if parted else known
    used = [r for r in counts if not (parted and r.back)]
    share = sum(r.n for r in used if r.label == 1) / sum(r.n for r in used)
    # Where label 1 is rare, its rows weigh half as much as all others together; calibration takes that out of the scores again.
    weight = max((1 - share) / share / 2, 1.0)
    net.offset = float(np.log(share * weight / (1 - share)))
    shards = max(1, -(-sum(r.chars for r in used) // rules.shard_chars))
    taught = taught.select(F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int").alias("shard"), "id", "text", "label")
    net = _trained(taught.where("shard = 0"), net, rules, weight, None)
    if shards > 1:
        net = _trained(spread(taught.where("shard > 0"), "shard"), net, rules, weight, 1)
    judged = _judged(known.where("back") if parted else known, net, rules)
    calibrate(net, judged["raw"].to_numpy(np.float64), judged["label"].to_numpy(np.float64), judged["n"].to_numpy(np.float64), judged["lang"].tolist(), rules)
    return net


def score_documents(docs: DataFrame, net: Net, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, ``score``, ``predicted`` (score >= threshold), the language's own ``lang_threshold`` and ``flagged``."""
    rows = inputs(docs, doc_id=id_col, body=text_col, lang=lang_col)
    rows = rows.withColumns({"body": F.col("body").cast("string"), "lang": F.col("lang").cast("string")})
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> dict:
        model = sent.value
        if model.base_rate is not None:
            score = np.full(batch.num_rows, model.base_rate)
        else:
            words, at, starts = numbered_words(batch["body"])
            score = probabilities(model, raw_scores(model, word_features(words, model.shape.buckets), at, starts).astype(np.float64))
        limit = np.array([model.thresholds.get(x or "", threshold) for x in batch["lang"].to_pylist()], np.float64)
        return {"doc_id": batch["doc_id"], "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32)), "lang_threshold": pa.array(limit), "flagged": pa.array(score >= limit)}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_pass(rows, run, f"doc_id {kind}, score double, predicted int, lang_threshold double, flagged boolean")

"""Alignment of two tokenizers by the byte offsets at which their tokens end.

Both id lists of a text get cumulative ends; a dictionary maps the end of each token to its index, and the ends that both
dictionaries know, sorted, slice the two lists into groups. Within a slice the tokens that end together are linked. How often an
id pair is linked in the whole corpus tells which alignments are usual.

A long text is cut into parts before single spaces between other characters, where neither tokenizer has a token across (checked
for the vocabularies when they are loaded; the byte-level pattern starts a piece there). A part without such a place may
have any length; its ends are compared in windows of WINDOW bytes.

Corpus counts need no shuffle of links: of two tokens that end together the shorter one is the end of the longer one, so there
are at most ``pair_bound`` different pairs whatever the corpus (1.2 million for the given vocabularies). Tasks add up their
own counts, Spark sums them, and the table of counts is broadcast.

Texts that are null, empty, or whose tokens do not give back the bytes of a space and the text have no tokens: zeros and an
empty digest. Repeated rows give repeated results and count each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs, written

#: Least characters of a part of a text (it ends at the next place to cut), and bytes that are aligned at once.
PART = 1 << 16
WINDOW = 1 << 18
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """Byte-level entries write a byte as a printable character: itself if printable, else the next one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """Byte-level BPE from a tokenizers JSON file; the ids of its entries are the ranks of their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in entry): n for entry, n in spec["model"]["vocab"].items() if entry not in special}
        # Special tokens are left out of the encoder, so that their strings in a text are plain text.
        self.encoder = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, n in ranks.items():
            self.tokens[n] = token

    def encode(self, text: str) -> Sequence[int]:
        """Ids of a space and ``text``."""
        return self.encoder.encode_to_numpy(" " + text, disallowed_special=())


class Pieces:
    """A SentencePiece model, which adds the space itself."""

    def __init__(self, path: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        crossing = [n for n in names if "▁" in n.lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces across a space, so texts cannot be cut there: {crossing[:3]}")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.tokens = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]

    def encode(self, text: str) -> Sequence[int]:
        return self.encoder.encode(text, num_threads=1)


def common_ends(ends_a: Sequence[int], ends_b: Sequence[int], window: int = WINDOW) -> Iterator[tuple[list[int], list[int]]]:
    """Per window of bytes the indices of the tokens of either side that end together, in order."""
    total = max(ends_a[-1] if len(ends_a) else 0, ends_b[-1] if len(ends_b) else 0)
    ia = ib = 0
    for edge in range(window, total + window, window):
        ja = len(ends_a) if edge >= total else bisect_right(ends_a, edge)
        jb = len(ends_b) if edge >= total else bisect_right(ends_b, edge)
        index_a = dict(zip(ends_a[ia:ja], range(ia, ja)))
        index_b = dict(zip(ends_b[ib:jb], range(ib, jb)))
        shared = sorted(index_a.keys() & index_b.keys())
        yield [index_a[e] for e in shared], [index_b[e] for e in shared]
        ia, ib = ja, jb


class Aligner:
    """Encodes and aligns texts; ``base`` is the number of ids of the second tokenizer, pairs are ``a * base + b``."""

    def __init__(self, path_a: str, path_b: str, part: int = PART, window: int = WINDOW):
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.base = len(self.sides[1].tokens)
        self.sizes = [np.array([len(t) for t in side.tokens]) for side in self.sides]
        self.tokens = [np.array(side.tokens, dtype=object) for side in self.sides]
        # Ids as text, followed by what comes after them: a comma inside a group; a bar or a semicolon at its end.
        self.names = np.array([f"{i}{mark}" for side, end in zip(self.sides, "|;") for mark in (",", end) for i in range(len(side.tokens))], dtype=object)
        self.part, self.window = part, window

    def pair_bound(self) -> int:
        """Most pairs that can end together: each token with each of its own ends among the tokens of the other side."""
        per_end = max(max(np.unique([hash(t) for t in side.tokens], return_counts=True)[1]) for side in self.sides)
        return int(per_end) * int(sum(size.sum() for size in self.sizes))

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            cut = CUT.search(text, start + self.part)
            yield text[start : cut.start() if cut else len(text)]
            start = cut.end() if cut else len(text)

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Text of groups that end at the given indices: ids of the first side, a bar, ids of the second, a semicolon."""
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
        group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
        named_a, named_b = ids_a.astype(np.int64), ids_b + 2 * len(self.sides[0].tokens)
        named_a[last_a] += len(self.sides[0].tokens)
        named_b[last_b] += self.base
        out[np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]] = named_a
        out[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = named_b
        return "".join(self.names[out].tolist())

    def _align(self, part: str) -> Iterator[tuple[int, int, str, np.ndarray] | None]:
        """Per window: tokens of both sides, text of the groups and the linked pairs; None if the bytes differ."""
        ids = [np.array(side.encode(part), np.int64) for side in self.sides]
        plain = b" " + part.encode()
        if any(b"".join(tokens[own].tolist()) != plain for tokens, own in zip(self.tokens, ids)):
            yield None
            return
        ends = [np.cumsum(size[own]).tolist() for size, own in zip(self.sizes, ids)]
        fa = fb = 0
        for last_a, last_b in common_ends(*ends, self.window):
            if last_a:
                at_a, at_b = np.array(last_a), np.array(last_b)
                ta, tb = last_a[-1] + 1, last_b[-1] + 1
                # No token is empty, so of a slice the last tokens of both sides are the ones that end together.
                pairs = ids[0][at_a] * self.base + ids[1][at_b]
                yield ta - fa, tb - fb, self._groups(ids[0][fa:ta], ids[1][fb:tb], at_a - fa, at_b - fb), pairs
                fa, fb = ta, tb

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of both sides, groups, links, digest of the groups, the different linked pairs and how often each is linked."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        n_a = n_b = 0
        digest, held = hashlib.sha256(), ""
        pairs, times = none[5:]
        for part in self._parts(text or ""):
            for found in self._align(part):
                if found is None:
                    return none
                digest.update(held.encode())
                n_a, n_b, held = n_a + found[0], n_b + found[1], found[2]
                pairs, at = np.unique(np.concatenate([pairs, found[3]]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, np.ones(len(found[3]), np.int64)]), len(pairs)).astype(np.int64)
        if not len(pairs):
            return none
        # The last semicolon ends nothing.
        digest.update(held[:-1].encode())
        links = int(times.sum())
        return n_a, n_b, links, links, digest.hexdigest(), pairs, times


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker."""
    return Aligner(path_a, path_b)


KINDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts and digest of its alignment, its distinct pairs (int64) and how often each occurs (int32), as bytes."""
    rows = inputs(docs, doc_id=id_col, body=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        aligner = _aligner(path_a, path_b)
        made = []
        for text in batch["body"]:
            *counts, pairs, times = aligner.align(text.as_py())
            made.append((*counts, pairs.tobytes(), times.astype(np.int32).tobytes()))
        values = list(zip(*made)) or [()] * len(KINDS)
        return {"doc_id": batch["doc_id"], **{n: pa.array(v, k) for (n, k), v in zip(KINDS.items(), values)}}

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    return arrow_pass(rows.withColumn("body", F.col("body").cast("string")), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: links of each id pair in the whole corpus. A task sends each pair once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = np.frombuffer(b"".join(batch["pairs"].to_pylist()), np.int64)
            count = np.frombuffer(b"".join(batch["times"].to_pylist()), np.int32)
            pairs, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, count]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs), "n": pa.array(times)})

    tasks = aligned.select("pairs", "times").mapInArrow(add, "pair bigint, n bigint")
    return tasks.groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, base: int) -> DataFrame:
    """``pair, n, best``: whether no other pair with the same second id is linked more often."""
    target = F.col("pair") % base
    most = counts.groupBy(target.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", target).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and the table of id pairs ``a, b, n, best``."""
    aligner = _aligner(path_a, path_b)
    base = aligner.base
    aligned = written(aligned_documents(docs, path_a, path_b, id_col, text_col))
    table = written(best_pairs(written(pair_counts(aligned)), base))
    size = table.count()
    if size > aligner.pair_bound():
        raise ValueError(f"{size} pairs, more than {aligner.pair_bound()} can end together")
    known = table.toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def weigh(batch: pa.RecordBatch) -> dict:
        pair, n, best = sent.value
        made = []
        for pairs, times in zip(batch["pairs"].to_pylist(), batch["times"].to_pylist()):
            at = np.searchsorted(pair, np.frombuffer(pairs, np.int64))
            count = np.frombuffer(times, np.int32).astype(np.int64)
            made.append((int(count[best[at]].sum()), int((count * n[at]).sum())))
        n_best, count_sum = zip(*made) if made else ((), ())
        same = {c: batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return {**same, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": batch["groups_sha256"]}

    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rows = arrow_pass(aligned, weigh, schema)
    pairs = table.select(F.expr(f"pair div {base}").alias("a"), (F.col("pair") % base).alias("b"), "n", "best")
    return rows, pairs

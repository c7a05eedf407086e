"""Language-model scores from an Elias-Fano n-gram trie that is learned from the corpus itself.

The models are of orders 2 and 3, each with a Dirichlet prior (``strength``) around the order below, over add-one unigrams:
p(w | u) = c(uw) / (c(u) + s) + s / (c(u) + s) * p(w), p(w) = (c(w) + 1) / (N + V + 1), and
p(w | uv) = c(uvw) / (c(uv) + s) + s / (c(uv) + s) * p(w | v). The first part for bigrams and the counts of trigrams are
what the trie stores, quantised down to eight bits; unigram counts stay exact. c(uv) is taken from its bigram's step,
rounded up (exact to 11), so that no context gives away more than 1. ``score`` is of order 2, ``trigram_score`` of order 3.

The trie grows with the corpus, so no machine holds it: it is cut into shards by context, and texts are
scored by asking them. Documents are read in blocks of bounded size. A block asks for each distinct word,
bigram and trigram once; the request carries the block's training counts, so the same rows build the shards and
query them. A shard sums the counts, builds its trie in a memory map, looks up all its requests by
successor search in rising order and answers one byte for each bigram and trigram. Answers go back to the
block, where positions are scored. Contexts that are frequent enough to fill a good part of a shard
(2 times the number of shards of them at most) are spread over all shards by their words, and so are trigrams that begin with one.

Words are known by 64-bit hashes (in a context: 40 bits of it), so two of 10 million words share one
with a chance of 3 in a million. A trigram is known in its shard by 23 bits of its context and 23 of its last word, so one of
1.5 million others is taken for it with a chance of 2 in 100 million. Defined results: a null text is empty and has one token, the end; with no
training row all counts are 0; repeated rows are scored, and counted, each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from latticeqc.llm.common import column, small_batches, written
from latticeqc.llm.elias_fano import CHILD_BITS, COUNT, PROBABILITY, NgramTrie, quantised, quantised_count
from latticeqc.llm.words import MULTIPLIER, hash_distinct, mixed, split_words

END = np.uint64(0xE5D0F7E27)
#: A trigram is its shard, then HALF bits of its context, then HALF bits of its last word.
HALF = np.uint64(23)
WHOLE = np.uint64(46)
MOST_SHARDS = (1 << 18) - 1


@dataclass(frozen=True)
class LanguageModel:
    """``block_bytes`` of text are scored at once; a shard is meant for ``shard_tokens`` tokens of the corpus."""

    strength: float = 2.0
    block_bytes: int = 16 << 20
    shard_tokens: int = 1_500_000


def _blocks(docs: DataFrame, model: LanguageModel, kind: str) -> DataFrame:
    """One row per block: ids, training flags, words as numbers of the block's sorted vocabulary, training counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            flat, ends = split_words(pc.ascii_lower(rows["body"]))
            distinct, places = hash_distinct(flat)
            vocabulary, numbers = np.unique(np.concatenate([distinct, [END]]), return_inverse=True)
            codes = np.concatenate([numbers[places], numbers[-1:]])
            lengths = np.diff(ends)
            train = np.asarray(rows["train"])
            weight = np.repeat(train, lengths)
            count = np.bincount(codes[:-1], weights=weight, minlength=len(vocabulary)).astype(np.int64)
            count[codes[-1]] += int(train.sum())
            return pa.RecordBatch.from_pydict(
                {
                    "block": [f"{TaskContext.get().partitionId()}-{number}"],
                    "ids": pa.array([rows["doc"].to_pylist()], pa.list_(rows["doc"].type)),
                    "train": pa.array([train.tolist()], pa.list_(pa.bool_())),
                    "lengths": [lengths.astype("<u4").tobytes()],
                    "codes": [_planes(codes[:-1], 4)],
                    "vocabulary": [vocabulary.tobytes()],
                    "counts": [_planes(count, 4)],
                    "tokens": pa.array([len(flat) + len(lengths)], pa.int64()),
                    "train_tokens": pa.array([int(count.sum())], pa.int64()),
                }
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                held.append(batch)
                size += pc.sum(pc.binary_length(batch["body"])).as_py() or 0
                if size >= model.block_bytes:
                    yield made()
                    number, held, size = number + 1, [], 0
                    pa.default_memory_pool().release_unused()
        if held and sum(b.num_rows for b in held):
            yield made()

    schema = f"block string, ids array<{kind}>, train array<boolean>, lengths binary, codes binary, vocabulary binary, counts binary, tokens bigint, train_tokens bigint"
    return docs.mapInArrow(read, schema)


class Block:
    """The distinct words, bigrams and trigrams of a block, each dealt to its shard, in an order that asking and scoring share."""

    def __init__(self, row: dict, shards: int, hot: np.ndarray):
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.counts = _unplaned(row["counts"], 4)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.end = int(np.searchsorted(self.vocabulary, END))
        closed = self.lengths + 1
        stops = np.cumsum(closed)
        self.starts = stops - closed
        self.tokens = np.full(int(closed.sum()), self.end, np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[stops - 1] = False
        self.tokens[inner] = _unplaned(row["codes"], 4)
        del inner
        self.follows = np.ones(len(self.tokens), bool)
        self.follows[self.starts] = False
        after = self.tokens[self.follows]
        train = np.repeat(np.asarray(row["train"], bool), closed)[self.follows]
        #: Of the tokens that follow one, those that follow two.
        self.deep = np.concatenate([[False], self.follows[:-1]])[self.follows]
        wide = len(self.vocabulary)
        pairs, self.which, self.pair_counts = _distinct(self.tokens[:-1][self.follows[1:]].astype(np.int64) * wide + after, train)
        self.context, self.word = (pairs // wide).astype(np.int32), (pairs % wide).astype(np.int32)
        del pairs
        spread = np.isin(self.vocabulary, hot)
        of = (self.vocabulary % np.uint64(shards)).astype(np.int32)
        bigram = mixed(self.vocabulary[self.context] * MULTIPLIER + self.vocabulary[self.word])
        pair_of = np.where(spread[self.context], (bigram % np.uint64(shards)).astype(np.int32), of[self.context])
        # Most pairs go where their context's counts go, which is then named once; the others of a shard come last.
        other = pair_of != of[self.context]
        self.runs = np.bincount(self.context[~other], minlength=wide)
        self.word_order, self.pair_order = np.argsort(of, kind="stable"), np.argsort(2 * pair_of + other, kind="stable").astype(np.int32)
        self.word_cuts = np.searchsorted(of[self.word_order], np.arange(shards + 1))
        self.pair_cuts = np.searchsorted((2 * pair_of + other)[self.pair_order], np.arange(2 * shards + 1))
        del pair_of, other
        at = np.flatnonzero(self.deep)
        named = np.empty(len(at), np.uint64)
        for first in range(0, len(at), 1 << 18):
            part = at[first : first + (1 << 18)]
            before, last = self.which[part - 1], self.vocabulary[after[part]]
            context = bigram[before]
            shard = np.where(spread[self.context[before]], mixed(context * MULTIPLIER + last), context) % np.uint64(shards)
            named[first : first + (1 << 18)] = (shard << WHOLE) | (context >> (np.uint64(64) - HALF) << HALF) | (last >> (np.uint64(64) - HALF))
        del at, after, bigram
        triples, self.which_triple, self.triple_counts = _distinct(named, train[self.deep])
        self.triple_cuts = np.searchsorted(triples >> WHOLE, np.arange(shards + 1, dtype=np.uint64))
        self.triples = triples & ((np.uint64(1) << WHOLE) - np.uint64(1))

    def requests(self, name: str, shards: int) -> Iterator[dict]:
        for shard in range(shards):
            words = self.word_order[self.word_cuts[shard] : self.word_cuts[shard + 1]]
            pairs = self.pair_order[self.pair_cuts[2 * shard] : self.pair_cuts[2 * shard + 2]]
            others = self.pair_order[self.pair_cuts[2 * shard + 1] : self.pair_cuts[2 * shard + 2]]
            triples = slice(self.triple_cuts[shard], self.triple_cuts[shard + 1])
            if len(words) or len(pairs) or triples.start < triples.stop:
                context, run = np.unique(self.context[others], return_counts=True)
                child = self.vocabulary[self.word[pairs]] >> np.uint64(64 - CHILD_BITS)
                yield {
                    "shard": shard, "block": name, "words": self.vocabulary[words].tobytes(), "counts": _planes(self.counts[words], 4),
                    "contexts": self.vocabulary[context].tobytes(), "runs": _planes(np.concatenate([self.runs[words], run]), 4),
                    "children": _planes(child, CHILD_BITS // 8), "pair_counts": _planes(self.pair_counts[pairs], 4),
                    "triples": _planes(self.triples[triples], 6), "triple_counts": _planes(self.triple_counts[triples], 4),
                }


def _distinct(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in rising order, the number of each value among them, and how many training places hold each."""
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    values = values[fresh]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    del order, fresh
    return values, which, np.bincount(which[train], minlength=len(values)).astype("<u4")


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, byte by byte: the upper ones hardly change and are compressed away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<i8").reshape(-1)


REQUEST = "shard int, block string, words binary, counts binary, contexts binary, runs binary, children binary, pair_counts binary, triples binary, triple_counts binary"


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _numbers(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[_unplaned(x, width) for x in table[name].to_pylist()]])


def _contexts(group: pa.Table) -> np.ndarray:
    """The context of each pair that is asked for: a row's words and further contexts, each as often as its run is long."""
    rows = zip(*[group[name].to_pylist() for name in ("words", "contexts", "runs")])
    return np.concatenate([np.zeros(0, np.uint64), *[np.repeat(np.frombuffer(w + c, np.uint64), _unplaned(r, 4)) for w, c, r in rows]])


def _answers(strength: float, hot: np.ndarray, hot_counts: np.ndarray):
    def answer(group: pa.Table) -> pa.Table:
        words, place = np.unique(_joined(group, "words", np.uint64), return_inverse=True)
        known = np.bincount(place, weights=_numbers(group, "counts", 4), minlength=len(words)).astype(np.int64)
        contexts, child = _contexts(group), _numbers(group, "children", CHILD_BITS // 8).astype(np.uint64)
        sums = _numbers(group, "pair_counts", 4)
        order = np.lexsort((child, contexts))
        sorted_context, sorted_child = contexts[order], child[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (sorted_context[1:] != sorted_context[:-1]) | (sorted_child[1:] != sorted_child[:-1])
        number = np.cumsum(fresh) - 1
        asked_context, asked_child = sorted_context[fresh], sorted_child[fresh]
        count = np.bincount(number, weights=sums[order], minlength=len(asked_context)).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        seen = count > 0
        learned = asked_context[seen]
        total = np.zeros(len(learned), np.int64)
        for names, values in ((words, known), (hot, hot_counts)):
            if len(names):
                found = np.minimum(np.searchsorted(names, learned), len(names) - 1)
                total = np.where(names[found] == learned, values[found], total)
        # All tokens of a context are followed by one more, so its count is the sum over its children.
        trie = NgramTrie.build(learned, asked_child[seen], quantised(count[seen] / (np.maximum(total, count[seen]) + strength)))
        codes = np.zeros(len(order), np.uint8)
        codes[order] = trie.lookup(asked_context, asked_child)[number] if len(order) else 0
        counted, place_triple = np.unique(_numbers(group, "triples", 6).astype(np.uint64), return_inverse=True)
        times = np.bincount(place_triple, weights=_numbers(group, "triple_counts", 4), minlength=len(counted)).astype(np.int64)
        above, last = counted >> HALF, counted & ((np.uint64(1) << HALF) - np.uint64(1))
        seen = times > 0
        deep = NgramTrie.build(above[seen], last[seen], quantised_count(times[seen])).lookup(above, last)[place_triple]
        triple_ends = np.cumsum([len(t) // 6 for t in group["triples"].to_pylist()])
        word_ends = np.cumsum([len(w) // 8 for w in group["words"].to_pylist()])
        pair_ends = np.cumsum([len(c) // (CHILD_BITS // 8) for c in group["children"].to_pylist()])
        answered = known[place]
        return pa.table(
            {
                "shard": group["shard"], "block": group["block"],
                "counts": pa.array([_planes(x, 8) for x in np.split(answered, word_ends[:-1])], pa.binary()),
                "codes": pa.array([x.tobytes() for x in np.split(codes, pair_ends[:-1])], pa.binary()),
                "deep": pa.array([x.tobytes() for x in np.split(deep, triple_ends[:-1])], pa.binary()),
                "distinct": pa.array([int((known > 0).sum())] + [0] * (group.num_rows - 1), pa.int64()),
            }
        )

    return answer


def score_documents(docs: DataFrame, train: Column, model: LanguageModel = LanguageModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, trigram_score`` for every row.

    ``train`` is a condition over ``docs``: true for the rows to learn from (null counts as false).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(id_col).alias("doc"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("body"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["doc"].dataType.simpleString()
    blocks = written(_blocks(rows, model, kind))
    total, learned = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    shards = min(max(1, -(-total // model.shard_tokens)), MOST_SHARDS)
    hot, hot_counts = _hot_contexts(blocks, learned, shards)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = Block(row, shards, hot).requests(row["block"], shards)
                while some := list(islice(asked, 16)):
                    yield pa.RecordBatch.from_pylist(some, schema=wanted)
                pa.default_memory_pool().release_unused()

    binary = [(n, pa.binary()) for n in ("words", "counts", "contexts", "runs", "children", "pair_counts", "triples", "triple_counts")]
    wanted = pa.schema([("shard", pa.int32()), ("block", pa.string()), *binary])
    requests = blocks.select("block", "train", "lengths", "codes", "vocabulary", "counts").mapInArrow(ask, REQUEST)
    answers = written(
        requests.groupBy("shard").applyInArrow(_answers(model.strength, hot, hot_counts), "shard int, block string, counts binary, codes binary, deep binary, distinct bigint")
    )
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("shard")
        for row in left.to_pylist():
            block = Block(row, shards, hot)
            counts = np.zeros(len(block.vocabulary), np.int64)
            counts[block.word_order] = _numbers(right, "counts", 8)
            codes = np.zeros(len(block.context), np.uint8)
            codes[block.pair_order] = _joined(right, "codes", np.uint8)
            unigram = (counts + 1) / (learned + distinct + 1)
            p = unigram[block.tokens]
            base = np.add.reduceat(np.log10(p), block.starts)
            total = counts[block.context]
            rest = model.strength / (total + model.strength)
            below = p[block.follows]
            below *= rest[block.which]
            below += PROBABILITY[codes][block.which]
            p[block.follows] = below
            plain = np.add.reduceat(np.log10(p), block.starts)
            # The trigrams of a context hang below its bigram; the bigram's step bounds their sum from above.
            most = np.where(codes > 0, np.floor(PROBABILITY[np.minimum(codes, 254).astype(int) + 1] * (total + model.strength)), 0.0)
            before = most[block.which[np.flatnonzero(block.deep) - 1]]
            times = COUNT[_joined(right, "deep", np.uint8)[block.which_triple]]
            times[before == 0] = 0
            times += model.strength * below[block.deep]
            before += model.strength
            third = block.follows.copy()
            third[block.follows] = block.deep
            p[third] = times / before
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["ids"], kinds), "held_out": pa.array([not t for t in row["train"]], pa.bool_()), "n_tokens": pa.array(block.lengths + 1),
                        "n_known": pa.array(np.add.reduceat((counts[block.tokens] > 0).astype(np.int64), block.starts)),
                        "train_tokens": pa.array([learned] * len(block.starts), pa.int64()),
                        "base_score": pa.array(base),
                        "score": pa.array(plain),
                        "trigram_score": pa.array(np.add.reduceat(np.log10(p), block.starts)),
                    }
                )
            )
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    kinds = to_arrow_type(rows.schema["doc"].dataType)
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, trigram_score double"
    texts = blocks.select("block", "ids", "train", "lengths", "codes", "vocabulary", "counts")
    return texts.groupBy("block").cogroup(answers.select("block", "shard", "counts", "codes", "deep").groupBy("block")).applyInArrow(score, schema)


def _hot_contexts(blocks: DataFrame, learned: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with at least one in 2 * shards of the training tokens, and their counts: at most 2 * shards of them."""
    share = 1 / (2 * shards)

    def emit(pick):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words, counts = np.frombuffer(row["vocabulary"], np.uint64), _unplaned(row["counts"], 4)
                    use = pick(words, counts)
                    yield pa.RecordBatch.from_pydict({"word": pa.array(words[use].view(np.int64)), "n": pa.array(counts[use])})

        return blocks.select("vocabulary", "counts").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    often = emit(lambda words, counts: counts >= max(share * counts.sum(), 1)).where(F.col("n") >= share * learned)
    hot = np.sort(np.array([r.word for r in often.select("word").collect()], np.int64).view(np.uint64))
    exact = {r.word: r.n for r in emit(lambda words, counts: np.isin(words, hot)).collect()} if len(hot) else {}
    return hot, np.array([exact[int(w)] for w in hot.view(np.int64)], np.int64)

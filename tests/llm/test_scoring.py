"""The trie against sorted arrays, and scores against a direct count of words and bigrams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeqc.llm.elias_fano import COUNT, STEP, EliasFano, NgramTrie, quantised, quantised_count, PROBABILITY
from latticeqc.llm.ngram_scoring import LanguageModel, score_documents
from latticeqc.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=700), st.lists(st.integers(0, 2**63), max_size=50))
def test_elias_fano(values, queries):
    values = np.sort(np.array(values, np.uint64))
    coded = EliasFano.build(values)
    assert np.array_equal(coded.decode(0, len(values)), values)
    assert np.array_equal(coded.decode(STEP, STEP + 9), values[STEP : STEP + 9])
    queries = np.sort(np.array(queries + values[:20].tolist(), np.uint64))
    index, equal = coded.successor(queries)
    assert np.array_equal(index, np.searchsorted(values, queries)) and np.array_equal(equal, np.isin(queries, values))


def test_trie_lookup_and_runs():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 400, (5000, 2)), axis=0).astype(np.uint64)
    codes = quantised(rng.random(len(pairs)))
    trie = NgramTrie.build(pairs[:, 0] << np.uint64(50), pairs[:, 1], codes)
    asked = np.array([(a, b) for a in range(0, 402, 3) for b in range(0, 402, 2)], np.uint64)
    known = {tuple(p): c for p, c in zip(pairs.tolist(), codes)}
    got = trie.lookup(asked[:, 0] << np.uint64(50), asked[:, 1])
    assert got.tolist() == [known.get(tuple(q), 0) for q in asked.tolist()]
    contexts, first = np.unique(pairs[:, 0], return_index=True)
    starts, stops = trie.runs(np.arange(len(contexts)))
    assert starts.tolist() == first.tolist() and stops.tolist() == [*first[1:].tolist(), len(pairs)]
    assert trie.bytes < 8 * 2 * len(pairs)


def test_lookup_reads_the_pointers():
    pairs = np.array([(a, b) for a in range(4) for b in range(300)], np.uint64)
    trie = NgramTrie.build(pairs[:, 0], pairs[:, 1], np.full(len(pairs), 7, np.uint8))
    trie.pointers = EliasFano.build(np.array([0, 300, 300, 900, 1200]))
    assert (trie.lookup(pairs[:, 0], pairs[:, 1]).reshape(4, 300) > 0).all(axis=1).tolist() == [True, False, True, True]
    nothing = np.zeros(0, np.uint64)
    assert NgramTrie.build(nothing, nothing, np.zeros(0, np.uint8)).lookup(pairs[:, 0], pairs[:, 1]).sum() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=50))
def test_a_context_gives_away_no_more_than_its_mass(counts):
    total = sum(counts) + 2.0
    assert PROBABILITY[quantised(np.array(counts) / total)].sum() + 2.0 / total <= 1 + 1e-12
    given_away = PROBABILITY[quantised(PROBABILITY[1:])]
    assert np.array_equal(given_away, PROBABILITY[1:]) and quantised(np.array([1e-10]))[0] == 0


def brute(rows, strength=2.0):
    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]

    learned = [tokens(t) for _, t, train in rows if train]
    one = Counter(w for t in learned for w in t)
    two = Counter(p for t in learned for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    out = []
    for key, text, train in rows:
        words = tokens(text)
        base = [(one[w] + 1) / (n + v + 1) for w in words]
        p = [base[0]]
        for a, b, q in zip(words, words[1:], base[1:]):
            seen = two[a, b] / (one[a] + strength) if two[a, b] else 0
            p.append((PROBABILITY[quantised(np.array([seen]))[0]] if seen else 0) + strength / (one[a] + strength) * q)
        out.append((key, not train, len(words), sum(one[w] > 0 for w in words), n, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)


@pytest.mark.parametrize("model", [LanguageModel(), LanguageModel(block_bytes=300, shard_tokens=40)], ids=["one", "many"])
def test_scores_of_odd_texts(spark, model):
    texts = [None, "", " \t", "The the THE cat", "Äpfel äpfel the cat sat", "x" * 30_000, "the the " * 900, "a\x0bb\x0cc", "the cat sat on the mat"] * 2
    rows = [(k, t, k % 3 != 1) for k, t in enumerate(texts)] + [(0, texts[3], True)]
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, flag boolean, block string").repartition(4)
    got = sorted(map(tuple, score_documents(docs, F.col("flag"), model).collect()), key=str)
    close(sorted(got, key=lambda r: (r[0], r[5])), sorted(brute(rows), key=lambda r: (r[0], r[5])))


def test_empty_table_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score_documents(docs.where("false"), F.lit(True)).count() == 0
    row = score_documents(docs, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_query_on_documents(spark):
    got = sorted(map(tuple, QUERIES["op1_ngram_trie_scoring"](spark, "/root/testdata/sf0.01").collect()))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    close(got, sorted(brute([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs])))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def trigram_scores(rows, strength=2.0):
    """(key, score under the third level) of every row, by counting; exact where the steps of the trie are."""

    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]

    learned = [tokens(t) for _, t, train in rows if train]
    one = Counter(w for t in learned for w in t)
    two = Counter(p for t in learned for p in zip(t, t[1:]))
    three = Counter(p for t in learned for p in zip(t, t[1:], t[2:]))
    out = []
    for key, text, _ in rows:
        words, total = tokens(text), 0.0
        for k, w in enumerate(words):
            p = (one[w] + 1) / (sum(one.values()) + len(one) + 1)
            if k:
                above = one[words[k - 1]] + strength
                code = quantised(np.array([two[words[k - 1], w] / above]))[0]
                p = PROBABILITY[code] + strength / above * p
            if k > 1:
                u, v = words[k - 2 : k]
                code = int(quantised(np.array([two[u, v] / (one[u] + strength)]))[0])
                most = math.floor(PROBABILITY[code + 1] * (one[u] + strength)) if code else 0
                assert most >= two[u, v] and (most == two[u, v] or two[u, v] > 11)
                p = (COUNT[quantised_count(np.array([three[u, v, w]]))[0]] + strength * p) / (most + strength)
            total += math.log10(p)
        out.append((key, total))
    return sorted(out)


@pytest.mark.parametrize("model", [LanguageModel(), LanguageModel(block_bytes=300, shard_tokens=40)], ids=["one", "many"])
def test_third_level_counts_trigrams(spark, model):
    texts = [None, "", "a", "a b", "a b c", "a b d", "x b c", "A b c a b c a b", "the the " * 300, "the the the cat sat on the mat", "b c e"] * 2
    rows = [(k, t, k % 3 != 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, flag boolean").repartition(4)
    got = sorted((r.doc_id, r.trigram_score) for r in score_documents(docs, F.col("flag"), model).collect())
    want = trigram_scores(rows)
    assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-8)


def test_word_two_places_back_matters(spark):
    texts = ["a b c", "x b d"] * 20 + ["a b d", "x b d"]
    docs = spark.createDataFrame([(k, t, k < 40) for k, t in enumerate(texts)], "doc_id long, text string, flag boolean")
    rows = {r.doc_id: r for r in score_documents(docs, F.col("flag")).collect()}
    # Two levels see "b d" as often below both first words; the third knows that only "x b" goes on with "d".
    assert rows[40].score == pytest.approx(rows[41].score)
    assert rows[40].trigram_score < rows[40].score < rows[41].score + 1e-9 < rows[41].trigram_score


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=50), st.integers(0, 10**6))
def test_a_bigram_gives_away_no_more_than_its_mass(counts, others):
    total = sum(counts) + others + 2.0
    code = int(quantised(np.array([sum(counts) / total]))[0])
    assert code and math.floor(PROBABILITY[code + 1] * total) >= COUNT[quantised_count(np.array(counts))].sum()
    assert len(set(COUNT)) == 256 and np.array_equal(quantised_count(np.arange(65)), np.arange(65))

"""The convolutional classifier: held-out accuracy, spans against whole texts, gradients, and corner cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeqc.llm import toxicity as T
from latticeqc.llm.queries import QUERIES

SMALL = T.NetShape(buckets=1 << 14, size=12, filters=12)
BAD = {"en": ["brute", "wretch"], "de": ["unfugx", "lumpenx"]}


def corpus(n, seed=3):
    """Texts with planted words in two languages; one text in five is toxic, by one word at any place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, toxic = rng.choice(["en", "de"]), rng.random() < 0.2
        words = [("the" if lang == "en" else "der") + str(rng.randint(0, 400)) for _ in range(rng.choice([5, 30, 200]))]
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(BAD[lang]) + rng.choice(["", ",", ".", "er"]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    return T.fit(docs, labels, F.col("doc_id") % 4 != 2, SMALL), rows, docs


def test_held_out_accuracy(spark, fitted):
    net, rows, docs = fitted
    truth = {r[0]: r[3] for r in rows}
    got = [r for r in T.score_documents(docs, net).collect() if r.doc_id % 4 == 2]
    caught = [r.predicted for r in got if truth[r.doc_id]]
    false = [r.predicted for r in got if not truth[r.doc_id]]
    assert np.mean(caught) > 0.9 and np.mean(false) < 0.03
    assert set(net.thresholds) == {"en", "de"} and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_corner_cases(spark, fitted):
    net, _, _ = fitted
    long = "der1 " * 200_000 + "brute"
    texts = [None, "", " \n ", long, "x" * 300_000, "der1", "der1"]
    frame = spark.createDataFrame([(i, t, None, "y", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, body string, score double")
    rows = {r.doc_id: r for r in T.score_documents(frame, net).collect()}
    assert len(rows) == len(texts) and rows[0].score == rows[1].score == rows[2].score
    assert rows[3].predicted == 1 and rows[5].predicted == 0 and rows[5].score == rows[6].score
    assert T.score_documents(frame.limit(0), net).collect() == []


def test_spans_change_nothing(fitted, monkeypatch):
    net, rows, _ = fitted
    words, at, starts = T.numbered_words(pa.array([r[1] for r in rows[:80]] + ["", "a"], pa.large_string()))
    features = T.word_features(words, SMALL.buckets)
    whole = T.raw_scores(net, features, at, starts)
    one = [T.raw_scores(net, features, at[b:e], np.array([0, e - b]))[0] for b, e in zip(starts[:-1], starts[1:])]
    monkeypatch.setattr(T, "SPAN", 7)
    assert np.allclose(whole, one, atol=1e-5) and np.allclose(whole, T.raw_scores(net, features, at, starts), atol=1e-5)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    for labels, score in ((none, 0.0), (one, 1.0)):
        net = T.fit(docs, labels, F.lit(True), SMALL)
        assert [r.score for r in T.score_documents(docs, net).collect()] == [score, score]


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op13_toxicity"](spark, folder)
    assert rows.select("doc_id", "held_out", "score", "predicted").dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = rows.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    caught = np.mean([r.predicted for r in held if truth[r.doc_id] == 1])
    false = np.mean([r.predicted for r in held if truth[r.doc_id] == 0])
    assert caught > 0.8 and false < 0.02, (caught, false)


def test_every_labelled_row_is_learned_from(spark, fitted, monkeypatch):
    _, rows, docs = fitted
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    learned = F.col("doc_id") % 4 != 2
    known = T.labelled_rows(docs, labels, learned, T.FitRules())
    assert known.count() == sum(r[0] % 4 != 2 for r in rows)
    # More than the 3,000 rows of label 0 that a fit once looked at, dealt to several shards that all change the net.
    many = spark.createDataFrame([(i, f"mild{i} word", "en", 0) for i in range(5000)] + [(i, f"brute{i} word", "en", 1) for i in range(5000, 7000)], "doc_id long, text string, lang string, toxic int")
    rules = T.FitRules(shard_chars=20_000, epochs=1, batches=1, held_back=0.1)
    assert T.labelled_rows(many, many, F.lit(True), rules).count() == 7000
    net = T.fit(many, many, F.lit(True), T.NetShape(buckets=1 << 16, size=4, filters=4), rules)
    start = T.new_net(net.shape, rules.seed)
    taught = [r.text.split()[0] for r in T.labelled_rows(many, many, F.lit(True), rules).where("NOT back").collect()]
    moved = (net.table != start.table).any(1)[T.word_features(taught, net.shape.buckets)[:, 0]]
    assert moved.mean() > 0.5
    got = T.score_documents(many, net).collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id >= 5000) for r in got]) > 0.95


def test_responses_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, kernel, bias = rng.normal(size=(40, 3)), rng.normal(size=(3, 3, 5)), rng.normal(size=5)
    vectors[-1] = 0
    line, begin = T.padded(rng.integers(0, 39, 100), np.array([0, 0, 60, 61, 100]), 39, 3)
    whole = T._tops(vectors, line, begin, kernel, bias, 3)
    monkeypatch.setattr(T, "SPAN", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, T._tops(vectors, line, begin, kernel, bias, 3)))

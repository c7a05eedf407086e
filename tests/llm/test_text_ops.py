"""Compression bands and SentencePiece against plain Python on whole texts and on corner cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard

from latticeqc.llm import compression, sentencepiece_table
from latticeqc.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a  b ", "a\nb\tc", "x" * 50_000, "one two " * 9_000, "▁x ▁", "<s> a </s>", "a\x00b", " x　 y",
    "café \U0001f600\U0001f600 你好", "a b c a b c\n\n a b c\na b c", " \n ", "word " * 60,
]


def frame(spark, texts):
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, body string, kept double")


def texts_of(spark, sf="/root/testdata/sf0.001"):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sentencepiece_equals_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = dict(enumerate(ODD))
    got = sentencepiece_table.encode_documents(frame(spark, ODD), MODEL, outputs=("ids", "n_tokens", "decoded", "ids_sha256"))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for k, t in texts.items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids) and rows[k].decoded == library.decode(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = {r.doc_id: r.text for r in sentencepiece_table.decode_documents(got, MODEL).collect()}
    assert back == {k: library.decode(rows[k].ids) for k in texts}


def test_sentencepiece_query_on_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = texts_of(spark)
    rows = QUERIES["op7_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_table_restarts_without_changing_results():
    table = sentencepiece_table.ChunkTable(open(MODEL, "rb").read(), limit=1)
    first = table.encode(["a b c", "d e"])
    table.encode(["f g h"])
    assert table.encode(["a b c", "d e"]) == first


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    dup = sum(lines[i] in lines[:i] for i in range(len(lines)))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_quality_counts(spark, source):
    texts = dict(enumerate(ODD)) if source == "odd" else texts_of(spark)
    docs = frame(spark, ODD) if source == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in compression.judge_documents(docs).collect()}
    assert len(rows) == len(texts)
    for k, t in texts.items():
        r, (n, chars, symbols, dup, repeat) = rows[k], brute_counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)


def test_bands_reject_repetitive_and_random_text(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary, 900))
    noise = " ".join("".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 60)) for _ in range(90))
    repeats = "".join(f"line {i % 7} of the same few lines {i % 3}\n" for i in range(400))
    rows = {r.doc_id: r for r in compression.judge_documents(frame(spark, [prose, noise, repeats])).collect()}
    assert rows[0].kept and rows[1].band == "incompressible" and rows[2].band == "repetitive"
    kept = compression.keep_documents(frame(spark, [prose, noise, repeats, None]))
    assert kept.columns == ["doc_id", "text", "body", "kept"] and [r.doc_id for r in kept.collect()] == [0]
    clash = frame(spark, [prose]).withColumnsRenamed({"body": "kept_", "kept": "ratio_"})
    assert compression.keep_documents(clash).columns == ["doc_id", "text", "kept_", "ratio_"]


def test_junk_is_found_wherever_it_stands():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    clean = " ".join(rng.choice(words, 1500)).encode()[:4100]
    noise = " ".join("".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 60)) for _ in range(90)).encode()[:4080]
    repeats = (b"the same sentence over and over again. " * 200)[:4080]
    rules = compression.CompressionRules(bands=((0, 0.0, 9.0),))
    judge = lambda text: compression._judge(text, rules, zstandard.ZstdCompressor(level=3))[-1]
    for bad in (noise, repeats):
        assert judge(bad + clean) == judge(clean + bad) == "chunks"
    assert judge(clean) == judge(clean + clean[::-1]) == "pass"
    # The overlap is not counted twice: ten bytes more after one bad chunk of six.
    long = b" ".join(w.encode() for w in rng.choice(words, 6000))[: 5 * 4096]
    assert judge(long + repeats + b" " * 16 + clean[:10]) == judge(long + repeats + b" " * 16) == "pass"


def test_fitted_limits(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    junk = lambda n: " ".join("".join(rng.choice(letters, 12)) for _ in range(n // 13))
    prose = [" ".join(rng.choice(vocabulary, n)) for n in (100, 200, 400, 800, 1600, 3200) for _ in range(120)]
    planted = [junk(n) for n in (1200, 1500, 2500, 3500, 5000, 9000, 20000)]
    # Copies of one text that outnumber all others of their length.
    docs = frame(spark, [*prose, *planted, *[prose[300]] * 2000, None, ""]).repartition(8)
    stated, fitted = compression.CompressionRules(), compression.fit_rules(docs)
    assert fitted == compression.fit_rules(docs.repartition(3))
    for start, low, high in fitted.bands:
        outer = max(b for b in stated.bands if b[0] <= start)
        assert outer[1] <= low <= outer[1] + 0.1 + 1e-9 and outer[2] - 0.15 - 1e-9 <= high <= outer[2]
    assert any(high < max(b for b in stated.bands if b[0] <= start)[2] for start, _, high in fitted.bands)
    rows = {r.doc_id: r for r in compression.judge_documents(docs, fitted).collect()}
    assert all(rows[k].kept for k in range(len(prose)))
    assert [rows[len(prose) + k].band for k in range(len(planted))] == ["incompressible"] * len(planted)
    before = compression.judge_documents(docs, stated).collect()
    assert any(r.band == "pass" and len(prose) <= r.doc_id < len(prose) + len(planted) for r in before)
    assert compression.fit_rules(docs.where("false")) == stated


def test_empty_table(spark):
    empty = frame(spark, ["x"]).where("false")
    assert compression.judge_documents(empty).count() == 0
    assert sentencepiece_table.encode_documents(empty, MODEL).count() == 0

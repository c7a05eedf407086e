"""Tokenizer alignment against the libraries on whole texts and a plain walk over byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from latticeqc.llm import alignment
from latticeqc.llm.queries import QUERIES

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = {c: bytes([b]) for c, b in alignment.byte_characters().items()}
ODD = [
    None, "", " ", "  ", "a", " a  b ", "a\nb\tc", "x" * 50_000, "中" * 3_000, "one two " * 9_000, "▁x ▁", "<s> a </s>", "<|endoftext|> x", "a\x00b", " x　 y",
    "café \U0001f600\U0001f600 你好", "it's we'll 123 4,5", " \n ", "\x1c \x1d a", "a   b", "ab1?" * 40_000, "dup", "dup",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(JSON)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [b"".join(BYTE[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = []
        for piece in self.b.id_to_piece(b):
            byte = piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6
            bytes_b.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], []
        return list(zip(a, bytes_a)), list(zip(b, bytes_b))

    def groups(self, text):
        """Two pointers; a group is closed where both sides have read as many bytes."""
        a, b = self.tokens(text)
        out, i, j, ga, gb, ra, rb = [], 0, 0, [], [], 0, 0
        while i < len(a) or j < len(b):
            if ra <= rb and i < len(a):
                ga.append(a[i][0])
                ra += len(a[i][1])
                i += 1
            else:
                gb.append(b[j][0])
                rb += len(b[j][1])
                j += 1
            if ra == rb:
                out.append((ga, gb))
                ga, gb = [], []
        return out


def brute(texts):
    plain = Plain()
    groups = [plain.groups(t) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for doc in groups for g in doc)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for doc in groups:
        links = [(g[0][-1], g[1][-1]) for g in doc]
        joined = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in doc)
        rows.append(
            (
                sum(len(g[0]) for g in doc), sum(len(g[1]) for g in doc), len(doc), len(links), sum(counts[x] == most[x[1]] for x in links),
                sum(counts[x] for x in links), hashlib.sha256(joined.encode()).hexdigest() if doc else "",
            )
        )
    return rows, counts


OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in OUT) for r in QUERIES["op12_tokenizer_alignment"](spark, folder).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])[0]))


def test_odd_texts(spark):
    rng = random.Random(5)
    alphabet = "ab Z1 \t\n\r  '’s.,!?<|>é中ー\U0001f600​́_ \x1f"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, "clash", b"x", 7) for i, t in enumerate(texts)], "doc_id long, text string, body string, pairs binary, n_a int")
    rows, pairs = alignment.align_documents(frame.repartition(5), JSON, MODEL)
    expected, counts = brute(texts)
    assert {r.doc_id: tuple(r[c] for c in OUT) for r in rows.collect()} == dict(enumerate(expected))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)


def test_windows_change_nothing():
    texts = [t for t in ODD if t] + ["ab1?" * 3_000]
    whole, small = alignment.Aligner(JSON, MODEL), alignment.Aligner(JSON, MODEL, part=50, window=7)
    for text in texts:
        a, b = whole.align(text), small.align(text)
        assert a[:5] == b[:5] and (a[5] == b[5]).all() and (a[6] == b[6]).all()


def test_empty_table_and_ids(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL)[0].collect() == []
    rows = alignment.align_documents(spark.createDataFrame([(None, "x"), (1, "x"), (1, "x")], "doc_id long, text string"), JSON, MODEL)[0].collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in rows) == [(0, 3), (1, 3), (1, 3)]

"""SentencePiece encoding and decoding by a table of distinct marked words.

SentencePiece writes a space as the marker U+2581. In many vocabularies no piece has a marker after
another character, so no merge crosses from the end of a word to the marker of the next one: the text
falls into chunks (markers, then a word) that are segmented on their own. Each distinct chunk is
segmented once per table and the ids are joined back by position.

The condition is checked on the vocabulary; where it fails, the whole text is the chunk. A null text
counts as empty and gives the begin and end ids only. Repeated rows give repeated results, other
columns are ignored, and no text is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from latticeqc.llm.common import inputs

MARK = "▁"
TABLE_CHUNKS = 300_000
TYPES = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


class ChunkTable:
    """Ids (little-endian, four bytes each) and decoded bytes of the chunks seen so far.

    ``limit`` bounds the memory of a task: a table that has grown past it is started anew between
    batches, which changes nothing but the work.
    """

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        identity = all(self.processor.normalize(x) == MARK + x for x in ("a\tb", "ﬁ", " ", "é"))
        spaces = self.processor.normalize("  a  b ") == MARK * 3 + "a" + MARK * 2 + "b" + MARK
        self.separable = identity and spaces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.split(marked) if self.separable else [MARK + text]

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > self.limit:
            self.ids, self.text = {}, {}
        new = list(chunks - self.ids.keys())
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            found = self.processor.encode([c[1:] for c in part], num_threads=1)
            lone = self.processor.piece_to_id(MARK)
            found = [ids if c != MARK else [lone] for c, ids in zip(part, found)]  # an empty text has no marker
            plain = self.processor.decode(found, num_threads=1)
            for chunk, ids, text in zip(part, found, plain):
                self.ids[chunk] = np.array(ids, "<u4").tobytes()
                self.text[chunk] = b" " + text.encode()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids with begin and end, and the text that they decode to, for each text."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.processor.bos_id(), self.processor.eos_id()))
        ids, text = self.ids.__getitem__, self.text.__getitem__
        # Decoding drops the space of the marker that encoding puts before the text.
        return [begin + b"".join(map(ids, c)) + end for c in cut], [b"".join(map(text, c))[1:] for c in cut]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")
) -> DataFrame:
    """``doc_id`` and the wanted ones of ids, n_tokens, ids_sha256, decoded, decoded_sha256, for each row.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    ``model_path`` is read once, on the driver; a model file has a fixed size.
    """
    model = Path(model_path).read_bytes()
    rows = inputs(docs, doc_id=id_col, body=text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{o} {TYPES[o]}" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, text = table.encode([t or "" for t in batch["body"].to_pylist()])
                made = {
                    "ids": lambda: _lists(ids),
                    "n_tokens": lambda: pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded": lambda: pa.array([t.decode() for t in text]),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(t).hexdigest() for t in text]),
                }
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{o: made[o]() for o in outputs}})

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each list of ids; a null list gives an empty text."""
    model = Path(model_path).read_bytes()
    rows = inputs(encoded, doc_id=id_col, ids=ids_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                text = processor.decode([i or [] for i in batch["ids"].to_pylist()], num_threads=1) if batch.num_rows else []
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(text, pa.string())})

    return rows.mapInArrow(run, schema)

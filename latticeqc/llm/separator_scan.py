"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a row of token ids of fixed width in which an end-of-document id closes each document.
Nothing says where documents begin, so every block is searched for the id on its own (one vectorised
comparison); a document that runs over block boundaries is stitched together by a prefix scan over the
blocks' separator counts: the separators before a place number the document it belongs to.

A block that is null or empty has no tokens; the bytes of an incomplete last token are no token. Two
separators in a row close an empty document (0 tokens). Tokens after the last separator of a file are a
document with ``closed`` false. Repeated blocks (same file and number) are the caller's error, and are
counted as they come, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs, written

BLOCK_BYTES = 1 << 20
#: Blocks that a task reads in one go from a file.
RUN = 64
#: Blocks whose counts one window adds up; the next level adds up the groups. A window holds the lists of its blocks in memory.
GROUP = 64
#: Blocks in a row group of a written table: a reader holds them at once.
GROUP_ROWS = 16
BYTE_END = 256


def _opened(path: str):
    """The file for reading by ranges: paths as Spark lists them, of the local file system or one that pyarrow knows."""
    if path.startswith("file:"):
        return open("/" + path[len("file:") :].lstrip("/"), "rb")
    store, inside = FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _opens(path: str) -> bool:
    try:
        _opened(path).close()
    except (OSError, ValueError, NotImplementedError):
        return path.startswith("file:")
    return True


def flat_ranges(files: DataFrame, block_bytes: int) -> DataFrame:
    """``path, length, first`` of every run of RUN blocks of ``files``, dealt over tasks."""
    run = RUN * block_bytes
    runs = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("length") - 1) / run), F.lit(0)))).alias("run"))
    total = files.agg(F.sum(F.floor(F.col("length") / run) + 1)).first()[0] or 1
    return runs.select("path", "length", (F.col("run") * RUN).alias("first")).repartition(min(total, 10_000))


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, payload`` of the flat files under ``path``.

    Files are listed with their lengths only; tasks read runs of blocks, whatever the size of a file. In a
    store that Python workers cannot open (neither local nor known to pyarrow), a file is one row of at most 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    store = F.regexp_extract("path", "^([^:]*):", 1)
    known = {r.s: _opens(r.path) for r in files.groupBy(store.alias("s")).agg(F.min("path").alias("path")).collect()}
    ranged = store.isin([s for s, opens in known.items() if opens])
    schema = "file string, block bigint, payload binary"

    def block(name: str, number: int, payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([number], pa.int64()), "payload": [payload]})

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    file.seek(row["first"] * block_bytes)
                    for number in range(row["first"], row["first"] + RUN):
                        size = min(block_bytes, row["length"] - number * block_bytes)
                        if size > 0 or number == 0:
                            payload = file.read(size)
                            if len(payload) != size:
                                raise OSError(f"{row['path']} is shorter than listed")
                            yield block(row["path"], number, payload)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                view = content.as_buffer()
                for number, at in enumerate(range(0, max(view.size, 1), block_bytes)):
                    yield block(name, number, view.slice(at, min(block_bytes, view.size - at)).to_pybytes())

    out = flat_ranges(files.where(ranged).select("path", "length"), block_bytes).mapInArrow(ranges, schema)
    if all(known.values()):
        return out
    return out.unionByName(files.where(~ranged).select("path", "content").mapInArrow(cut, schema))


def flat_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat files of byte tokens (two bytes each, id 256 ends a document): ``file, block, payload, doc_ids``.

    Each task writes one file. ``doc_ids`` are the documents that end in the block, in order; only
    ``document_ids`` reads them, the scan does not.
    """
    rows = inputs(docs, doc_id=id_col, body=text_col)
    rows = rows.withColumn("body", rows["body"].cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([BYTE_END], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        held, ids, number = bytearray(), [], 0
        ends: list[int] = []
        id_type = None

        def block(size: int) -> pa.RecordBatch:
            nonlocal held, ids, ends, number
            done = sum(e <= size for e in ends)
            out = pa.RecordBatch.from_pydict(
                {"file": [name], "block": pa.array([number], pa.int64()), "payload": [bytes(held[:size])], "doc_ids": pa.array([ids[:done]], pa.list_(id_type))}
            )
            held, ids, ends, number = held[size:], ids[done:], [e - size for e in ends[done:]], number + 1
            return out

        for batch in batches:
            id_type = batch["doc_id"].type
            for identity, text in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist()):
                held += np.frombuffer(text or b"", np.uint8).astype("<u2").tobytes() + end
                ids.append(identity)
                ends.append(len(held))
                while len(held) >= block_bytes:
                    yield block(block_bytes)
        if held:
            yield block(len(held))

    return rows.mapInArrow(write, f"file string, block bigint, payload binary, doc_ids array<{kind}>")


def _before(df: DataFrame, value: str) -> DataFrame:
    """``before``: the sum of ``value`` over the earlier blocks of the file, group by group."""
    grouped = df.withColumn("grp", F.floor(F.col("block") / GROUP))
    totals = grouped.groupBy("file", "grp").agg(F.sum(value).alias("n"))
    earlier = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = grouped.withColumn("part", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, ["file", "grp"])
    return out.withColumn("before", F.col("base") + F.col("part")).drop("grp", "base", "part")


def scan_blocks(blocks: DataFrame, end_id: int, width: int = 2, file_col: str = "file", block_col: str = "block", payload_col: str = "payload") -> DataFrame:
    """Per block: separators, tokens before the first and after the last one, and the lengths between them."""
    rows = inputs(blocks, file=file_col, block=block_col, payload=payload_col)
    kind = rows.schema["file"].dataType.simpleString()
    rows = rows.withColumn("block", F.col("block").cast("bigint")).withColumn("payload", F.col("payload").cast("binary"))

    def search(batch: pa.RecordBatch) -> dict:
        n_sep, head, tail, inner = [], [], [], [np.zeros(0, np.int64)]
        for payload in batch["payload"].to_pylist():
            tokens = np.frombuffer(payload or b"", f"<u{width}", count=len(payload or b"") // width)
            at = np.flatnonzero(tokens == end_id)
            n_sep.append(len(at))
            head.append(int(at[0]) if len(at) else len(tokens))
            tail.append(len(tokens) - int(at[-1]) - 1 if len(at) else 0)
            inner.append(np.diff(at) - 1)
        long = pa.int64()
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(a) for a in inner]), pa.int32()), pa.array(np.concatenate(inner), long))
        return {"file": batch["file"], "block": batch["block"], "n_sep": pa.array(n_sep, long), "head": pa.array(head, long), "tail": pa.array(tail, long), "inner": lists}

    return arrow_pass(rows, search, f"file {kind}, block bigint, n_sep bigint, head bigint, tail bigint, inner array<bigint>")


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2, file_col: str = "file", block_col: str = "block", payload_col: str = "payload") -> DataFrame:
    """``file, doc_no, n_tokens, closed``: one row per document of each file, numbered from 0 in file order."""
    # Written: the counts are read several times, the files only once.
    found = _before(written(scan_blocks(blocks, end_id, width, file_col, block_col, payload_col), group_rows=GROUP_ROWS), "n_sep")
    whole = found.select("file", "before", F.posexplode("inner").alias("k", "n_tokens"))
    whole = whole.select("file", (F.col("before") + 1 + F.col("k")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed"))
    ends = F.array(
        F.struct(F.col("before").alias("doc_no"), F.col("head").alias("n"), (F.col("n_sep") > 0).alias("closed")),
        F.struct((F.col("before") + F.col("n_sep")).alias("doc_no"), F.col("tail").alias("n"), F.lit(False).alias("closed")),
    )
    pieces = found.select("file", F.explode(ends).alias("p")).select("file", "p.*")
    stitched = pieces.groupBy("file", "doc_no").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed")).where("closed or n_tokens > 0")
    return whole.unionByName(stitched)


def document_ids(flat: DataFrame) -> DataFrame:
    """``file, doc_no, doc_id`` of files made by ``flat_bytes``."""
    sized = flat.select("file", "block", "doc_ids", F.size("doc_ids").cast("bigint").alias("n"))
    return _before(sized, "n").select("file", "before", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("before") + F.col("k")).alias("doc_no"), "doc_id")

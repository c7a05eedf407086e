"""Rasters into long rows.  The decoder is a parameter; the default reads uncompressed strips.

``ingest_rasters`` takes files as rows with their content, so that a file is decoded in one task.
``ingest_raster_files`` takes their paths: it reads strip tables first and then deals ranges of bytes over tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from latticeqc.session import materialize
from latticeqc.sources.ranges import open_file

Decoder = Callable[[bytes], tuple[np.ndarray, int]]
#: Bytes of a file from a place on.
Reader = Callable[[int, int], bytes]

# TIFF tag numbers and the NumPy kind of each sample format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 279, 339
KINDS = {1: "u", 2: "i", 3: "f"}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
# By magic number, the codes of a place, of the number of fields and of a field's number of values.
LAYOUTS = {42: ("I", "H", "I"), 43: ("Q", "Q", "Q")}

SCHEMA = (
    "channel STRING, readable BOOLEAN, error STRING, dtype STRING, frames INT, ndim INT,"
    " height INT, width INT, row INT, col INT, value DOUBLE"
)
SAMPLE_FIELDS = [
    ("channel", pa.string()), ("readable", pa.bool_()), ("error", pa.string()), ("dtype", pa.string()), ("frames", pa.int32()), ("ndim", pa.int32()),
    ("height", pa.int32()), ("width", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64()),
]


def read_tags(read: Reader, size: int) -> tuple[dict[int, tuple], int, str]:
    """Tags of the first image, the number of images and the byte order of a TIFF of ``size`` bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    (magic,) = struct.unpack_from(order + "H", head, 2)
    if magic not in LAYOUTS:
        raise ValueError("not a TIFF")
    place_code, count_code, values_code = (order + c for c in LAYOUTS[magic])
    wide, counted = struct.calcsize(place_code), struct.calcsize(count_code)
    (at,) = struct.unpack_from(place_code, head, wide)
    first, seen = None, set()
    while at:
        if at in seen:
            raise ValueError("image directories form a circle")
        seen.add(at)
        (fields,) = struct.unpack(count_code, read(at, counted))
        step = 4 + 2 * wide
        if at + counted + fields * step + wide > size:
            raise ValueError("an image directory goes beyond the file")
        body = read(at + counted, fields * step + wide)
        if first is None:
            first = {}
            for start in range(0, fields * step, step):
                tag, kind, n = struct.unpack_from(order + "HH" + values_code[1], body, start)
                if kind not in FIELD_CODES:
                    continue
                unit = f"{order}{n}{FIELD_CODES[kind]}"
                length = n * struct.calcsize(order + FIELD_CODES[kind])
                inside = body[start + 4 + wide : start + 4 + wide + length]
                if length > wide:
                    (place,) = struct.unpack_from(place_code, body, start + 4 + wide)
                    if place + length > size:
                        raise ValueError("the values of a tag go beyond the file")
                    inside = read(place, length)
                first[tag] = struct.unpack(unit, inside)
        (at,) = struct.unpack_from(place_code, body, fields * step)
    if first is None:
        raise ValueError("no image")
    if first.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed strips need another decoder")
    return first, len(seen), order


def sample_type(tags: dict[int, tuple], order: str) -> np.dtype:
    return np.dtype(f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")


def _shape(tags: dict[int, tuple]) -> tuple[int, ...]:
    samples = tags.get(SAMPLES, (1,))[0]
    return (tags[HEIGHT][0], tags[WIDTH][0]) + ((samples,) if samples > 1 else ())


def decode_strips(data: bytes) -> tuple[np.ndarray, int]:
    """First image of an uncompressed TIFF and the number of images; the sample type is kept as stored."""
    tags, frames, order = read_tags(lambda at, n: data[at : at + n], len(data))
    parts = [data[o : o + n] for o, n in zip(tags[OFFSETS], tags[COUNTS])]
    return np.frombuffer(b"".join(parts), dtype=sample_type(tags, order)).reshape(_shape(tags)), frames


def encode_strip(array: np.ndarray) -> bytes:
    """A 2-D float32 or uint8 array as a one-strip little-endian TIFF."""
    height, width = array.shape
    body = np.ascontiguousarray(array, dtype=array.dtype.newbyteorder("<")).tobytes()
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    values = [
        (WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 8 * array.dtype.itemsize), (COMPRESSION, 3, 1),
        (OFFSETS, 4, 8), (SAMPLES, 3, 1), (COUNTS, 4, len(body)), (FORMAT, 3, kind),
    ]
    head = struct.pack("<2sHI", b"II", 42, 8 + len(body))
    tags = b"".join(struct.pack("<HHII", tag, code, 1, value) for tag, code, value in values)
    return head + body + struct.pack("<H", len(values)) + tags + struct.pack("<I", 0)


def _batch(fields: pa.Schema, size: int, values: dict) -> pa.RecordBatch:
    """``size`` rows: arrays as they are, single values repeated, null where nothing is given."""

    def column(field: pa.Field) -> pa.Array:
        value = values.get(field.name)
        return pa.array(value, field.type) if isinstance(value, np.ndarray) else pa.repeat(pa.scalar(value, field.type), size)

    return pa.RecordBatch.from_arrays([column(f) for f in fields], schema=fields)


def _facts(shape: tuple[int, ...], kind: np.dtype, frames: int) -> dict:
    facts = {"readable": True, "dtype": str(kind.newbyteorder("=")), "frames": frames, "ndim": len(shape)}
    return {**facts, "height": shape[0], "width": shape[1]} if len(shape) == 2 else facts


def _slices(fields: pa.Schema, key: dict, flat: np.ndarray, first: int, width: int, slice_rows: int) -> Iterator[pa.RecordBatch]:
    """Samples of a run that starts at place ``first`` of its raster."""
    for at in range(0, flat.size, slice_rows):
        part = flat[at : at + slice_rows]
        row, col = np.divmod(np.arange(first + at, first + at + len(part)), width)
        yield _batch(fields, len(part), {**key, "row": row, "col": col, "value": part.astype("float64")})


def _layout(files: DataFrame) -> tuple[pa.Schema, str]:
    kind = files.schema["package_id"].dataType
    return pa.schema([("package_id", to_arrow_type(kind)), *SAMPLE_FIELDS]), f"package_id {kind.simpleString()}, {SCHEMA}"


def ingest_rasters(files: DataFrame, decoder: Decoder = decode_strips, slice_rows: int = 65_536) -> DataFrame:
    """``package_id, channel, content`` to decoding facts and samples; ids are of any type.

    Each file gives one row with its facts (or ``error``) and no sample, then its samples without facts, in slices of
    ``slice_rows``, so that what a task sends at once does not grow with a raster.
    """
    slim = files.select("package_id", "channel", "content")
    fields, ddl = _layout(slim)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, channel, content in zip(batch["package_id"].to_pylist(), batch["channel"].to_pylist(), batch["content"]):
                key = {"package_id": package, "channel": channel}
                try:
                    array, frames = decoder(content.as_py())
                except Exception as error:  # any failure of a decoder is a finding, not a failed job
                    yield _batch(fields, 1, {**key, "readable": False, "error": f"{type(error).__name__}: {error}"})
                    continue
                yield _batch(fields, 1, {**key, **_facts(array.shape, array.dtype, frames)})
                if array.ndim == 2:
                    yield from _slices(fields, key, array.reshape(-1), 0, array.shape[1], slice_rows)

    return slim.mapInArrow(decode, ddl)


def pieces(offsets: tuple[int, ...], counts: tuple[int, ...], piece_bytes: int) -> Iterator[list[dict[str, int]]]:
    """The strips, put end to end and cut at every ``piece_bytes``, as ranges of the file."""
    held: list[dict[str, int]] = []
    room = piece_bytes
    for at, left in zip(offsets, counts):
        while left:
            size = min(left, room)
            held.append({"at": at, "size": size})
            at, left, room = at + size, left - size, room - size
            if not room:
                yield held
                held, room = [], piece_bytes
    if held:
        yield held


def ingest_raster_files(files: DataFrame, slice_rows: int = 65_536, piece_bytes: int = 8 << 20) -> DataFrame:
    """``package_id, channel, path, bytes`` of uncompressed rasters to the rows of ``ingest_rasters``.

    One pass reads the tags of each file, a second the samples: pieces of ``piece_bytes`` (a multiple of 16) of the
    strips are dealt over tasks, so that a raster of any size is decoded in as many tasks as it has pieces. A file
    that is no such raster gives a finding; one that cannot be read fails its task, which Spark tries again. Null paths are
    findings. Strips that do not hold as many bytes as the shape asks for are one too.
    """
    if piece_bytes <= 0 or piece_bytes % 16:
        raise ValueError("piece_bytes has to be a positive multiple of 16")
    slim = files.select("package_id", "channel", "path", "bytes")
    fields, ddl = _layout(slim)
    extra = [("path", pa.string()), ("stored", pa.string()), ("first", pa.int64()), ("ranges", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])))]
    wide = pa.schema([*fields, *extra])

    def plan(path: str, size: int) -> tuple[dict, list[dict]]:
        with open_file(path) as file:

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            tags, frames, order = read_tags(read, size)
        shape, kind = _shape(tags), sample_type(tags, order)
        held = sum(max(min(n, size - o), 0) for o, n in zip(tags[OFFSETS], tags[COUNTS]))
        if held != int(np.prod(shape, dtype=object)) * kind.itemsize:
            raise ValueError("the strips do not hold the samples of the shape")
        facts = _facts(shape, kind, frames)
        if len(shape) != 2:
            return facts, []
        cut = ((o, min(n, size - o)) for o, n in zip(tags[OFFSETS], tags[COUNTS]) if o < size)
        found = list(cut)
        ranges = pieces(tuple(o for o, _ in found), tuple(n for _, n in found), piece_bytes)
        per_piece = piece_bytes // kind.itemsize
        return facts, [{"stored": kind.str, "first": k * per_piece, "width": shape[1], "ranges": r} for k, r in enumerate(ranges)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = {"package_id": row["package_id"], "channel": row["channel"]}
                try:
                    if row["path"] is None or row["bytes"] is None:
                        raise ValueError("no path or size")
                    facts, found = plan(row["path"], row["bytes"])
                except OSError:
                    raise
                except Exception as error:  # what is not such a raster is a finding
                    yield _batch(wide, 1, {**key, "readable": False, "error": f"{type(error).__name__}: {error}"})
                    continue
                yield _batch(wide, 1, {**key, **facts})
                for piece in found:
                    yield _batch(wide, 1, {**key, "path": row["path"], **piece})

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    parts = []
                    for r in row["ranges"]:
                        file.seek(r["at"])
                        parts.append(file.read(r["size"]))
                if sum(map(len, parts)) != sum(r["size"] for r in row["ranges"]):
                    raise OSError(f"{row['path']} is shorter than listed")
                flat = np.frombuffer(b"".join(parts), dtype=np.dtype(row["stored"]))
                yield from _slices(fields, {"package_id": row["package_id"], "channel": row["channel"]}, flat, row["first"], row["width"], slice_rows)

    planned = materialize(slim.mapInArrow(tables, f"{ddl}, path STRING, stored STRING, first BIGINT, ranges ARRAY<STRUCT<at BIGINT, size BIGINT>>"))
    todo = planned.where("path IS NOT NULL")
    total = todo.count()
    names = [f.name for f in fields]
    return planned.where("path IS NULL").select(*names).unionByName(todo.repartition(max(min(total, 10_000), 1)).mapInArrow(samples, ddl))


def channel_table(samples: DataFrame) -> DataFrame:
    """One row per raster with its decoding facts."""
    facts = ["readable", "error", "dtype", "frames", "ndim", "height", "width"]
    return samples.where("readable IS NOT NULL").select("package_id", "channel", *facts)


def vertex_table(samples: DataFrame) -> DataFrame:
    """The x, y and z channels side by side: ``package_id, row, col, x, y, z``."""
    planes = samples.where(F.col("channel").isin("x", "y", "z") & F.col("row").isNotNull())
    return planes.groupBy("package_id", "row", "col").agg(
        *[F.max(F.when(F.col("channel") == a, F.col("value"))).alias(a) for a in "xyz"]
    )


def mask_table(samples: DataFrame) -> DataFrame:
    """Samples of the mask channel: ``package_id, mrow, mcol, value``."""
    return samples.where("channel = 'mask' AND row IS NOT NULL").selectExpr("package_id", "row AS mrow", "col AS mcol", "value")

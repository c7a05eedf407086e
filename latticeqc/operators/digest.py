"""Digests of collections: ordered ones level by level, unordered ones as sums, so that no list grows with the data.

The hex values differ from a digest over one long byte string; equality of collections is preserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT, BLOCK = 4096, 1024


def _joined(order: Sequence[str], text: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.sha2(F.array_join(F.transform(rows, lambda s: s["_t"]), separator), 256)


def grid_digest(df: DataFrame, text: str, keys: Sequence[str] = ("package_id",), name: str = "digest") -> DataFrame:
    """Digest of ``text`` in row-major order: line segments, then row blocks, then the surface."""
    keys = list(keys)
    lines = df.groupBy(*keys, "row", F.expr(f"col div {SEGMENT}").alias("_s")).agg(_joined(["col"], text, ";").alias("_d"))
    blocks = lines.groupBy(*keys, F.expr(f"row div {BLOCK}").alias("_b")).agg(_joined(["row", "_s"], "_d", "\n").alias("_d"))
    return blocks.groupBy(*keys).agg(_joined(["_b"], "_d", "\n").alias(name))


def set_digest(value: Column) -> Column:
    """Aggregate: digest of a collection without order, of one fixed size whatever the size of the group.

    The hash of each member is cut into four numbers of 60 bits; their sums and the number of members are hashed. Sums
    combine on the map side, so no list is made and a hot group is not gathered anywhere.
    """
    h = F.sha2(value, 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256)


def ids_digest(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ids, digest`` of a collection of ids; an empty one has no row with keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("ids"), set_digest(F.col(column)).alias("digest"))


def tree_digest(files: DataFrame, path: str, digest: str) -> DataFrame:
    """Digest of a file tree: ``path NUL sha`` entries, combined like ``ids_digest``."""
    entry = F.concat(F.col(path), F.lit("\0"), F.col(digest))
    return ids_digest(files.select(entry.alias("_e")), "_e")

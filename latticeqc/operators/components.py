"""Connected components: run-length runs on grids, alternating star contraction on graphs.

The contraction is the large-star / small-star scheme of Kiveris et al., "Connected Components in
MapReduce and Beyond" (SoCC 2014).  Neighbour minima are aggregated with map-side combine, so a hub
with many edges is not collected anywhere.  They are written before the edges are joined back to them: the
join is then between two tables, and it is broadcast if the minima are few, or else AQE can split the hub.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeqc.session import discard, materialize, merged

CHUNK = 64
LINE = 4096
ROWS = 128


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64(*edges.columns)
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(h)).first()
    return tuple(row)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    low = materialize(low.withColumn("m", F.least("m", "u")))
    return both.where(F.col("v") > F.col("u")).join(low, [*keys, "u"]).select(
        *keys, F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    # Every edge already points from the larger to the smaller node.
    low = materialize(edges.groupBy(*keys, "u").agg(F.min("v").alias("m")))
    moved = (
        edges.join(low, [*keys, "u"])
        .where(F.col("v") > F.col("m"))
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, label`` for every node with an edge; label is the smallest node reached.

    ``edges`` has ``keys, u, v``; direction and duplicates do not matter.
    """
    keys = list(keys)
    current = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _fingerprint(current)
    while mark[0]:
        starred = materialize(_large_star(current, keys))
        following = materialize(_small_star(starred, keys))
        step = _fingerprint(following)
        discard(current, starred)
        current = following
        if step == mark:
            break
        mark = step
    members = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("label"))
    roots = current.select(*keys, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return members.unionByName(roots)


def graph_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, label`` for all nodes; a node without edges is its own component."""
    keys = list(keys)
    found = star_components(edges, keys)
    return nodes.select(*keys, "node").join(found, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("label", "node").alias("label")
    )


def runs(cells: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Maximal horizontal runs ``keys, row, lo, hi`` of the given cells.

    Lines are cut every LINE columns so that one window never grows with the width of a surface.
    """
    keys = list(keys)
    line = Window.partitionBy(*keys, "row", "_line").orderBy("col")
    return (
        cells.select(*keys, "row", "col", F.floor(F.col("col") / LINE).alias("_line"))
        .withColumn("_island", F.col("col") - F.row_number().over(line))
        .groupBy(*keys, "row", "_line", "_island")
        .agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
        .select(*keys, "row", "lo", "hi", _run_id().alias("run"))
    )


def _run_id():
    return F.col("row").cast("bigint") * F.lit(1 << 31) + F.col("lo").cast("bigint")


def run_edges(run_table: DataFrame, keys: Sequence[str], connectivity: int) -> DataFrame:
    """Touching runs of adjacent rows, plus the two halves of a run cut at a line boundary.

    Runs meet through column chunks of fixed width, so a row with very many runs is not compared
    pairwise.
    """
    keys = list(keys)
    reach = 1 if connectivity == 8 else 0

    def chunked(df: DataFrame, lo, hi) -> DataFrame:
        span = F.sequence(F.floor(F.greatest(lo, F.lit(0)) / CHUNK), F.floor(hi / CHUNK))
        return df.withColumn("_chunk", F.explode(span))

    upper = chunked(run_table, F.col("lo") - reach, F.col("hi") + reach).select(
        *keys, (F.col("row") + 1).alias("row"), "_chunk", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("run").alias("v")
    )
    lower = chunked(run_table, F.col("lo"), F.col("hi")).select(
        *keys, "row", "_chunk", "lo", "hi", F.col("run").alias("u")
    )
    vertical = (
        lower.join(upper, [*keys, "row", "_chunk"])
        .where((F.col("lo") <= F.col("uhi") + reach) & (F.col("ulo") <= F.col("hi") + reach))
        .select(*keys, "u", "v")
    )
    left = run_table.where((F.col("hi") + 1) % LINE == 0).select(
        *keys, "row", (F.col("hi") + 1).alias("lo"), F.col("run").alias("v")
    )
    cut = run_table.where((F.col("lo") % LINE == 0) & (F.col("lo") > 0)).select(*keys, "row", "lo", F.col("run").alias("u"))
    return vertical.unionByName(cut.join(left, [*keys, "row", "lo"]).select(*keys, "u", "v")).distinct()


def _block(run: str) -> str:
    """Block of a run, from its id: ROWS grid rows by LINE columns, so at most ROWS * LINE / 2 runs."""
    return f"concat_ws(':', ({run} div {1 << 31}) div {ROWS}, ({run} % {1 << 31}) div {LINE})"


def _smallest_reached(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Smallest node index in the component of each node."""
    low = np.arange(size)
    while True:
        before = low.copy()
        edge_low = np.minimum(low[u], low[v])
        np.minimum.at(low, u, edge_low)
        np.minimum.at(low, v, edge_low)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _block_roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, root`` inside each block; a block is small by construction."""
    schema = T.StructType([edges.schema[k] for k in keys] + [T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        nodes, index = np.unique(np.concatenate([block["u"], block["v"]]), return_inverse=True)
        half = len(block)
        root = nodes[_smallest_reached(index[:half], index[half:], len(nodes))]
        out = pd.DataFrame({"node": nodes, "root": root})
        for position, key in enumerate(keys):
            out.insert(position, key, block[key].iloc[0])
        return out

    inner = edges.withColumn("_bu", F.expr(_block("u"))).where(f"_bu = {_block('v')}")
    return inner.groupBy(*keys, "_bu").applyInPandas(solve, schema)


def label_runs(cells: DataFrame, keys: Sequence[str] = ("package_id",), connectivity: int = 4) -> DataFrame:
    """``keys, row, lo, hi, label``: runs with their component; label is the first run in row-major order."""
    keys = list(keys)
    table = materialize(runs(cells, keys))
    return _labelled(table, run_edges(table, keys, connectivity), keys)


def _labelled(table: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Runs are first joined inside blocks of bounded size, which shortens every path ROWS times; the
    star contraction then works on the few edges between blocks.
    """
    touching = materialize(edges)
    local = materialize(_block_roots(touching, keys))
    between = touching.where(f"{_block('u')} <> {_block('v')}")
    for end in ("u", "v"):
        root = local.select(*keys, F.col("node").alias(end), F.col("root").alias("_r"))
        between = between.join(root, [*keys, end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    stars = star_components(between, keys).select(*keys, F.col("node").alias("root"), "label")
    rooted = table.join(local.withColumnRenamed("node", "run"), [*keys, "run"], "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "run")).join(stars, [*keys, "root"], "left")
    return rooted.select(*keys, "row", "lo", "hi", F.coalesce("label", "root").alias("label"))


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("bigint").alias("size"))


def enclosed(labelled: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Runs of components that do not reach the border of the ``height`` x ``width`` lattice."""
    keys = list(keys)
    placed = labelled.join(shapes, keys)
    on_border = (
        (F.col("row") == 0)
        | (F.col("row") == F.col("height") - 1)
        | (F.col("lo") == 0)
        | (F.col("hi") == F.col("width") - 1)
    )
    inner = placed.groupBy(*keys, "label").agg(F.bool_or(on_border).alias("open")).where(~F.col("open"))
    inner = materialize(inner.select(*keys, "label"))
    return labelled.join(merged(inner), [*keys, "label"], "left_semi")


def region_summary(labelled: DataFrame, keys: Sequence[str] = ("package_id",), limit: int | None = None) -> DataFrame:
    """Size, bounding box and centroid per component, ranked by size, ties by first cell.

    With ``limit`` only the largest are listed; ``total`` has the number of all, ``truncated`` whether some are not listed.
    """
    keys = list(keys)
    length = F.col("hi") - F.col("lo") + 1
    stats = labelled.groupBy(*keys, "label").agg(
        F.sum(length).cast("bigint").alias("cell_count"),
        F.min("row").alias("row_min"),
        F.min("lo").alias("col_min"),
        F.max("row").alias("row_max"),
        F.max("hi").alias("col_max"),
        (F.sum(F.col("row") * length) / F.sum(length)).alias("centroid_row"),
        (F.sum((F.col("lo") + F.col("hi")) * length / 2.0) / F.sum(length)).alias("centroid_col"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("cell_count"), "label")
    ranked = stats.withColumn("rank", F.row_number().over(order))
    totals = stats.groupBy(*keys).agg(F.count("*").alias("total"))
    listed = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    truncated = F.lit(False) if limit is None else F.col("total") > limit
    return listed.join(totals, keys).withColumn("truncated", truncated)


def expand_runs(labelled: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Runs back to single cells ``keys, row, col, label``."""
    return labelled.select(*keys, "row", F.explode(F.sequence("lo", "hi")).alias("col"), "label")

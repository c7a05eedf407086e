"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are turned to whole numbers, floor(scale * x), so scores are exact. Rows are dealt by hash to parts;
a task holds one part and one block of queries, indexes both in cover trees and walks the trees together. A node
has a centre and a covering radius. For a query node (c, r) and a data node (d, s), no pair scores above
c.d + |c| s + |d| r + r s; the pair of nodes is left when that is below the worst kth score in the query node so far.
Inside the last nodes every pair is scored. Each task leaves k rows per query, and a window takes the best k of all.

A null vector, one with a null, NaN or infinite component, and a row with a null id take no part. Vectors of
different lengths are not compared. A query's own row is no candidate, other rows with its id are. Ties go to the
smaller id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.llm.common import inputs, written


@dataclass(frozen=True)
class TopK:
    """A task holds ``part_rows`` rows in trees of ``tree_rows`` and ``block_queries`` queries."""

    k: int = 5
    scale: int = 256
    part_rows: int = 8192
    tree_rows: int = 2048
    block_queries: int = 4096
    base: float = 1.6
    leaf: int = 24


class CoverTree:
    """Nodes over ``points``: centre, covering radius, children; the points of a node stand together in ``order``.

    A node's children are a net of its points: each child takes the points within radius / base of its centre, and
    the centre of a child is no nearer than that to an earlier one. Centres stay centres further down.
    """

    def __init__(self, points: np.ndarray, base: float, leaf: int):
        self.points = points
        square = (points**2).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))
        self.order = np.zeros(len(points), np.int64)
        centre, radius, first, last, children = [], [], [], [], []

        def node(members: np.ndarray, start: int) -> int:
            mine = len(centre)
            reach = apart[members[0], members]
            centre.append(members[0])
            radius.append(float(reach.max()))
            first.append(start)
            last.append(start + len(members))
            children.append([])
            return mine

        waiting = [(node(np.arange(len(points)), 0), np.arange(len(points)))] if len(points) else []
        while waiting:
            mine, members = waiting.pop()
            start = first[mine]
            self.order[start : last[mine]] = members
            if len(members) <= leaf or radius[mine] == 0:
                continue
            within, left = radius[mine] / base, members
            while len(left):
                near = apart[left[0], left] <= within
                child = node(left[near], start)
                children[mine].append(child)
                waiting.append((child, left[near]))
                start += int(near.sum())
                left = left[~near]
        self.centre, self.radius = np.array(centre, np.int64), np.array(radius)
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.children = [np.array(c, np.int64) for c in children]
        self.inner = np.array([len(c) > 0 for c in children], bool)
        self.length = np.sqrt(square[self.centre]) if len(points) else np.zeros(0)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.first[n] : self.last[n]] for n in nodes]) if len(nodes) else np.zeros(0, np.int64)


class DualSearch:
    """Best k of each query so far; ``walk`` adds the points of one more tree."""

    def __init__(self, queries: CoverTree, owner: np.ndarray, k: int):
        self.queries, self.owner, self.k = queries, owner, k
        shape = (len(queries.points), k)
        self.score, self.place = np.full(shape, -np.inf), np.full(shape, -1, np.int64)
        self.scored = 0

    def walk(self, data: CoverTree, ids: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
        """``places`` are the points' ranks by id, over all trees, by which ties are settled; ``rows`` tell a query's own row."""
        self.data, self.ids, self.rows, self.places = data, ids, rows, places
        if len(data.points) and len(self.queries.points):
            self._pair(np.array([0]), np.array([0]))

    def _worst(self, nodes: np.ndarray) -> np.ndarray:
        kth = self.score[self.queries.order, -1]
        return np.array([kth[self.queries.first[n] : self.queries.last[n]].min() for n in nodes])

    def _pair(self, near: np.ndarray, far: np.ndarray) -> None:
        q, d = self.queries, self.data
        middle = q.points[q.centre[near]] @ d.points[d.centre[far]].T
        r, s = q.radius[near][:, None], d.radius[far][None, :]
        bound = middle + q.length[near][:, None] * s + d.length[far][None, :] * r + r * s
        slack = 1e-9 * (1 + np.abs(bound))
        alive = bound + slack >= self._worst(near)[:, None]
        far_used = alive.any(axis=0)
        near_used = alive.any(axis=1)
        near, far = near[near_used], far[far_used]
        if not len(near) or not len(far):
            return
        split = q.inner[near]
        for n in near[split]:
            for at in range(0, len(q.children[n]), 256):
                self._pair(q.children[n][at : at + 256], far)
        near = near[~split]
        if not len(near):
            return
        deeper = d.inner[far]
        if not deeper.all():
            self._score(q.members(near), d.members(far[~deeper]))
        if deeper.any():
            self._pair(near, np.concatenate([d.children[n] for n in far[deeper]]))

    def _score(self, asked: np.ndarray, points: np.ndarray) -> None:
        points = points[np.argsort(self.places[points], kind="stable")]
        for at in range(0, len(points), 1024):
            part = points[at : at + 1024]
            score = self.queries.points[asked] @ self.data.points[part].T
            self.scored += score.size
            score[self.owner[asked][:, None] == self.rows[part][None, :]] = -np.inf
            changed = np.flatnonzero((score >= self.score[asked, -1][:, None]).any(axis=1))
            for row in changed:
                query = asked[row]
                good = np.flatnonzero((score[row] >= self.score[query, -1]) & (score[row] > -np.inf))
                both = np.concatenate([self.score[query], score[row, good]])
                place = np.concatenate([self.place[query], self.places[part[good]]])
                best = np.lexsort((place, -both))[: self.k]
                self.score[query], self.place[query] = both[best], place[best]


def _search(options: TopK):
    def search(group: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(group["z"].to_pylist()), "<f8").reshape(group.num_rows, -1)
        asking = np.asarray(group["asking"])
        ids, rows = np.asarray(group["id"]), np.asarray(group["uid"])
        mine, data = np.flatnonzero(asking), np.flatnonzero(~asking)
        data = data[np.argsort(ids[data], kind="stable")]
        rank = np.arange(len(data))
        found = DualSearch(CoverTree(vectors[mine], options.base, options.leaf), rows[mine], options.k)
        deal = np.argsort(rows[data], kind="stable")
        for at in range(0, len(data), options.tree_rows):
            part = deal[at : at + options.tree_rows]
            found.walk(CoverTree(vectors[data[part]], options.base, options.leaf), ids[data[part]], rows[data[part]], rank[part])
        query, slot = np.nonzero(found.place >= 0)
        return pa.table(
            {
                "uid": rows[mine][query], "query_id": ids[mine][query], "vec_id": ids[data[found.place[query, slot]]],
                "score": found.score[query, slot].astype(np.int64),
            }
        )

    return search


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """``z``: the whole numbers as eight-byte floats, which hold products up to 2**53 exactly."""
    kinds = rows.drop("vector").schema

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch["vector"]
        flat = np.floor(scale * np.asarray(lists.flatten(), np.float64)).astype("<f8")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        z = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_pydict({**{f.name: batch[f.name] for f in kinds.fields}, "z": pa.array(z, pa.binary())})

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields)
    return rows.mapInArrow(lambda batches: map(pack, batches), f"{ddl}, z binary")


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def exact_top_k(vectors: DataFrame, is_query: Column, options: TopK = TopK(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition over ``vectors``."""
    rows = inputs(vectors.withColumn(flag := f"asks_{uuid.uuid4().hex}", F.coalesce(is_query, F.lit(False))), id=id_col, vector=vector_col, asks=flag)
    rows = rows.withColumn("id", F.col("id").cast("bigint")).withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = written(_packed(rows, options.scale).withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.length("z")))
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("bigint")), F.lit(0))).first()
    parts, blocks = max(1, -(-total // options.part_rows)), max(1, -(-asked // options.block_queries))
    dealt = F.pmod(F.xxhash64("uid"), F.lit(parts).cast("bigint")).alias("part")
    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks).cast("bigint")).alias("block")
    data = rows.select("dim", "id", "uid", "z", F.lit(False).alias("asking"), dealt, _each(blocks).alias("block"))
    queries = rows.where("asks").select("dim", "id", "uid", "z", F.lit(True).alias("asking"), _each(parts).alias("part"), block)
    found = data.unionByName(queries).groupBy("dim", "part", "block").applyInArrow(_search(options), "uid bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= options.k).select("query_id", "rank", "vec_id", "score")

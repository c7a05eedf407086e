"""N-gram Jaccard join by a MinHash LSH forest.

A document is its set of word shingles. Signatures are cut into ``trees`` keys of ``depth`` minima. In place of
walking prefix tries by data, one prefix length is computed: the longest, ``depth`` at most, at which the
chance that a pair at the threshold shares a prefix in some tree reaches the target recall. That is banding at
this prefix; later minima of a tree serve only the estimated distances. Documents that share a prefix (a node)
are candidates; exact Jaccard of whole sets decides. Where no length reaches the recall, an error is raised.

How it stays whole and spread out:

* Equal sets are one class (a group-by with map-side combine), so copies meet once.
* Below a trie node a member is compared with those that no component has yet; near copies fall away at once.
  A node with very many members is split over tasks. A part passes on leaders with the radius of what they stand for;
  the share of unequal minima is a metric, so leaders within the reach plus both radii are linked. Leaders
  are dealt into parts again, and every pair of parts is one group of bounded size.
* What hangs together is a candidate component. Its sets are dealt into tiles of bounded size, and every pair of
  tiles is one group, in which pairs are verified and only counts and spanning links leave.

Defined results: a text with fewer words than a shingle is one shingle of all its words; null and empty
texts have no shingle, are their own class and have no links. ``links`` counts the other rows with Jaccard
at or above the threshold, copies included. The class is the connected component of links, named by its smallest id.
Repeated rows are copies of each other. Ids are integers or strings; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import arrow_pass, inputs, written
from latticeqc.llm.words import hash_words, mixed, split_words, window_hashes
from latticeqc.operators.components import star_components

SLICE = 400
#: Slots of the filter that keeps texts out of a shuffle that has no use for them: so many rows are broadcast at most.
SLOTS = 1 << 20


@dataclass(frozen=True)
class Forest:
    """Twice ``slack`` is added to the distance for estimates: with 128 minima, 0.12 is about three deviations."""

    words: int = 5
    threshold: Fraction = Fraction(4, 5)
    trees: int = 16
    depth: int = 8
    recall: float = 0.9995
    slack: float = 0.12
    tile_shingles: int = 200_000
    tile_sets: int = 256
    node_members: int = 4000

    @property
    def prefix(self) -> int:
        """Longest prefix that reaches the recall at the threshold, shortened minimum by minimum."""
        length = self.depth
        while length > 1 and 1 - (1 - float(self.threshold) ** length) ** self.trees < self.recall:
            length -= 1
        if 1 - (1 - float(self.threshold) ** length) ** self.trees < self.recall:
            raise ValueError(f"{self.trees} trees miss a recall of {self.recall} at {self.threshold} even with one minimum; give more trees")
        return length


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, ends = split_words(pc.utf8_lower(pc.fill_null(text, "")))
    hashes = hash_words(flat)
    runs = window_hashes(hashes, words)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else runs[:0])
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Minima of ``size`` hash orders, 32 bits each, a row per set; an empty set has the largest value everywhere."""
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    for row, members in enumerate(sets):
        for at in range(0, len(members), 1024):
            part = (factors[:, None] * members[None, at : at + 1024]) >> np.uint64(32)
            np.minimum(out[row], part.min(axis=1).astype(np.uint32), out=out[row])
    return out


def signed(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """``doc, node, n, keys``: the digest of the shingle set, its size and its signature, for each row."""
    rows = inputs(docs, doc=id_col, body=text_col)
    rows = rows.withColumn("body", F.col("body").cast("string"))
    kind = rows.schema["doc"].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> dict:
        node, n, keys = [], [], []
        for at in range(0, batch.num_rows, SLICE):
            sets = shingle_sets(batch["body"].slice(at, SLICE), forest.words)
            node += [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            n += [len(s) for s in sets]
            keys += [row.tobytes() for row in signatures(sets, forest.trees * forest.depth)]
        return {"doc": batch["doc"], "node": pa.array(node, pa.string()), "n": pa.array(n, pa.int64()), "keys": pa.array(keys, pa.binary())}

    return arrow_pass(rows, sign, f"doc {kind}, node string, n bigint, keys binary")


def _roots(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    low = np.arange(size)
    while len(u):
        before = low.copy()
        least = np.minimum(low[u], low[v])
        np.minimum.at(low, u, least)
        np.minimum.at(low, v, least)
        low = low[low]
        if np.array_equal(low, before):
            break
    return low


def _united(keys: np.ndarray, reach: float, radius: np.ndarray) -> np.ndarray:
    """For each row, the first row of its component; rows are linked within ``reach`` plus both their radii.

    A row is compared with the rows that no component has yet, so memory is that of the keys.
    """
    root = np.arange(len(keys))
    left, rest = root.copy(), keys
    while len(left):
        first, ahead = left[0], [left[0]]
        left, rest = left[1:], rest[1:]
        while ahead and len(left):
            row = ahead.pop()
            distance = 1 - np.count_nonzero(rest == keys[row], axis=1) / keys.shape[1]
            close = distance <= reach + radius[row] + radius[left]
            if close.any():
                root[left[close]] = first
                ahead += left[close].tolist()
                left, rest = left[~close], rest[~close]
    return root


def _leaders(keys: np.ndarray, near: float) -> tuple[list[int], list[float]]:
    """Leaders and their radii: every row is within the radius, ``near`` at most, of one of them."""
    left, rest = np.arange(len(keys)), keys
    leaders, radii = [], []
    while len(left):
        distance = 1 - np.count_nonzero(rest == rest[0], axis=1) / keys.shape[1]
        mine = distance <= near
        leaders.append(int(left[0]))
        radii.append(float(distance[mine].max()))
        left, rest = left[~mine], rest[~mine]
    return leaders, radii


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from sorted batches; only groups with two rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key]
        change = np.asarray(pc.not_equal(keys[1:], keys[:-1]).fill_null(True), bool)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0][key][0].as_py() != keys[a].as_py():
                if len(held) > 1 or held[0].num_rows > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held and (len(held) > 1 or held[0].num_rows > 1):
        yield pa.Table.from_batches(held)


def _part_pairs(heads: DataFrame, node_members: int) -> DataFrame:
    """``heads`` with a ``spot`` for each pair of parts: two heads of a place share one, which has two parts at most."""
    parts = F.ceil(F.col("heads") / node_members).cast("int")
    counted = heads.groupBy("place").agg(F.count("*").alias("heads")).where("heads > 1").select("place", parts.alias("parts"))
    dealt = heads.join(counted, "place").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or part <> other")
    spot = F.concat_ws(":", "place", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.withColumn("spot", spot).drop("parts", "part", "other")


def candidate_links(classes: DataFrame, forest: Forest) -> DataFrame:
    """``u, v`` links whose components hold every pair at the threshold, up to the target recall."""
    distance = 1 - float(forest.threshold)
    width = 4 * forest.depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1)))
    key = F.xxhash64("tree", F.substring("keys", F.col("tree") * width + 1, F.lit(4 * forest.prefix)))
    placed = classes.select("node", "keys", tree.alias("tree")).select("node", key.alias("place"))
    shared = placed.groupBy("place").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / forest.node_members)
    met = placed.join(shared, "place").select("node", "place", F.pmod(F.xxhash64("node"), parts).alias("part"), (parts > 1).alias("split"))
    met = met.join(classes.select("node", "keys"), "node").withColumn("spot", F.concat_ws(":", "place", "part")).withColumn("radius", F.lit(0.0))
    size = forest.trees * forest.depth
    reach = distance + 2 * forest.slack

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "spot"):
            nodes = group["node"].to_pylist()
            keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint32).reshape(-1, size)
            root = _united(keys, reach, group["radius"].to_numpy())
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            heads, radii = _leaders(keys, distance) if group["split"][0].as_py() else ([], [])
            yield pa.RecordBatch.from_pydict(
                {
                    "u": pa.array([nodes[i] for i in tied] + [nodes[i] for i in heads], pa.string()),
                    "v": pa.array([nodes[root[i]] for i in tied] + [None for _ in heads], pa.string()),
                    "place": pa.array([None for _ in tied] + [group["place"][0].as_py() for _ in heads], pa.int64()),
                    "radius": pa.array([None for _ in tied] + radii, pa.float64()),
                }
            )

    def search(df: DataFrame) -> DataFrame:
        ordered = df.repartition("spot").sortWithinPartitions("spot", "keys")
        return ordered.select("spot", "place", "split", "node", "radius", "keys").mapInArrow(linked, "u string, v string, place bigint, radius double")

    # A part with one member has no group; it is its own leader.
    alone = met.where("split").groupBy("spot").agg(F.count("*").alias("c"), F.first("place").alias("place"), F.first("node").alias("node")).where("c = 1")
    found = written(search(met))
    heads = found.where("v is null").select(F.col("u").alias("node"), "place", "radius").unionByName(alone.select("node", "place", F.lit(0.0).alias("radius")))
    heads = _part_pairs(written(heads), forest.node_members).join(classes.select("node", "keys"), "node").withColumn("split", F.lit(False))
    return found.where("v is not null").select("u", "v").unionByName(search(heads).select("u", "v")).distinct()


def _tile_check(forest: Forest):
    num, den = forest.threshold.numerator, forest.threshold.denominator

    def verify(group: pa.Table) -> pa.Table:
        """Links of two tiles, or inside one: counts per set and spanning links."""
        nodes, tile = group["node"].to_pylist(), np.asarray(group["tile"])
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        copies = np.asarray(group["copies"])
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        sizes = np.array([len(s) for s in sets])
        _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        use = often[code] > 1
        order = np.argsort(code[use], kind="stable")
        code, owner = code[use][order], owner[use][order]
        if len(code):
            code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
        common = np.zeros((len(left), len(right)), np.float32)
        step = 2048
        row_left, row_right = np.full(len(sets), -1), np.full(len(sets), -1)
        row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [at, at + step])
            parts = []
            for rows, count in ((row_left, len(left)), (row_right, len(right))):
                dense = np.zeros((count, step), np.float32)
                mine = rows[owner[a:b]] >= 0
                dense[rows[owner[a:b]][mine], code[a:b][mine] - at] = 1
                parts.append(dense)
            common += parts[0] @ parts[1].T
        both = common.astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = den * both >= num * union
        if i == j:
            np.fill_diagonal(linked, False)
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, left, linked @ copies[right])
        if i != j:
            np.add.at(count, right, linked.T @ copies[left])
        a, b = np.nonzero(linked)
        root = _roots(left[a], right[b], len(nodes))
        seen = np.flatnonzero(count)
        return pa.table({"node": pa.array([nodes[k] for k in seen], pa.string()), "links": pa.array(count[seen], pa.int64()), "root": pa.array([nodes[root[k]] for k in seen], pa.string())})

    return verify


def _slot(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def _slots(keys: DataFrame, key: str) -> DataFrame:
    """The slots that ``key`` takes: SLOTS rows at most, whatever the number of keys."""
    return written(keys.select(_slot(key).alias("slot_")).distinct())


def _sifted(rows: DataFrame, key: str, slots: DataFrame, inside: bool) -> DataFrame:
    """Rows whose key takes one of the slots, or none of them; no key in the slots' table is missed."""
    placed = rows.withColumn("slot_", _slot(key))
    return placed.join(F.broadcast(slots), "slot_", "left_semi" if inside else "left_anti").drop("slot_")


def jaccard_classes(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_id, links`` for every row; see the module for what they mean."""
    rows = written(signed(docs, forest, id_col, text_col))
    classes = written(rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    members = written(star_components(candidate_links(classes, forest)).select("node", F.col("label").alias("comp")))

    # Whole sets again, for the candidates only: one document of each class.
    wanted = written(members.join(classes.drop("keys"), "node"))
    text = _sifted(inputs(docs, rep=id_col, body=text_col), "rep", _slots(wanted, "rep"), True)
    found = wanted.select("rep", "node").join(text, "rep").select("node", F.col("body").cast("string").alias("body"))

    def sets(batch: pa.RecordBatch) -> dict:
        made = []
        for at in range(0, batch.num_rows, SLICE):
            made += shingle_sets(batch["body"].slice(at, SLICE), forest.words)
        right = [len(s) > 0 and xxhash.xxh3_128_hexdigest(s.tobytes()) == node for s, node in zip(made, batch["node"].to_pylist())]
        return {"node": batch["node"], "shingles": pa.array([s.tobytes() if ok else None for s, ok in zip(made, right)], pa.binary())}

    whole = arrow_pass(found, sets, "node string, shingles binary").where("shingles is not null").groupBy("node").agg(F.first("shingles").alias("shingles"))
    need = F.greatest(F.ceil(F.sum("n") / forest.tile_shingles), F.ceil(F.count("*") / forest.tile_sets))
    tiles = written(wanted.groupBy("comp").agg(need.cast("int").alias("tiles")))
    dealt = wanted.join(tiles, "comp").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.join(whole, "node").withColumn("other", other)
    dealt = dealt.select("comp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "copies", "shingles")
    verify = _tile_check(forest)
    verified = written(dealt.groupBy("comp", "i", "j").applyInArrow(verify, "node string, links bigint, root string"))

    degree = verified.groupBy("node").agg(F.sum("links").alias("near"))
    spans = star_components(verified.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    named = classes.join(spans.select("node", "label"), "node", "left").join(degree, "node", "left")
    named = named.select("node", "rep", F.coalesce("label", "node").alias("label"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    names = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = written(named.join(names, "label").select("node", "rep", "class_id", "links"))
    out = rows.select("doc", "node").join(named, "node", "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("rep", "doc").alias("copy_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


def one_of_each_class(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names its class, once each, with all their columns; rows without an id stay.

    Most rows are neither dropped nor repeated; they pass without a shuffle.
    """
    found = jaccard_classes(docs, forest, id_col, text_col).groupBy("doc_id")
    found = found.agg(F.count("*").alias("rows_"), F.coalesce(F.max(F.col("doc_id") == F.col("class_id")), F.lit(True)).alias("keep_"))
    special = written(found.where("rows_ > 1 or not keep_").select("doc_id", "keep_"))
    own = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    rows = inputs(docs, **{v: k for k, v in own.items()})
    slots, key = _slots(special, "doc_id"), own[id_col]
    plain, looked_at = _sifted(rows, key, slots, False), _sifted(rows, key, slots, True)
    looked_at = looked_at.join(special, looked_at[key].eqNullSafe(special["doc_id"]), "left")
    single = looked_at.where("keep_ is null").select(*own.values())
    repeated = looked_at.where("keep_").select(*own.values()).dropDuplicates([key, own[text_col]])
    kept = plain.unionByName(single).unionByName(repeated)
    return kept.select(*[F.col(v).alias(k) for k, v in own.items()])

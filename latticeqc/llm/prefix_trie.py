"""Prefix trie of conversations by fixed-length block hashing.

Conversations that begin with the same turns share nodes. Turns are digested once; ``block_turns`` turns make a block, and
the digest of a block chain names all turns up to the block's end. Conversations are grouped by the digests of successive
blocks first, so that a thousand equal beginnings become one row. A block that every conversation of its parent goes on with
(``straight``) is a path without branches: its turns are nodes with the counts of the block. Only where the blocks below a parent
diverge, or a conversation ends, are the distinct blocks cut at each turn and grouped again (``refined``).

Subtree sums go over chains: a node belongs to the chain of its smallest conversation, so a chain is one path. Totals of
chains are added up their ancestors by doubling (rounds grow with the logarithm of how deep chains hang on each other), and one
running sum along each chain gives the sums of its nodes.

Rows without a conversation id are left out; a null role or text is empty. Turns are ordered by ``turn`` (null first), equal ones
by the digest of role and text; repeated rows are repeated turns. Texts of any length are digested whole and leave the plan
at once. Other columns are ignored. An empty table gives no nodes. Chain digests have 128 bits; two different beginnings
are taken for one another with a chance of about n * n / 2**129 for n nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import inputs, lookup, scanned, written
from latticeqc.operators.ordering import with_global_position

BLOCK_TURNS = 4
#: Ids that are joined to one piece of text before a node's list of ids is hashed.
ID_CHUNK = 1024
NODE = ("depth", "a", "b")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, turn_hash, n_bytes``: turns in order, places from 0."""
    rows = inputs(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = rows.select(
        F.col("conv_id").cast("bigint"), "turn", F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("turn_hash"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    placed = with_global_position(slim, ["turn", "turn_hash"], keys=["conv_id"])
    return written(placed.select("conv_id", F.col("pos").alias("place"), "turn_hash", "n_bytes"))


def share_beginnings(turns: DataFrame, base: Callable[[Column], Column], shared: Callable[[Column], Column], family: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as the first ``shared(c)`` turns of conversation ``base(c)`` and their own turns after as many.

    ``family`` lists the distances at which conversations of one base may lie from it. Gives the turns and the ids of all conversations.
    """
    c = F.col("conv_id")
    ids = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = ids.select("conv_id", base(c).alias("base")).join(sizes, "base", "left")
    # Own turns move up where the base has fewer turns than are shared.
    moves = written(known.select("conv_id", (F.least(shared(c), F.coalesce("base_n", F.lit(0))) - shared(c)).cast("bigint").alias("move")))
    own = lookup(turns.where((F.col("place") >= shared(c)) | (base(c) == c)), moves, ["conv_id"])
    own = own.withColumn("place", F.when(base(c) == c, F.col("place")).otherwise(F.col("place") + F.col("move"))).drop("move")
    near = F.explode(F.array(*[F.expr(f"try_add(conv_id, {step}L)") for step in family if step]))
    given = turns.where(base(c) == c).select(c.alias("from_"), near.alias("conv_id"), "place", "turn_hash", "n_bytes")
    given = given.where((base(c) == F.col("from_")) & (F.col("place") < shared(c))).drop("from_").join(ids.select("conv_id"), "conv_id", "left_semi")
    return own.unionByName(given), ids.select("conv_id")


def _lane(number: int, turns: Column) -> Column:
    return F.xxhash64(F.lit(number), F.col("block"), turns)


def conversation_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, block, hashes, bytes, a, b, pa, pb``: each conversation's blocks, the digest of the chain up to it and before it."""
    turn = F.struct("place", "turn_hash", "n_bytes")
    cut = turns.withColumn("block", F.floor(F.col("place") / block_turns)).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lanes = cut.select("conv_id", "block", F.col("turns.turn_hash").alias("hashes"), F.col("turns.n_bytes").alias("bytes"))
    lanes = written(lanes.withColumns({"la": _lane(1, F.col("hashes")), "lb": _lane(2, F.col("hashes"))}))
    xor = lambda x, y: x.bitwiseXOR(y)
    chained = scanned(lanes, ["conv_id"], "block", {"a": "la", "b": "lb"}, F.bit_xor, xor)
    return written(chained.withColumns({"pa": xor(F.col("a"), F.col("la")), "pb": xor(F.col("b"), F.col("lb"))}).drop("la", "lb"))


def straight_blocks(blocks: DataFrame, n_convs: DataFrame) -> DataFrame:
    """``block, a, b`` of the blocks that all conversations of their parent go on with."""
    kid = F.struct("a", "b")
    none = F.lit(None)
    held = blocks.select("block", "a", "b", F.col("n").alias("held"), none.cast("bigint").alias("kid_n"), none.cast("struct<a:bigint,b:bigint>").alias("kid"))
    root = n_convs.select(F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("n").alias("held"), none.cast("bigint").alias("kid_n"), none.cast("struct<a:bigint,b:bigint>").alias("kid"))
    below = blocks.select((F.col("block") - 1).alias("block"), F.col("pa").alias("a"), F.col("pb").alias("b"), none.cast("bigint").alias("held"), F.col("n").alias("kid_n"), kid.alias("kid"))
    parents = held.unionByName(root).unionByName(below).groupBy("block", "a", "b").agg(F.max("held").alias("held"), F.count("kid").alias("kids"), F.max("kid_n").alias("kid_n"), F.max("kid").alias("kid"))
    return parents.where("kids = 1 AND held = kid_n").select((F.col("block") + 1).alias("block"), "kid.a", "kid.b")


def trie_nodes(blocks: DataFrame, ids: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``depth, a, b, pa, pb, conv_id, n_convs, n_bytes``: one row per node, the root with depth 0 and digest (0, 0)."""
    distinct = written(
        blocks.groupBy("block", "a", "b", "pa", "pb").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("hashes").alias("hashes"), F.any_value("bytes").alias("bytes")
        )
    )
    total = ids.agg(F.count("*").alias("n"))
    straight = straight_blocks(distinct, total).withColumn("straight", F.lit(True))
    told = written(distinct.join(straight, ["block", "a", "b"], "left"))
    upto = [
        F.when(
            F.size("hashes") >= i,
            F.struct(
                (F.col("block") * block_turns + i).alias("depth"),
                *[F.col(p).bitwiseXOR(_lane(k, F.slice("hashes", 1, i))).alias(n) for k, p, n in ((1, "pa", "a"), (2, "pb", "b"))],
                *[(F.col(p).bitwiseXOR(_lane(k, F.slice("hashes", 1, i - 1))) if i > 1 else F.col(p)).alias(p) for k, p in ((1, "pa"), (2, "pb"))],
                F.get("bytes", F.lit(i - 1)).alias("n_bytes"),
            ),
        )
        for i in range(1, block_turns + 1)
    ]
    cut = told.select("straight", "conv_id", F.col("n").alias("n_convs"), F.explode(F.array_compact(F.array(*upto))).alias("node")).select("straight", "conv_id", "n_convs", "node.*")
    refined = cut.where("straight IS NULL").groupBy("depth", "a", "b", "pa", "pb", "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    zero = F.lit(0).cast("bigint")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("depth", "a", "b", "n_bytes")], *[F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb")], "conv_id", "n_convs")
    return written(cut.where("straight").drop("straight").unionByName(refined).unionByName(root))


def end_nodes(blocks: DataFrame, ids: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, depth, a, b``: the node at which each conversation ends."""
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", F.size("hashes").alias("size"), "a", "b")).alias("last"))
    depth = F.coalesce(F.col("last.block") * block_turns + F.col("last.size"), F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return ids.join(last, "conv_id", "left").select("conv_id", depth.alias("depth"), F.coalesce("last.a", zero).alias("a"), F.coalesce("last.b", zero).alias("b"))


def id_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the comma-joined ascending ids that end at a node.

    Ids are joined in chunks of ID_CHUNK numbers first; the hash reads the chunks of a node in order and keeps only its state.
    """
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*NODE, F.expr(f"conv_id div {ID_CHUNK}").alias("chunk")).agg(texts.alias("ids"))
    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def row(done: list) -> pa.RecordBatch:
            values = list(zip(*done))
            return pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in values[:3]], pa.array(values[3], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            for *node, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")]):
                if node != at:
                    if state is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield row(done)
        if state is not None:
            yield row([(*at, state.hexdigest())])

    return dealt.mapInArrow(hashed, "depth bigint, a bigint, b bigint, ends_sha256 string")


def chain_totals(chains: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``chain`` and the sums of each chain and all chains below it; ``up`` is the chain that it hangs on."""
    now = written(chains)
    while not now.where("up IS NOT NULL").isEmpty():
        added = now.where("up IS NOT NULL").groupBy(F.col("up").alias("chain")).agg(*[F.sum(c).alias(f"{c}_added") for c in sums])
        ups = now.select(F.col("chain").alias("up"), F.col("up").alias("next_up"))
        far = lookup(now.where("up IS NOT NULL"), ups, ["up"]).unionByName(now.where("up IS NULL").withColumn("next_up", F.lit(None).cast("bigint")))
        joined = far.join(added, "chain", "left")
        now = written(joined.select("chain", F.col("next_up").alias("up"), *[(F.col(c) + F.coalesce(f"{c}_added", F.lit(0))).alias(c) for c in sums]))
    return now


def build_trie(turns: DataFrame, ids: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie over ``turns`` (``conv_id, place, turn_hash, n_bytes``; places from 0) of all ``ids``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (bytes stored once instead of once per member, over the subtree), ``ends_sha256``.
    """
    blocks = conversation_blocks(turns, block_turns)
    nodes = trie_nodes(blocks, ids, block_turns)
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    counted = written(nodes.join(children, list(NODE), "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    counted = counted.withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    parents = nodes.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    told = written(lookup(counted.withColumn("pd", F.col("depth") - 1), parents, ["pd", "pa", "pb"]))
    sums = ("leaf", "saved")
    chains = told.groupBy(F.col("conv_id").alias("chain")).agg(F.min(F.struct("depth", "parent_conv_id")).alias("top"), *[F.sum(c).alias(c) for c in sums])
    chains = written(chains.select("chain", F.col("top.parent_conv_id").alias("up"), (F.col("top.depth") - 1).alias("depth"), *sums))
    totals = chain_totals(chains.select("chain", "up", *sums), sums)
    hung = chains.select("chain", F.col("up").alias("conv_id"), "depth").where("conv_id IS NOT NULL").join(totals.select("chain", *sums), "chain")
    hung = hung.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(f"{c}_hung") for c in sums])
    weighed = told.join(hung, ["conv_id", "depth"], "left")
    weighed = written(weighed.withColumns({c: F.col(c) + F.coalesce(f"{c}_hung", F.lit(0)) for c in sums}))
    summed = scanned(weighed, ["conv_id"], "depth", {"n_leaves": "leaf", "saved_tokens": "saved"}, reverse=True)
    digests = written(id_digests(end_nodes(blocks, ids, block_turns)))
    out = summed.join(digests, list(NODE), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))

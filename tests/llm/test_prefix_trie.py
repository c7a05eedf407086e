"""The prefix trie against plain Python over every prefix, and its corner cases."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from latticeqc.llm import prefix_trie
from latticeqc.llm.common import lookup, scanned
from latticeqc.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """Conversations of the query: (conv_id, turn, role, text) to lists of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = (own.get(c - c % 5, [])[:h] if c % 5 else turns[:h]) + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].encode()) if path else 0
    rows = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(path))
        rows.append((who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def run(spark, rows, tmp_path, extra=""):
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(rows, schema)
    if extra:
        frame = frame.selectExpr("*", "1 AS place", "'x' AS turn_hash", "2 AS n", "3 AS base", "4 AS depth")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op11_prefix_trie"](spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))


def test_corner_cases(spark, tmp_path):
    rows = [(None, 1, "a", "left out")]
    for c in range(40):
        for t in range(c % 13):
            rows.append((c, None if t == 0 else t, None if t == 2 else "user", None if t == 3 else ["same", "é" * 3, "long " * 2000][t % 3 if c % 4 else 0]))
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (-7, 1, "user", "negative"), (10_003, 0, "user", "no base"), (20_000, 5, "user", "same")]
    assert run(spark, rows, tmp_path, "clash") == brute(rebuilt(rows))


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("block", [1, 3, 8])
def test_block_sizes_give_the_same_trie(spark, block):
    """Long shared beginnings that fork inside and between blocks, nested many levels deep."""
    convs = {c: [("u", f"{min(c, d) if d > 2 * c else d}") for d in range(3 * (c % 7) + c)] for c in range(1, 25)}
    turns = [(c, p, hashlib.md5(str(t).encode()).digest(), len(t[1])) for c, ts in convs.items() for p, t in enumerate(ts)]
    frame = spark.createDataFrame(turns, "conv_id long, place long, turn_hash binary, n_bytes long")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = prefix_trie.build_trie(frame, ids, block).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(convs)


def test_hot_keys_and_long_groups(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 30_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup(rows, table, ["k"])
    assert got.count() == 30_000 and got.where("coalesce(v, -1) <> CASE WHEN k % 2 = 0 THEN 2 * k ELSE -1 END").isEmpty()
    for reverse in (False, True):
        sums = scanned(rows.withColumn("w", F.col("id") % 5), ["k"], "id", {"s": "w"}, reverse=reverse, run=64)
        last = {r.id: r.s for r in sums.where("k = 0").collect()}
        order = sorted(last, reverse=reverse)
        total = 0
        for i in order:
            total += i % 5
            assert last[i] == total

"""The forest join against brute-force Jaccard, planted copies and corner cases."""

import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest

from latticeqc.llm.minhash_forest import Forest, _leaders, _part_pairs, _united, candidate_links, jaccard_classes, one_of_each_class, signed


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(texts):
    """Links and components by comparing every pair."""
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    links = dict.fromkeys(texts, 0)

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    by = {}
    for k, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(k)
    for k, s in sets.items():
        for other in {o for g in s for o in by[g] if o > k}:
            both = len(s & sets[other])
            if 5 * both >= 4 * (len(s) + len(sets[other]) - both):
                links[k] += 1
                links[other] += 1
                a, b = sorted((top(k), top(other)))
                label[b] = a
    return {k: (top(k), links[k]) for k in texts}


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = {}
    for k in range(90):
        copy = list(words)
        for at in rng.sample(range(300), rng.randrange(0, 9)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(copy)
    texts |= {k: texts[0] for k in range(90, 130)}
    texts |= {130: None, 131: "", 132: " \n", 133: "a b", 134: "A  b", 135: "a b c", 136: " ".join(words[:150]), 137: "z " * 40_000, 138: "z " * 30_000}
    return texts


@pytest.mark.parametrize("forest", [Forest(), Forest(node_members=8, tile_shingles=3000)], ids=["plain", "split"])
def test_planted_near_copies(spark, forest):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, "n") for k, t in texts.items()], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_classes(docs, forest).collect()}
    assert got == brute(texts)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_classes(docs).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()})


def test_one_of_each_class_keeps_columns_and_handles_empty_input(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "p"), (1, "a b c d e f", "q"), (1, "a b c d e f", "q"), (3, None, None), (4, "", "s")], "doc_id long, text string, node string")
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert one_of_each_class(docs.where("false")).count() == 0


def boilerplate(groups=400, seed=11):
    """Texts that share half of their words and are otherwise different, some with a near copy far down the table."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(104)]
    texts = {k: " ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(100)]) for k in range(groups)}
    return texts | {groups + k: texts[k] + " tail" for k in range(0, groups, 10)}


def test_large_nodes_of_shared_boilerplate_stay_bounded_and_whole(spark):
    forest, texts = Forest(node_members=6), boilerplate()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = signed(docs, forest, "doc_id", "text")
    classes = rows.select("node", "n", "keys").distinct()
    node = {r.node: r.doc for r in rows.select("node", "doc").collect()}
    links = [sorted((node[r.u] % 400, node[r.v] % 400)) for r in candidate_links(classes, forest).collect()]
    assert links and all(a == b for a, b in links)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_classes(docs, forest).collect()}
    assert got == brute(texts)


def test_heads_of_a_place_meet_in_pairs_of_bounded_parts(spark):
    heads = spark.range(300).selectExpr("cast(id as string) node", "id div 200 place", "0D radius")
    spots = {}
    for r in _part_pairs(heads, 20).collect():
        spots.setdefault(r.spot, set()).add(int(r.node))
    assert max(map(len, spots.values())) <= 70
    met = {(a, b) for s in spots.values() for a in s for b in s}
    assert met == {(a, b) for a in range(300) for b in range(300) if a // 200 == b // 200}


def test_links_of_one_group_need_no_pair_lists():
    keys = np.random.default_rng(3).integers(0, 2**32, (3000, 128), dtype=np.uint32)
    keys[:, :60] = keys[0, :60]
    tracemalloc.start()
    assert (_united(keys, 0.6, np.zeros(3000)) == 0).all()
    assert (_united(keys, 0.4, np.zeros(3000)) == np.arange(3000)).all()
    assert len(_leaders(keys, 0.2)[0]) == 3000
    assert tracemalloc.get_traced_memory()[1] < 8 * keys.nbytes
    tracemalloc.stop()


def test_a_recall_out_of_reach_is_an_error():
    assert Forest().prefix == 4 and Forest(threshold=Fraction(2, 5)).prefix == 1
    with pytest.raises(ValueError):
        Forest(threshold=Fraction(3, 10)).prefix

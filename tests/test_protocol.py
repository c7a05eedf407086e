"""Leaves of nested documents and what keeps a run from a frozen protocol."""

import json

from latticeqc.plans.protocol import path_values, protocol_differences, protocol_findings

DOC = {
    "schema_version": "v1", "source": {"selected_patch_ids_sha256": "abc"}, "frozen_detector": {"configuration": {"deep": {"a": [1, {"b": 0.5}]}, "off": None}},
    "protocol": {"normal_offsets_voxels": [4, 8], "transition_widths_cells": [1], "annotation_neighborhood_radius_cells": 3},
    "split": {"development_ids": ["p1"], "development_related_excluded_ids": ["p2"], "clean_holdout_pool_ids": ["p3"], "selected_holdout_ids": ["p3"]},
}


def docs(spark, *rows):
    return spark.createDataFrame([(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in rows], "k int, raw_json string")


def leaves(spark, text, depth=8):
    return {r["path"]: r["value"] for r in path_values(docs(spark, (1, text)), ["k"], depth=depth).collect()}


def test_every_leaf_has_a_path(spark):
    text = '{"b": {"y": [], "x": [1, {"z": {}}]}, "a": null, "c.d": "t", "n": 4.0, "m": 0.50, "l": 9007199254740993}'
    every = {"$.a": "null", "$.b.x[0]": "1", "$.b.x[1].z": "{}", "$.b.y": "[]", "$.c.d": '"t"', "$.n": "4", "$.m": "0.5", "$.l": "9007199254740993"}
    assert leaves(spark, text) == every
    assert leaves(spark, text, depth=1) == {**{p: v for p, v in every.items() if "$.b" not in p}, "$.b": '{"x":[1,{"z":{}}],"y":[]}'}
    assert leaves(spark, "4e0") == {"$": "4"} and leaves(spark, "{oops") == {"$": None} == leaves(spark, None)
    assert path_values(docs(spark, (1, "1")).where("false"), ["k"]).count() == 0


def test_differences_name_their_paths(spark):
    a, b = (path_values(docs(spark, (1, text)), ["k"]) for text in ('{"a": [1, 2], "b": {"c": 1.0}}', '{"b": {"c": 1}, "a": [1, 3, 4]}'))
    assert sorted((r["path"], r["frozen"], r["seen"]) for r in protocol_differences(a, b, ["k"]).collect()) == [("$.a[1]", "2", "3"), ("$.a[2]", None, "4")]


def changed(*path, to):
    doc = json.loads(json.dumps(DOC))
    at = doc
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = to
    return doc


def test_each_rule_fires(spark):
    own = {
        1: (DOC, DOC, set()),
        2: (DOC, changed("source", "selected_patch_ids_sha256", to="abd"), {("ids-differ", 1)}),
        3: (DOC, changed("frozen_detector", "configuration", "deep", "a", to=[1, {"b": 0.5, "c": 1}]), {("configuration-differs", 1)}),
        4: (DOC, changed("protocol", "normal_offsets_voxels", to=[8, 4]), {("offsets-differ", 2)}),
        5: (DOC, changed("protocol", "transition_widths_cells", to=[]), {("widths-differ", 2)}),
        6: (DOC, changed("protocol", "annotation_neighborhood_radius_cells", to=2), {("radius-differs", 1)}),
        7: (changed("schema_version", to="v0"), DOC, {("unsupported-schema", 1)}),
        8: (changed("split", "selected_holdout_ids", to=["p1", "p1", "p3"]), DOC, {("development-in-holdout", 1)}),
        9: (changed("split", "clean_holdout_pool_ids", to=["p1", "p2", "p3"]), DOC, {("component-leaks", 2)}),
        10: (DOC, changed("split", "development_ids", to=["p3"]), set()),
        11: (DOC, "{oops", {("ids-differ", 1), ("configuration-differs", 3), ("offsets-differ", 2), ("widths-differ", 1), ("radius-differs", 1)}),
        12: (None, changed("schema_version", to="v1"), {("ids-differ", 1), ("configuration-differs", 3), ("offsets-differ", 2), ("widths-differ", 1), ("radius-differs", 1), ("unsupported-schema", 1)}),
    }
    found = protocol_findings(docs(spark, *[(k, v[0]) for k, v in own.items()]), docs(spark, *[(k, v[1]) for k, v in own.items()]), ["k"], "v1").collect()
    assert {k: {(r["code"], r["n"]) for r in found if r["k"] == k} for k in own} == {k: v[2] for k, v in own.items()}


def test_equal_parts_are_not_taken_apart(spark, monkeypatch):
    from latticeqc.plans import protocol

    taken = []
    monkeypatch.setattr(protocol, "_leaves", lambda level, keys, depth, real=protocol._leaves: taken.append(level.select("k", "path").collect()) or real(level, keys, depth))
    own = docs(spark, *[(k, DOC) for k in range(5)], (5, changed("protocol", "normal_offsets_voxels", to=[4, 9])))
    found = protocol_findings(docs(spark, *[(k, DOC) for k in range(6)]), own, ["k"], "v1").collect()
    assert [tuple(r) for r in found] == [(5, "offsets-differ", 1)]
    assert [[tuple(r) for r in rows] for rows in taken] == [[(5, "$.protocol.normal_offsets_voxels")]] * 2


def test_repeated_and_null_keys(spark):
    leaks = [changed("split", "development_ids", to=[4, [1]]), changed("split", "clean_holdout_pool_ids", to=[4.0, [1]])]
    frozen = docs(spark, (1, DOC), (1, changed("protocol", "normal_offsets_voxels", to=[4, 9])), (2, leaks[0]), (2, leaks[1]), (None, leaks[0]), (None, leaks[1]))
    seen = docs(spark, (1, DOC), (1, DOC), (2, DOC), (None, DOC))
    got = {(r["k"], r["code"]): r["n"] for r in protocol_findings(frozen, seen, ["k"], "v1").collect()}
    assert got[1, "offsets-differ"] == 2 and got[2, "component-leaks"] == 1 == got[None, "component-leaks"]
    assert got[None, "radius-differs"] == 3 and got[None, "offsets-differ"] == 6 and (2, "radius-differs") not in got


def test_ids_of_every_kind_meet(spark):
    lists = {1: ([4], [4.0], 1), 2: (["4"], [4], 0), 3: ([-1.5, True, None], [None, True, -15e-1, "true"], 3), 4: (["p", {}], [{}, [], {"a": 1}], 1), 5: (["a"], "a", 0), 6: ([1e20], [100000000000000000000], 1)}
    rows = [(k, {"schema_version": "v1", "split": {"development_ids": a, "selected_holdout_ids": b}}) for k, (a, b, _) in lists.items()]
    whole = [(k + 10, {**d, "split": {**d["split"], "development_related_excluded_ids": [], "clean_holdout_pool_ids": d["split"]["selected_holdout_ids"]}}) for k, d in rows]
    found = protocol_findings(docs(spark, *rows, *whole), docs(spark, *rows, *whole), ["k"], "v1").collect()
    assert {(r["k"], r["code"]): r["n"] for r in found} == {
        (k + at, code): n for k, (_, _, n) in lists.items() for at, code in ((0, "development-in-holdout"), (10, "development-in-holdout"), (10, "component-leaks")) if n
    }

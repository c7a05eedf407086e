import json
import struct

import numpy as np
import pytest

from latticeqc.functions.numeric import above, edge_score, is_finite, nan_min, np_div
from latticeqc.operators import contract as C
from latticeqc.plans.contract_report import root_findings
from latticeqc.plans.folders import load_folder, review_folder, scan_folder
from latticeqc.plans.scoring import cluster_bootstrap
from latticeqc.plans.perturbation import averaged_normals, choose_seam, offset_ladder
from latticeqc.session import materialize
from latticeqc.sources import rasters
from tests.grids import flat, frame, surface


def test_ieee_rules(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        np_div(F.lit(1.0), F.lit(0.0)).alias("inf"), np_div(F.lit(0.0), F.lit(0.0)).alias("nan"), np_div(F.lit(3.0), F.lit(2.0)).alias("q"),
        above(F.lit(float("nan")), 2.0).alias("a"), is_finite(F.lit(float("nan"))).alias("f"), nan_min(F.lit(float("nan")), F.lit(1.0)).alias("m"),
        edge_score(F.lit(0.0)).alias("s0"), edge_score(F.lit(float("nan"))).alias("sn"), edge_score(F.lit(2.0)).alias("s2"), edge_score(F.lit(float("inf"))).alias("si"),
    ).first()
    assert row["inf"] == float("inf") and np.isnan(row["nan"]) and row["q"] == 1.5
    assert row["a"] is False and row["f"] is False and np.isnan(row["m"])
    assert (row["s0"], row["sn"], row["s2"], row["si"]) == (1.0, 0.0, 0.5, 1.0)


def codes_of(spark, text):
    meta = spark.createDataFrame([(1, text)], "package_id bigint, raw_json string")
    return {r["code"]: r["count"] for r in C.metadata_findings(meta).collect()}


GOOD = {"uuid": "u", "format": "tifxyz", "type": "seg", "scale": [1.0, 1.0]}


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, set()),
        ({"uuid": " "}, {"metadata-uuid-invalid"}),
        ({"scale": [True, 1]}, {"metadata-scale-invalid"}),
        ({"scale": ["2", 1]}, {"metadata-scale-invalid"}),
        ({"bbox": [[0, 0, 0], [1, 1]]}, {"metadata-bbox-invalid"}),
        ({"bbox": [[0, 0, 0], [1, 1, 1]]}, set()),
        ({"area": "x"}, {"metadata-area-invalid"}),
        ({"area_vx2": 1.0}, {"metadata-area-schema-divergence"}),
        ({"format": None}, {"metadata-format-nonstandard"}),
    ],
)
def test_metadata_rules(spark, change, expected):
    assert set(codes_of(spark, json.dumps({**GOOD, **change}))) == expected


def test_nonfinite_tokens_are_counted_outside_strings(spark):
    text = json.dumps({**GOOD, "note": "NaN \" -Infinity", "deep": {"a": [float("nan"), float("-inf")]}})
    assert codes_of(spark, text) == {"metadata-nonfinite-number": 2}


def write_package(folder, z, meta=GOOD, mask=None):
    folder.mkdir(parents=True)
    rows, cols = np.indices(z.shape).astype("float32")
    for name, plane in (("x", cols), ("y", rows), ("z", z.astype("float32"))):
        (folder / f"{name}.tif").write_bytes(rasters.encode_strip(plane))
    if mask is not None:
        (folder / "mask.tif").write_bytes(rasters.encode_strip(mask))
    (folder / "meta.json").write_text(json.dumps(meta))


def test_scan_of_written_packages(spark, tmp_path):
    z = np.full((3, 4), 10.0)
    write_package(tmp_path / "clean", z, {**GOOD, "uuid": "same"})
    write_package(tmp_path / "again", z, {**GOOD, "uuid": "same"})
    mask = np.full((6, 8), 255, dtype="uint8")
    mask[0, 0] = 0
    write_package(tmp_path / "double", z, mask=mask)
    write_package(tmp_path / "broken", z)
    (tmp_path / "broken" / "y.tif").write_bytes(b"nothing")
    write_package(tmp_path / "partial", z)
    (tmp_path / "partial" / "x.tif").unlink()

    scan = scan_folder(spark, str(tmp_path))
    status = {r["package_id"].rsplit("/", 1)[1]: r["status"] for r in scan.report.status.collect()}
    assert status == {"clean": "pass", "again": "pass", "double": "error", "broken": "error", "partial": "error"}
    found = {(r["package_id"].rsplit("/", 1)[1], r["code"]) for r in scan.report.findings.collect()}
    assert {("broken", "tiff-unreadable"), ("partial", "missing-required-file"), ("double", "mask-shape-python-incompatible")} <= found
    facts = {r["package_id"].rsplit("/", 1)[1]: r for r in scan.report.facts.collect()}
    assert (facts["clean"]["vertex_count"], facts["clean"]["face_count"]) == (12, 6)
    assert (facts["double"]["python_valid_count"], facts["double"]["cpp_finite_count"]) == (12, 11)
    repeated = scan.collection_findings.where("code = 'duplicate-uuid'").first()
    assert (repeated["uuid"], repeated["count"]) == ("same", 2)
    surf = load_folder(spark, str(tmp_path))
    loaded = {r["package_id"].rsplit("/", 1)[1]: (r["n"], r["v"]) for r in surf.groupBy("package_id").agg({"valid": "count", "z": "min"}).toDF("package_id", "n", "v").collect()}
    assert loaded == {"clean": (12, 10.0), "again": (12, 10.0), "double": (12, 10.0)}
    review = review_folder(spark, str(tmp_path))
    assert {r["valid_quads"] for r in review.summary.collect()} == {6}


def test_scan_of_a_file_or_nothing(spark, tmp_path):
    (tmp_path / "plain").write_text("x")
    for root in (tmp_path / "plain", tmp_path / "nowhere"):
        scan = scan_folder(spark, str(root))
        assert [r["code"] for r in scan.collection_findings.collect()] == ["scan-root-not-directory"] and scan.report.status.count() == 0
    (tmp_path / "empty").mkdir()
    assert [r["code"] for r in scan_folder(spark, str(tmp_path / "empty")).collection_findings.collect()] == ["no-tifxyz-directories"]


def test_rasters_are_sent_in_slices(spark):
    plane = np.arange(35, dtype="float32").reshape(5, 7)
    files = spark.createDataFrame([("dir/a", "x", rasters.encode_strip(plane)), ("dir/b", "x", b"no")], "package_id string, channel string, content binary")
    rows = rasters.ingest_rasters(files, slice_rows=8)
    facts = {r["package_id"]: (r["readable"], r["height"], r["width"]) for r in rasters.channel_table(rows).collect()}
    assert facts == {"dir/a": (True, 5, 7), "dir/b": (False, None, None)}
    assert {(r["row"], r["col"]): r["value"] for r in rows.where("row IS NOT NULL").collect()} == {(i, j): plane[i, j] for i in range(5) for j in range(7)}


def stripped(plane, order, rows, big=False, magic=None, following=None):
    """A TIFF of ``plane`` in strips of ``rows`` rows that lie backwards in the file."""
    place, count = ("Q", "Q") if big else ("I", "H")
    parts = [plane[at : at + rows].astype(plane.dtype.newbyteorder(order)).tobytes() for at in range(0, len(plane), rows)]
    body, at, places = b"", 16, []
    for part in reversed(parts):
        places.insert(0, at + len(body))
        body += part
    width = struct.calcsize(place)
    lists = [struct.pack(f"{order}{len(parts)}{place}", *v) for v in (places, [len(p) for p in parts])]
    ends = [at + len(body), at + len(body) + len(lists[0])]
    code = 16 if big else 4
    fields = [(256, 4, 1, plane.shape[1]), (257, 4, 1, plane.shape[0]), (258, 4, 1, 8 * plane.dtype.itemsize), (259, 4, 1, 1), (339, 4, 1, 3)]
    fields += [(tag, code, len(parts), v[0] if len(v) == 1 else end) for tag, v, end in ((273, places, ends[0]), (279, [len(p) for p in parts], ends[1]))]
    where = at + len(body) + sum(map(len, lists))
    tags = b"".join(struct.pack(f"{order}HH{place}", t, c, n) + struct.pack(order + ("I" if c == 4 else "Q"), v).ljust(width, b"\0") for t, c, n, v in fields)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", magic or (43 if big else 42)) + (struct.pack(order + "HHQ", 8, 0, where) if big else struct.pack(order + "I", where)).ljust(12, b"\0")
    return head + body + b"".join(lists) + struct.pack(order + count, len(fields)) + tags + struct.pack(order + place, where if following else 0)


def test_rasters_are_read_by_ranges(spark, tmp_path):
    plane = np.arange(35, dtype="float32").reshape(5, 7)
    made = {
        "little": stripped(plane, "<", 2), "big end": stripped(plane, ">", 1), "wide": stripped(plane, "<", 2, big=True), "wide%20one": stripped(plane, ">", 5, big=True), "one": rasters.encode_strip(plane),
        "odd": stripped(plane, "<", 2, magic=44), "circle": stripped(plane, "<", 2, following=True), "short": rasters.encode_strip(plane)[:-90], "no": b"no", "empty": b"",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    listed = [(name, "x", f"file:{tmp_path / name}", len(content), "extra") for name, content in made.items()] + [("null", "x", None, None, "extra")]
    files = spark.createDataFrame(listed, "package_id string, channel string, path string, bytes long, first string")
    found = rasters.ingest_raster_files(files, slice_rows=8, piece_bytes=48)
    whole = rasters.ingest_rasters(spark.createDataFrame([(n, "x", c) for n, c in made.items()], "package_id string, channel string, content binary"))
    assert found.schema == whole.schema
    facts = {r["package_id"]: r for r in rasters.channel_table(found).collect()}
    sound = {"little", "big end", "wide", "wide%20one", "one"}
    assert {n for n, r in facts.items() if r["readable"]} == sound and len(facts) == len(listed)
    assert {r["package_id"] for r in rasters.channel_table(whole).where("readable").collect()} == sound
    assert all((r["dtype"], r["frames"], r["ndim"], r["height"], r["width"]) == ("float32", 1, 2, 5, 7) for n, r in facts.items() if n in sound)
    samples = found.where("row IS NOT NULL").collect()
    assert sorted((r["package_id"], r["row"], r["col"], r["value"]) for r in samples) == sorted((n, i, j, plane[i, j]) for n in sound for i in range(5) for j in range(7))
    # 140 bytes in pieces of 48 are three pieces, whatever the strips.
    assert [[(r["at"], r["size"]) for r in p] for p in rasters.pieces((10, 200), (30, 40), 48)] == [[(10, 30), (200, 18)], [(218, 22)]]
    with pytest.raises(ValueError):
        rasters.ingest_raster_files(files, piece_bytes=20)


def test_bootstrap_repeats_and_stays_in_range(spark):
    units = spark.createDataFrame([("g", f"u{i}", float(i % 2), 1.0) for i in range(20)], "g string, unit string, num double, den double")
    first, second = (cluster_bootstrap(u, ["g"], "unit", "s", 250).first() for u in (units, units.repartition(6)))
    assert first == second and 0 <= first["low"] <= first["estimate"] <= first["high"] <= 1


def test_null_case_is_exact_and_step_moves_one_side(spark):
    surf = frame(spark, surface("p", 24, 28, lambda r, c: (c, r, 20)))
    normals = materialize(averaged_normals(surf))
    seam = choose_seam(normals)
    line = seam.first()
    # A row line has 27 cells, a column line 23; rows 6 to 18 are central.
    assert (line["orientation"], line["seam"], line["support"]) == ("horizontal", 6, 27)
    cases = offset_ladder(normals, seam, [16.0], [1])
    assert cases.where("offset_voxels = 0 AND (z <> 20 OR x <> col OR y <> row)").count() == 0
    moved = cases.where("offset_voxels = 16 AND abs(z - 20) > 1")
    assert moved.agg({"row": "min"}).first()[0] == 6 and moved.count() == 18 * 28


def test_reader_matrix(spark):
    """5 x 5 grid: half-open export of an all-valid grid and of one without its centre."""
    from latticeqc.operators.project import halfopen_counts

    surf = frame(spark, surface("all", 5, 5, flat), surface("centre", 5, 5, flat, invalid={(2, 2)}))
    got = {r["package_id"]: (r["vertices"], r["faces"]) for r in halfopen_counts(surf, "valid").collect()}
    assert got == {"all": (16, 18), "centre": (12, 10)}


def test_missing_scan_root_is_an_error(spark, tmp_path):
    assert root_findings(spark, str(tmp_path)).count() == 0
    (tmp_path / "file").write_text("")
    assert root_findings(spark, str(tmp_path / "file")).first()["code"] == "scan-root-not-directory"
    assert root_findings(spark, str(tmp_path / "nowhere")).first()["code"] == "scan-root-not-directory"


def test_long_strings_and_repeated_keys(spark):
    assert codes_of(spark, json.dumps({**GOOD, "note": "x\\\" NaN " * 130_000})) == {}
    assert codes_of(spark, '{"uuid":"u","uuid":" ","format":"tifxyz","type":"seg","scale":[1.0,1.0]}') == {"metadata-uuid-invalid": None}
    assert codes_of(spark, '{"uuid":" ","uuid":"u","format":"tifxyz","type":"seg","scale":[1.0,1.0]}') == {}

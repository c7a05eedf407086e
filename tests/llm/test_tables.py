"""Mixing, URL rules, separator scan and the pipeline: against SQL, plain Python and planted cases."""

import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from latticeqc.llm import mixing, queries, separator_scan, url_rules
from latticeqc.llm.queries import ORACLES, PIPELINE_TARGETS, QUERIES, domain, levels
from tests.llm.test_near_copies import brute as brute_classes
from tests.llm.test_text_ops import brute_counts

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_source_mixing", "op9_separator_scan"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def mixed(docs, weights, **settings):
    plan = mixing.Mix(weights=weights, **settings)
    return mixing.mix_documents(docs, (F.col("a"), F.col("b")), plan, F.col("n"))


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(f"{a}{b}{k}", a, b, 1, "x") for a, b, count in (("p", "u", 10), ("p", "v", 200), ("q", "w", 400), (None, "z", 0)) for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id string, a string, b string, n long, mix_epoch string")
    got = {(r.a, r.b): r.c for r in mixed(docs, {}, budget_percent=50, max_epochs=1).groupBy("a", "b").agg(F.count("*").alias("c")).collect()}
    assert got == {("p", "u"): 10, ("p", "v"): 142, ("q", "w"): 152} or got == {("p", "u"): 10, ("p", "v"): 142, ("q", "w"): 153}
    got = {(r.a, r.b): r.c for r in mixed(docs, {"p": 9, ("q", "w"): 3}, budget_percent=60, max_epochs=1).groupBy("a", "b").agg(F.count("*").alias("c")).collect()}
    assert got == {("p", "u"): 10, ("p", "v"): 200, ("q", "w"): 156}
    got = {(r.a, r.b): r.c for r in mixed(docs, {"q": 0}, budget_percent=60, max_epochs=2).groupBy("a", "b").agg(F.count("*").alias("c")).collect()}
    assert got == {("p", "u"): 20, ("p", "v"): 346}


def test_mixing_corner_rows(spark):
    rows = [(1, "p", None, 5), (1, "p", None, 5), (2, None, "u", 0), (None, "p", "u", 3), (3, "p", "u", None)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, a string, b string, n long, level0 string")
    out = mixed(docs, {}, budget_percent=100, max_epochs=1)
    assert out.columns == ["doc_id", "a", "b", "n", "level0", "mix_epoch", "mix_tokens"]
    assert sorted(str(r.doc_id) for r in out.where("n > 0").collect()) == ["1", "1", "None"]
    assert mixed(docs.where("false"), {}).count() == 0


def test_separator_scan(spark):
    rng = random.Random(4)
    files = {f: [[rng.randrange(1, 9) for _ in range(rng.choice([0, 0, 1, 3, 40]))] for _ in range(60)] for f in ("a", "b")}
    rows = []
    for name, docs in files.items():
        flat = np.array([t for d in docs for t in [*d, 0]] + ([5, 5] if name == "b" else []), "<u4").tobytes()
        rows += [(name, n, flat[at : at + 52], -1) for n, at in enumerate(range(0, len(flat), 52))]
    rows += [("c", 0, None, -1), ("d", 0, b"\x01\x00\x00\x00\x00", -1)]
    blocks = spark.createDataFrame(rows, "file string, block int, payload binary, n_sep int").repartition(3)
    got = sorted(map(tuple, separator_scan.count_tokens(blocks, 0, width=4).collect()))
    want = [(f, k, len(d), True) for f, docs in files.items() for k, d in enumerate(docs)] + [("b", 60, 2, False), ("d", 0, 1, False)]
    assert got == sorted(want)
    assert separator_scan.count_tokens(blocks.where("false"), 0).count() == 0


def test_flat_files_round_trip(spark, tmp_path):
    texts = [None, "", "é" * 700, "abc", "", "x" * 5000, None]
    docs = spark.createDataFrame([(k, t, "f") for k, t in enumerate(texts)], "doc_id long, text string, file string").repartition(2)
    flat = separator_scan.flat_bytes(docs, block_bytes=64)
    counts = separator_scan.count_tokens(flat, separator_scan.BYTE_END).join(separator_scan.document_ids(flat), ["file", "doc_no"])
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {k: len((t or "").encode()) for k, t in enumerate(texts)}
    (tmp_path / "one.bin").write_bytes(np.array([7, 256, 256, 7, 7, 256], "<u2").tobytes())
    read = separator_scan.read_flat(spark, str(tmp_path), block_bytes=4)
    assert [r.n_tokens for r in separator_scan.count_tokens(read, 256).orderBy("doc_no").collect()] == [1, 0, 2]


def test_flat_blocks_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    tables = []
    for module in (queries, separator_scan):
        monkeypatch.setattr(module, "written", lambda *a, put=module.written, **k: tables.append(put(*a, **k)) or tables[-1])
    size = 700_000
    docs = spark.range(30).selectExpr("id AS doc_id", f"repeat(chr(97 + CAST(id % 26 AS INT)), {size}) AS text").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in queries.op9(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(30), size)
    groups = []
    for file in (f.removeprefix("file:") for t in tables for f in t.inputFiles()):
        meta = pq.ParquetFile(file).metadata
        groups += [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert len(tables) == 2 and sum(groups) == 2 * -(-30 * 2 * (size + 1) // separator_scan.BLOCK_BYTES)
    assert max(groups) <= separator_scan.GROUP_ROWS


def test_a_flat_file_of_any_size_is_read_by_ranges(spark, tmp_path):
    tokens = np.random.default_rng(2).integers(0, 200, 100_000).astype("<u2")
    (tmp_path / "a b%20.bin").write_bytes(tokens.tobytes() + b"\x01")
    (tmp_path / "none.bin").write_bytes(b"")
    read = separator_scan.read_flat(spark, str(tmp_path), block_bytes=1000)
    assert read.where("length(payload) > 0").select(F.spark_partition_id()).distinct().count() > 1
    rows = {(r.file.rsplit("/", 1)[1], r.block): bytes(r.payload) for r in read.collect()}
    assert len(rows) == 201
    assert b"".join(rows["a b%20.bin", k] for k in range(201)) == tokens.tobytes() + b"\x01"
    got = [r.n_tokens for r in separator_scan.count_tokens(read, 7).orderBy("doc_no").collect()]
    assert len(got) == (tokens == 7).sum() + (tokens[-1] != 7) and sum(got) == (tokens != 7).sum()
    # Beyond 2 GB: holes take no disk.
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate((2 << 30) + 5000)
    large = separator_scan.read_flat(spark, str(tmp_path / "large.bin"))
    assert large.selectExpr("count(*)", "max(block)", "sum(length(payload))").first() == (2049, 2048, (2 << 30) + 5000)


def base_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_against_enumeration(spark):
    rng = random.Random(1)
    urls = [f"https://{rng.choice(['good', 'bad', 'odd'])}.example.{rng.choice(['com', 'org', 'io'])}/{rng.choice(['en', 'de'])}/{rng.randrange(99)}{rng.choice(['', '.html', '?x=1', '#t'])}" for _ in range(400)]
    labelled = [(u, "bad." in u and rng.random() < 0.9 or rng.random() < 0.05) for u in urls]
    frame = spark.createDataFrame([*labelled, (None, True), ("no scheme", True), (urls[0], None)], "url string, block boolean")
    rules = url_rules.mine_rules(frame)
    tokens = {r.url: frozenset(r.tokens) for r in url_rules.split_urls(frame.select("url").where("url is not null").distinct()).collect()}
    need = max(0.002 * 400, 20)
    count = {}
    for u, bad in labelled:
        for size in range(1, 5):
            for combo in itertools.combinations(sorted(tokens[u]), size):
                seen = count.setdefault(frozenset(combo), [0, 0])
                seen[0] += 1
                seen[1] += bad
    strong = {c: b / n for c, (n, b) in count.items() if b >= need and b / n >= 0.6}
    kept = {c for c, conf in strong.items() if not any(d < c and other >= conf for d, other in strong.items())}
    assert {frozenset(r.tokens) for r in rules.collect()} == kept and kept
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, None, "", "x", "ftp://A.NET", "http://net/", "HTTP://Bad.Example.IO:80/En?q", urls[0]])], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_rules.judge_urls(pages, rules).collect()}
    assert len(rows) == len(urls) + 7
    for k, u in enumerate(urls):
        rule, verdict = base_rule(rows[k].host, rows[k].path)
        assert rows[k].rule == rule and rows[k].verdict == (verdict or ("block" if any(c <= tokens[u] for c in kept) else "allow"))
    n = len(urls)
    assert [(rows[n + i].host, rows[n + i].path, rows[n + i].rule) for i in range(5)] == [("", "", None)] * 3 + [("a.net", "", None), ("net", "/", "net/")]
    assert rows[n + 5].host == "bad.example.io:80" and rows[n + 5].path == "/En"


def test_url_query_and_no_labels(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op5_url_association_rules"](spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r.page_id].partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        assert (r.host, r.path) == (host.lower(), slash + path)
        rule, verdict = base_rule(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
    none = spark.createDataFrame([], "url string, block boolean")
    assert url_rules.mine_rules(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    base = {k for k, t in texts.items() if (c := brute_counts(t))[0] >= 50 and 2 * c[4] <= c[0]}
    assert kept <= base and len(kept) > 0.95 * len(base)
    one = corpus_pipeline.near_copies(spark, good, SF)
    names = brute_classes({k: texts[k] for k in kept})
    assert {r.doc_id for r in one.collect()} == {name for name, _ in names.values()} and one.columns == docs.columns
    mix = corpus_pipeline.source_mixing(spark, one, SF)
    assert mix.columns == docs.columns and mix.count() == mix.select("doc_id").distinct().count()
    assert 0.5 * one.count() < mix.count() < one.count()
    rows = {r.doc_id: r.ids for r in corpus_pipeline.sentencepiece_ids(spark, mix, SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(rows) == mix.count() and all(ids == library.encode(texts[k], add_bos=True, add_eos=True) for k, ids in rows.items())


def test_pipeline_run(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "source_mixing", "sentencepiece_ids"]
    out = QUERIES.get("pipeline", corpus_pipeline.run)(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and PIPELINE_TARGETS.max_epochs == 1 and len(levels()) == 3 and domain() is not None

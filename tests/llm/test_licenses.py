"""Base phrases against a plain search, planted statements with edits, and corner cases."""

import re

from latticeqc.llm.license_scan import BASE, LicenseScan, common_in_order, scan_licenses
from latticeqc.llm.queries import QUERIES


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op6_license_diagonals"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    for r in rows:
        assert ("apache-2.0" in r.labels) == ("Licensed under the Apache License, Version 2.0" in texts[r.doc_id])
        assert ("gpl-3.0" in r.labels) == ("licensed under the GNU General Public License, version 3" in texts[r.doc_id])


def test_edited_statements_and_corner_cases(spark):
    redistribution = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    texts = {
        1: None, 2: "", 3: "mit", 4: "... MIT  License cc\nBY", 5: "filler " * 5000 + redistribution + " filler" * 5000,
        6: redistribution.replace("source and binary", "source code and in binary").replace("that the", "the"), 7: "redistribution and use in source of water and binary stars",
        8: "the " * 20_000, 9: "É MIT LICENSE MİT License mit-license", 10: f"{redistribution}. Text between, some words long enough to part them. {redistribution}",
    }
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in texts.items()] + [(5, texts[5], "x", 0)], "doc_id long, text string, labels string, row_ int")
    found, spans = scan_licenses(docs)
    rows = found.collect()
    assert len(rows) == 11
    check(rows, texts)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[5] == labels[6] == labels[10] == "bsd" and labels[7] == labels[8] == "" and labels[4] == "cc-by,mit"
    places = sorted((s.doc_id, s.first, s.last) for s in spans.collect() if s.doc_id == 10)
    assert len(places) == 2 and places[0][1] == 0 and places[1][1] > places[0][2]
    assert scan_licenses(docs.where("false"))[0].count() == 0
    assert scan_licenses(docs, LicenseScan(min_share=1.0))[0].where("doc_id = 6 and labels <> ''").count() == 0


def test_common_in_order():
    assert common_in_order("a b c d".split(), "a x c d".split()) == 3 and common_in_order([], ["a"]) == 0


def test_statement_behind_a_long_repetitive_span(spark):
    """A phrase over and over merges into one long span; a whole statement behind it, or between such runs, still counts."""
    run, whole = "licensed under the apache " * 12, "licensed under the apache license version 2 0"
    texts = [whole, run + whole, run * 20 + whole + " " + run * 20, run * 20]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in scan_licenses(frame)[0].collect()}
    assert all("apache-2.0" in labels[i].split(",") for i in (0, 1, 2)) and "apache-2.0" not in labels[3].split(",")

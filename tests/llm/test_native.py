"""The operators in SQL functions."""

import re

import duckdb
import pytest

from tabproof.llm import licenses
from tabproof.llm.queries import ORACLES, QUERIES, RULES
from tabproof.llm.urls import filter_urls
from tests.conftest import SF_DIR

from .conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SIGNATURES = [(s, re.compile(s.pattern)) for s in licenses.signatures()]


def plain_scan(raw):
    text = (raw or "").translate(LOWER)
    words = re.findall(licenses.WORD, text)
    places = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items()
              if words[i:i + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), s.priority, s.label) for s, p in SIGNATURES if s.keyword in text for m in p.finditer(text)
             ] if re.search(licenses.GATE, raw or "") else []
    kept = [x for x in found if not any(
        y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or y[2:] < x[2:]) for y in found)]
    base = {label for _, label in places}
    return (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in kept})), len(kept))


def seen(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections)


def test_scan_equals_brute_force(spark, documents):
    rows = QUERIES["op2_licenses"](spark, SF_DIR).collect()
    assert {r.doc_id: seen(r) for r in rows} == {i: plain_scan(t) for i, t in documents.items()}
    assert any(r.n_base for r in rows) and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("text", [
    "SPDX-License-Identifier: Apache-2.0", "mit license mit license MIT LICENSE", "This is licensed under the MIT License. MIT license!",
    "GNU General Public License, version 3. general public license", "general  PUBLIC\nlicense", "License: MIT-0 / license='gpl-2.0'",
    "CC BY-NC-SA 4.0 and cc-by 3.0 copyright 2020", "all rights reserved copyright (c) 2001", "apache license version 2.0 http://www.apache.org/licenses/LICENSE-2.0",
    "it's the 'unlicense', see license", "ſpdx licenſe", "mit license " * 300,
])
def test_scan_of_texts(spark, text):
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert seen(row) == plain_scan(text)


def test_scan_edges(edges, nothing):
    rows = licenses.scan_licenses(edges).collect()
    assert sorted((str(r.doc_id), seen(r)) for r in rows if r.doc_id) == sorted((str(i), plain_scan(t)) for i, t, _ in EDGES if i)
    assert len(rows) == len(EDGES) and licenses.scan_licenses(nothing).collect() == []


def test_hundreds_of_rules():
    rules = licenses.signatures()
    assert len(rules) > 300 and {r.priority for r in rules} == {0, 1, 2}
    assert all("," not in r.label and 0 < r.weight < 1 for r in rules)


def test_urls_equal_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    rows = QUERIES["op6_url_filter"](spark, SF_DIR)
    expected = duckdb.sql(ORACLES["op6_url_filter"])
    assert sorted(map(str, rows.select(*expected.columns).collect())) == sorted(
        "Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(expected.columns, r)) + ")" for r in expected.fetchall())
    assert rows.where("verdict = 'block' AND rule IS NULL").count() > 0


def test_url_edges(spark):
    urls = [(1, "HTTP://Sub.Example.ORG/es/x?q#f"), (2, "https://example.org/en/1"), (3, "https://example.org/en/2/"),
            (4, "http://a.com/fr/"), (5, "http://a.com/de/x"), (6, "nothing"), (7, None), (8, ""), (9, "x://"), (None, "http://bad.net/a"),
            (10, "https://www.bad.net/a/index.html#top"), (10, "https://m.bad.net/a?x=1"), (11, "http://badexample.org/es/"),
            (12, "http://org"), (13, "http://org/"), (14, "http://h.net?x/es/"), (15, "http://h.net:80/p\nq"), (16, "a://b://c/d")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in urls], "page_id long, url string, host string, block string")
    listed = spark.createDataFrame([("http://bad.net/a/",), ("http://bad.net/a.html",), (None,), ("junk",)], "url string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, listed, RULES).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "sub.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"),
        (3, "example.org", "/en/2/", "org/", "allow"), (4, "a.com", "/fr/", "com/fr/", "allow"), (5, "a.com", "/de/x", "com/de/", "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (None, "bad.net", "/a", None, "block"), (10, "www.bad.net", "/a/index.html", None, "block"), (10, "m.bad.net", "/a", None, "block"),
        (11, "badexample.org", "/es/", "org/", "allow"), (12, "org", "", None, "allow"), (13, "org", "/", "org/", "allow"),
        (14, "h.net", "", None, "allow"), (15, "h.net:80", "/p\nq", None, "allow"), (16, "b:", "//c/d", None, "allow")], key=str)
    assert filter_urls(df.where("false"), listed, RULES).collect() == []
    assert {r.verdict for r in filter_urls(df, listed.where("false"), []).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op2_licenses", "op6_url_filter"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def whole_scan(raw):
    """Labels and number of detections with every pattern tried on the text."""
    text = (raw or "").translate(LOWER)
    found = [(m.start(), m.end(), s.priority, s.label) for s, p in SIGNATURES for m in p.finditer(text)]
    kept = [x for x in found if not any(
        y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or y[2:] < x[2:]) for y in found)]
    return {x[3] for x in kept}, len(kept)


def test_every_rule_is_tried_on_every_text(spark, documents):
    texts = [
        "Released under GPLv3.", "CC BY-SA 4.0", "cc0 1.0", "Creative Commons", "licensed under Creative Commons Attribution 4.0",
        "Attribution-NonCommercial-ShareAlike 3.0", "Apache 2.0", "3-Clause BSD", "AGPL", "LGPLv2.1", "beerware", "strictly proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "the Expat License", "ICU licence", "É GPL",
        "Permission to use, copy, modify, and distribute this software for any purpose", "nothing at all",
        "This software is provided 'as-is', without any express or implied warranty",
        "redistribute it and/or modify\nit under the terms of the GNU General Public License"] + list(documents.values())[:50]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    base = {r.doc_id: set(filter(None, r.base_labels.split(","))) for r in rows}
    assert {r.doc_id: (set(filter(None, r.labels.split(","))), r.n_detections) for r in rows} == {
        i: (labels | base[i], n) for i, (labels, n) in enumerate(map(whole_scan, texts))}
    assert all(r.score > 0 for r in rows if r.doc_id < 17)

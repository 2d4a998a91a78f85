"""Operators 4, 5, 6 and 10 against brute force, the edges, and the registered queries' SQL."""

from __future__ import annotations

import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnscope.llm import automaton, license_scan, line_templates, queries, secrets, url_filter
from conftest import DATA_ROOT

SF = os.path.join(DATA_ROOT, "sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_queries_match_their_sql(spark):
    from tools.oracle_check import check

    report = check(spark, SF, list(queries.ORACLE_SQL))
    assert not {k: v for k, v in report.items() if not v.get("value_match")}


# ---------------------------------------------------------------- URLs

URLS = [
    "http://org/", "https://www.EXAMPLE.org/es/1", "http://a.example.org/en/12?x", "http://a.example.org/en/2", "http://x.com/fr/", "http://x.com/de/#",
    "http://notexample.org/es/", "http://example.org", "http://example.org/ES/", "http://free-bets.example.net/x", "http://casino.net", "//x.org/",
    None, "", "mailto:a@b.org", "http://a.com:80/de/", "http://a.net/affiliate/1/click?x", "http://best.net/sexton", "x://y://z.org/q", "http://a\n.org/b",
]


def _judge(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(url_filter.AZ), m[2]) if m else ("", "")
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    hit = any(re.search(p.regex, (host + path).translate(url_filter.AZ)) for p in url_filter.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_urls_equal_trying_every_rule(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(pages, queries.URL_RULES + url_filter.PATTERNS).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [_judge(u) for u in URLS]
    assert url_filter.judge_urls(pages.limit(0), url_filter.PATTERNS).count() == 0


def test_only_the_rarest_token_files_a_rule():
    rules = [url_filter.HostRule("block", "example.org", "/en/1"), url_filter.PatternRule("block", "ab*")]
    assert rules[0].tokens == ["example", "org", "en"]  # the trailing 1 may go on
    ix = url_filter.build_index(rules, {"example": 5, "org": 9, "en": 2})
    assert ix.by_token == {"en": [0]} and ix.always == [1]
    assert ix.candidates("example.org/fr/") == [1]


# ---------------------------------------------------------------- secrets

RULES = [(r.kind, re.compile(r.regex, re.ASCII), r.group, r.least) for r in secrets.BASE_RULES + secrets.MORE_RULES]
PIECES = ["password", "Passwd", "secret=", "token", ":", "=", " ", '"', "api_key", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "dead", "é", "\U0001f600", "\n",
          ", ", "x", "abcdef", "ghp_", "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-"]


def _spans(text):
    rank = {k: i for i, (k, *_) in enumerate(RULES)}
    found = [(m.start(), rank[k], k, m.end()) for k, r, g, n in RULES for m in r.finditer(text or "") if len(m[g]) >= n]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets_equal_the_regexes(docs, nothing):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "a" * 200_000 + " token: 0123456"), (None, "token=abcdefgh"), (503, "secret=token: abcdefgh")]
    got = secrets.find_secrets(docs(rows)).collect()
    assert sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got), key=str) == sorted(((i, _spans(t)) for i, t in rows), key=str)
    assert sum(len(r["spans"]) for r in got) > 50
    assert secrets.find_secrets(nothing).count() == 0
    assert secrets.mask_secrets("a token=abcdefgh b", [(2, 16)]) == "a [secret] b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcx01 ", max_size=30), min_size=1, max_size=8))
def test_automaton_finds_what_the_regexes_find(texts):
    import numpy as np

    rules = ["ab+c", "(?i:x0|AB)1{2}", "[0-9]{3,4} ", "a(b|c)?x{1,2}"]
    machine = automaton.compile_rules(rules)
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    found = machine.scan(np.frombuffer(b"".join(data) or b" ", np.uint8), ends - [len(d) for d in data], ends)
    assert found.tolist() == [any(re.search(r, t) for r in rules) for t in texts]


# ---------------------------------------------------------------- licences


def test_licences(docs, nothing):
    rows = [
        (1, "Intro text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "RELEASED UNDER   THE MIT LICENSE"),
        (3, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."),
        (4, "The MIT of licences released under"),
        (5, "All rights reserved"),
        (6, None),
        (7, ""),
        (8, "Copyright (c) 2019 Some Body. All rights reserved."),
        (None, "Released under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licences(docs(rows)).collect()}
    assert got[1]["licences"] == ["Apache-2.0"] and got[1]["positions"] == [1] and got[1]["n_sentences"] == 3
    assert got[2]["licences"] == ["MIT"] and got[None]["licences"] == ["MIT"]
    assert got[3]["licences"] == ["CC-BY-NC-4.0", "CC-BY-4.0"] and got[3]["sentence_ids"] == ["cc-by-nc-4", "cc-by-4"]
    assert got[4]["licences"] == got[6]["licences"] == got[7]["licences"] == []
    assert got[5]["licences"] == got[8]["licences"] == ["all-rights-reserved"]
    assert license_scan.scan_licences(nothing).count() == 0


def test_licence_rules_keep_their_order(docs):
    sentences = {"a": ("alpha",), "b": ("beta",)}
    rules = (license_scan.LicenceRule("AB", ("a", "b")),)
    rows = [(1, "alpha. beta"), (2, "beta. alpha"), (3, "alpha. x. y. beta"), (4, "alpha. x. y. z. beta")]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan_licences(docs(rows), sentences=sentences, rules=rules).collect()}
    assert got == {1: ["AB"], 2: [], 3: ["AB"], 4: []}


MIT_TEXT = """Copyright (c) 2019 Some Body
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice."""


def test_wrapped_licences(docs):
    behind = lambda mark, text: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    rows = [(i, f"int x\n\n{behind(mark, MIT_TEXT)}\n") for i, mark in enumerate(["", "#", " *", "//", ";"])]
    rows += [(10 + i, behind(mark, BSD_TEXT)) for i, mark in enumerate(["", "#", " *", "//", ";"])]
    rows += [(20, MIT_TEXT.replace("\n", "\r\n")), (21, "The MIT\n\nLicense"), (22, "The MIT.\nLicense"), (23, "# The MIT\n#\n# License"), (24, "My title\nThe MIT License\nmore text"), (25, "a\x01b\x02c.\x01 d")]
    got = {r["doc_id"]: r for r in license_scan.scan_licences(docs(rows)).collect()}
    for i in (0, 1, 2, 3, 4, 20):
        assert got[i]["licences"] == ["MIT"] and got[i]["sentence_ids"] == ["copyright", "mit-grant", "mit-notice", "no-warranty"], i
    assert got[0]["positions"] == [1, 2, 3, 4] and got[0]["n_sentences"] == 7
    for i in range(10, 15):
        assert got[i]["licences"] == ["BSD"] and got[i]["positions"] == [0], i
    assert [got[i]["licences"] for i in (21, 22, 23, 24)] == [[], [], [], ["MIT"]]
    assert got[24]["positions"] == [1] and got[24]["n_sentences"] == 3
    assert got[25]["n_sentences"] == 1


# ---------------------------------------------------------------- lines


def test_template_lines_go(docs, nothing):
    rng = random.Random(9)
    body = lambda: " ".join(rng.choice("ka lo mi nu pe ri so tu".split()) + str(rng.random())[2:6] for _ in range(9))
    rows = [(i, f"{body()}\nPosted by user{i} on 2024-01-{i % 28 + 1:02d} here\nshort x\nSee also the home page\n{body()}") for i in range(12)]
    rows += [(50, "See also the home page"), (51, None), (52, ""), (None, "See also the home page\nSee also the home page"), (53, "See also the other page")]
    got = {r["doc_id"]: r for r in line_templates.drop_template_lines(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i]["dropped"] == [1, 3] and got[i]["n_lines"] == 5
        assert got[i]["text"].split("\n") == [x for n, x in enumerate(rows[i][1].split("\n")) if n not in (1, 3)]
    assert got[50]["text"] == "" and got[50]["n_dropped"] == 1
    assert got[51]["text"] == got[52]["text"] == "" and got[51]["n_lines"] == 1
    assert got[None]["n_dropped"] == 2
    assert got[53]["n_dropped"] in (0, 1)
    assert line_templates.drop_template_lines(nothing).count() == 0


def test_template_edges(edges):
    got = line_templates.drop_template_lines(edges)
    assert got.count() == edges.count() and got.where("n_dropped > 0").count() == 0

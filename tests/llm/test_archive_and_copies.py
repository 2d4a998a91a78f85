"""Operators 1 and 2: archive round trip, exact dedup with collisions and late arrivals."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import functions as F

from churnscope.llm import exact_dedup, warc
from churnscope.llm.common import Scratch, shared_path


def _index(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages, shared_path(spark, "warc-test"))
    return path, {r["id"]: r for r in warc.read_index(spark, path).collect()}


def test_archive_round_trip(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "http://a/", big, "x"), (1, "http://b/\r\nEvil: 1", big, "x"), (2, None, big + "!", "x"), (4, "http://c/", "tiny", "x"),
            (5, "http://d/", "tiny", "x"), (6, "http://e/", None, "x"), (7, "http://f/", "", "x")]
    path, got = _index(spark, rows)
    for page, _, html, _ in rows:
        body = (html or "").encode()
        assert got[page]["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert got[page]["payload_bytes"] == len(body)
        assert got[page]["verified"] and got[page]["length_ok"]
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1)
    assert {got[i]["record_type"] for i in (1, 2, 4, 5, 6, 7)} == {"response"}
    # Each payload once; the records are whole WARC records.
    assert warc.read_payloads(spark, path).count() == 4
    for r in warc.read_records(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest.endswith(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) - 4 == length
        assert b"\r\nEvil" not in head


def test_archive_of_repeated_and_nameless_rows(spark):
    big = "x" * 200
    rows = [(1, "u", big, ""), (1, "u", big, ""), (None, "u", big, ""), (None, "v", "y" * 200, ""), (None, "w", "y" * 200, "")]
    path, _ = _index(spark, rows)
    assert warc.read_payloads(spark, path).count() == 2
    records = warc.read_records(spark, path)
    assert records.count() == 5 and records.where("verified").count() == 5


def test_empty_archive(spark):
    path, got = _index(spark, [])
    assert got == {} and warc.read_payloads(spark, path).count() == 0


def _brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


COPIES = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (4, "a b"), (1, None), (8, ""), (7, " "), (3, "é x"), (None, "a b"), (None, "z"), (2, "a b")]


def test_exact_copies(docs):
    got = exact_dedup.exact_dedup(docs(COPIES)).drop("keep_locator")
    assert sorted(map(tuple, got.collect()), key=str) == _brute(COPIES)


def test_full_texts_decide_where_digests_collide(docs):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    got = exact_dedup.exact_dedup(docs(rows), key_chars=1).drop("keep_locator")
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_state_is_kept_between_runs(spark, docs):
    scratch = Scratch(spark)
    source, checkpoint = scratch.path("stream-source"), scratch.path("stream-state")
    day = lambda rows: exact_dedup.digests(docs(rows))
    schema = day([(0, "")]).schema
    day([(5, "a"), (6, "b")]).write.mode("append").parquet(source)
    exact_dedup.run_stream(scratch, source, schema, 1 << 30, checkpoint)
    day([(3, "a"), (9, "c")]).write.mode("append").parquet(source)
    state = exact_dedup.run_stream(scratch, source, schema, 1 << 30, checkpoint)
    assert sorted((r["keep_id"], r["group_size"]) for r in state.collect()) == [(3, 2), (6, 1), (9, 1)]


def test_settings_reach_the_state_stores(spark, docs):
    session = exact_dedup.stream_session(spark)
    assert {k: session.conf.get(k, None) for k in exact_dedup.ROCKSDB} == exact_dedup.ROCKSDB
    assert all(spark.conf.get(k, None) is None for k in exact_dedup.ROCKSDB if ".rocksdb." in k)
    # A commit adds its changes to the checkpoint, not the store's files.
    scratch = Scratch(spark)
    source, checkpoint = scratch.path("stream-source"), scratch.path("stream-state")
    narrow = exact_dedup.digests(docs([(5, "a"), (6, "b"), (7, "a")]))
    narrow.write.parquet(source)
    exact_dedup.run_stream(scratch, source, narrow.schema, 1 << 30, checkpoint)
    names = [f for _, _, files in os.walk(checkpoint.removeprefix("file:") + "/state") for f in files if not f.startswith(".")]
    assert any(f.endswith(".changelog") for f in names) and not any(f.endswith(".zip") for f in names)


def test_dedup_edges(edges, nothing):
    got = exact_dedup.exact_dedup(edges)
    assert got.count() == edges.count()
    assert {r["doc_id"] for r in got.where("kept").collect()} == {1, 3, 5, 6, 7, 8}
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns
    assert kept.where(F.col("doc_id") == 2).count() == 0

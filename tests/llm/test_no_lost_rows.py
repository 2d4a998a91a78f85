"""Stages that drop or multiply rows decide by text: shared ids lose nothing, repeated rows come once."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.llm import decontam, exact_dedup, mixing, setsketch_dedup as near

SIXTY = " ".join(f"w{i}" for i in range(60))
NEARLY = SIXTY.replace("w59", "end")


def _kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_exact_copies_by_text(docs):
    rows = [(1, "x"), (2, "x"), (2, "unique"), (3, "r"), (3, "r"), (3, "r"), (None, "x"), (None, "alone"), (None, "alone"), (4, None), (5, "")]
    out = exact_dedup.drop_copies(docs(rows))
    assert out.columns == docs([]).columns
    assert _kept(out) == sorted([(1, "x"), (2, "unique"), (3, "r"), (None, "alone"), (4, None)], key=str)
    # One row without an id of a text that no row with an id has.
    assert _kept(exact_dedup.drop_copies(docs([(None, "a b"), (None, "a\tb")])))[0][0] is None
    assert exact_dedup.drop_copies(docs([(None, "a b"), (None, "a\tb")])).count() == 1


def test_near_copies_by_text(docs):
    rows = [(1, SIXTY), (2, NEARLY), (2, "something else that is unique here"), (3, "repeated row of words"), (3, "repeated row of words"), (None, SIXTY), (4, ""), (5, None)]
    got = _kept(near.drop_near_copies(docs(rows)))
    assert (2, "something else that is unique here") in got and got.count((3, "repeated row of words")) == 1
    assert sum(t in (SIXTY, NEARLY) for i, t in got if i is not None) == 1
    assert (None, SIXTY) in got and (4, "") in got and (5, None) in got
    assert _kept(near.drop_near_copies(docs([(1, SIXTY), (2, NEARLY), (3, "other words")]))) == [(1, SIXTY), (3, "other words")]


def test_leaks_by_text(docs, spark):
    leak = "the quick brown fox jumps over the lazy dog while the sun sets behind seven distant hills of the west"
    rows = [(1, leak), (1, "nothing of the kind, only a harmless text that shares an id"), (None, "so: " + leak), (2, None), (3, "")]
    out = decontam.drop_leaks(docs(rows), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert _kept(out) == sorted([(1, rows[1][1]), (2, None), (3, ""), rows[2]], key=str)


def test_mix_plans_rows_that_share_an_id(docs):
    shared = [(7, "one two three", "a"), (7, "one two six", "a"), (7, "one two three", "b")]
    rows = shared + [(100 + i, f"w{i} and more", s) for i in range(30) for s in "ab"] + [(None, "no id here", "a"), (8, "same same", "a"), (8, "same same", "a")]
    frame = docs(rows)
    out = mixing.mixed(frame)
    assert out.columns == [*frame.columns, "mix_copies", "mix_taken"]
    took = sum(r["mix_taken"] for r in out.where("doc_id is not null").collect())
    planned = mixing.mix(frame).where("doc_id is not null").agg(F.sum("taken")).first()[0]
    assert took == planned
    assert out.where("doc_id = 8").count() <= 1
    # Takes its own output, and columns named like its helpers.
    again = mixing.mixed(out.withColumns({"mix_size": F.lit(1), "size": F.lit(2), "src": F.lit("x"), "copies": F.lit(3)}))
    assert again.columns == [*frame.columns, "mix_size", "size", "src", "copies", "mix_copies", "mix_taken"] and again.count() > 0


def test_stream_settings_stay_in_their_session(spark, docs):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    exact_dedup.exact_dedup(docs([(1, "a"), (2, "a")])).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before

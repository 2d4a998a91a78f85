"""Audit operators W1-W9 on small inputs of our own."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from churnscope.operators import audit
from churnscope.plans import cohort
from churnscope.sources.tables import footer_reader, table_reader
from conftest import DATA_ROOT, person, rows, ts

SF_SMALL = os.path.join(DATA_ROOT, "sf0.001")


def test_row_counts(mk):
    p = mk.people([person(1), person(2)])
    u = mk.units()
    assert rows(audit.row_counts({"p": p, "u": u, "e": mk.exits([])})) == [("e", 0), ("p", 2), ("u", 3)]


def test_preview_orders_and_limits(mk):
    p = mk.people([person(i, name=f"n{i}") for i in [5, 3, 9, 1]] + [(None,) * 7])
    out = audit.preview(p, 3, F.col("person_id").asc_nulls_first())
    assert [r[0] for r in out.collect()] == [None, 1, 3]
    assert audit.preview(p, None).count() == 5


def test_distinct_values_null_is_one_value(mk):
    p = mk.people([person(1, rating=None), person(2, rating=None), person(3, rating=4), person(4, rating=2)])
    assert [r[0] for r in audit.distinct_values(p, "rating").collect()] == [None, 2, 4]
    assert [tuple(r) for r in audit.distinct_values(p, "rating", counts=True).collect()] == [
        (None, 2), (2, 1), (4, 1)]


def test_orphan_keys_null_and_orphan(mk):
    p = mk.people([person(1, unit=None), person(2, unit=99), person(3, unit=99), person(4, unit=1)])
    assert rows(audit.orphan_keys(p, mk.units(), "unit_id")) == [(None, "null", 1), (99, "orphan", 2)]


def test_f17_missing_match(mk):
    p = mk.people([person(1, status="Terminated"), person(2, status="Terminated"), person(3)])
    e = mk.exits([(10, 1, 5, "Voluntary")])
    out = audit.missing_match_count(p, e, "person_id", where=F.col("status") == "Terminated")
    assert out.first()[0] == 1
    assert rows(audit.missing_matches(p, e, "person_id", where=F.col("status") == "Terminated"), "person_id") == [(2,)]


def test_duplicate_groups(mk):
    p = mk.people([person(1), person(2), person(3, name="Bob"), person(4, start=None), person(5, start=None)])
    out = audit.duplicate_groups(p, cohort.NATURAL_KEY)
    assert rows(out) == [("Ann", None, 2), ("Ann", ts(0), 2)]


def test_f1_null_key_rows(mk):
    p = mk.people([person(1), (None,) * 7])
    out = audit.null_key_rows(p, "person_id")
    assert out.count() == 1 and all(v is None for v in out.first())


def test_fd_violations_empty_when_functional(mk):
    p = mk.people([person(1, unit=1, role="Desk A"), person(2, name="b", unit=1, role="DESK A "),
                   person(3, name="c", unit=99, role="desk a")])
    # 99 is not in the dimension, so it does not count as a second unit.
    assert audit.fd_violations(p, "role_raw", "unit_id", mk.units()).count() == 0
    # Without the dimension it does.
    assert audit.fd_violations(p, "role_raw", "unit_id").count() == 1


def test_fd_violations_without_normalisation(mk):
    p = mk.people([person(1, unit=1, role="A"), person(2, name="b", unit=2, role="a")])
    assert audit.fd_violations(p, "role_raw", "unit_id", normalize=False).count() == 0


def test_plain_tables_are_counted_from_footers(spark):
    read = footer_reader(spark, SF_SMALL)
    counts = audit.row_counts({"lineitem": read("lineitem"), "part": read("part")})
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2
    plain = table_reader(spark, SF_SMALL)
    assert rows(counts) == sorted((t, plain(t).count()) for t in ("lineitem", "part"))
    # A filter is an ordinary scan; frames of both readers combine; the caller's settings stay.
    some = F.col("l_quantity") > 10
    mixed = audit.row_counts({"a": read("lineitem").where(some), "b": plain("lineitem").where(some)})
    assert len({r.row_count for r in mixed.collect()}) == 1
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_a_clean_determinant_sends_no_pairs(spark):
    data = [("clean", 1)] * 50 + [("CLEAN ", 1)] * 50 + [("dirty", i % 3) for i in range(9)] + [("gap", None)] * 5 + [(None, 1), (None, 2), (None, None)]
    df = spark.createDataFrame(data, "role string, unit int")
    assert rows(audit.fd_violations(df, "role", "unit")) == [(None, 2), ("dirty", 3)]
    dim = spark.createDataFrame([(0,), (1,), (1,)], "unit int")
    assert rows(audit.fd_violations(df, "role", "unit", dim)) == [("dirty", 2)]
    one = spark.createDataFrame([(2,)], "unit int")
    assert rows(audit.fd_violations(df, "role", "unit", one)) == []

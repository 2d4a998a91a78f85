"""Cohort metrics W15-W19: edge cases F13-F19 and properties."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from churnscope.functions.numeric import packed_order
from churnscope.operators import metrics
from churnscope.plans import cohort
from conftest import person, rows, ts

D = Decimal


def _pop(mk, people, units=None):
    u = units if units is not None else mk.units()
    clean = cohort.clean_people(mk.people(people), u)
    return clean, u


def test_f13_two_events_count_once(mk):
    clean, u = _pop(mk, [person(1, unit=1), person(2, name="b", unit=1)])
    e = mk.exits([(10, 1, 5, "Voluntary"), (11, 1, 6, "Voluntary")])
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [("Sales", 2, 1, D("50.00"))]
    assert rows(cohort.attrition_by_unit_and_type(clean, u, e)) == [("Sales", 2, "Voluntary", 1, D("50.00"))]


def test_f14_group_without_events(mk):
    clean, u = _pop(mk, [person(1, unit=1), person(2, name="b", unit=2)])
    e = mk.exits([(10, 1, 5, "Involuntary")])
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [
        ("Legal", 1, 0, D("0.00")), ("Sales", 1, 1, D("100.00"))]
    # No exit in Legal: no row for it at all.
    assert rows(cohort.attrition_by_unit_and_type(clean, u, e)) == [("Sales", 1, "Involuntary", 1, D("100.00"))]


def test_f15_rate_tie_rounds_half_up(mk):
    clean, u = _pop(mk, [person(i, name=f"p{i}", unit=1) for i in range(1, 33)])
    e = mk.exits([(100, 1, 5, "Voluntary")])
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [("Sales", 32, 1, D("3.13"))]


def test_f15_mean_tie_rounds_half_up(mk):
    clean, _ = _pop(mk, [person(1, role="R"), person(2, name="b", role="R")])
    m = mk.measures([(1, 1, 0, 10.01), (2, 2, 0, 10.02)])
    out = cohort.measure_gap_by_role(clean, m)
    assert rows(out) == [("r", D("10.02"), None, None)]


def test_f16_stayers_only_gap_null_and_gap_from_unrounded_means(mk):
    people = [person(1, role="R"), person(2, name="b", role="R", status="Terminated"),
              person(3, name="c", role="R", status="Terminated"), person(4, name="d", role="S")]
    clean, _ = _pop(mk, people)
    # person 1 has two amounts on one date: the higher id (10.01) is the latest
    m = mk.measures([(1, 1, 0, 10.00), (9, 1, 0, 10.01), (2, 2, 0, 5.00), (3, 3, 0, 5.00),
                     (4, 4, 0, 7.00)])
    latest = rows(cohort.latest_measure(m), "measure_id")
    assert latest == [(2,), (3,), (4,), (9,)]
    out = rows(cohort.measure_gap_by_role(clean, m))
    assert out == [("r", D("10.01"), D("5.00"), D("5.01")), ("s", D("7.00"), None, None)]


def test_gap_uses_unrounded_means(spark):
    df = spark.createDataFrame(
        [("r", "A", D("1.004")), ("r", "B", D("0.006"))], "g string, f string, v decimal(12,3)")
    # rounded means would give 1.00 - 0.01 = 0.99; the unrounded gap 0.998 rounds to 1.00
    out = metrics.group_gap(df, "g", "v", "f", "A", "B").first()
    assert tuple(out) == ("r", D("1.00"), D("0.01"), D("1.00"))


def test_f17_terminated_without_exit(mk):
    people = [person(1, role="R", status="Terminated"), person(2, name="b", role="R")]
    clean, u = _pop(mk, people)
    e = mk.exits([])
    # Not a leaver for the exit-based rate ...
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [("Sales", 2, 0, D("0.00"))]
    # ... but a leaver for the status-based gap.
    m = mk.measures([(1, 1, 0, 10), (2, 2, 0, 30)])
    assert rows(cohort.measure_gap_by_role(clean, m)) == [("r", D("30.00"), D("10.00"), D("20.00"))]


def test_f18_elapsed_counts_calendar_days(spark, mk):
    pop = spark.createDataFrame([(1, 1, ts(0, 23))], "person_id long, g int, start_ts timestamp_ntz")
    ev = spark.createDataFrame([(1, ts(1, 1))], "person_id long, exit_ts timestamp_ntz")
    out = metrics.mean_elapsed_by_group(pop, ev, "person_id", "g", "start_ts", "exit_ts", unit_days=1)
    assert tuple(out.first()) == (1, D("1.00"))


def test_f19_two_units_same_name(mk):
    u = mk.units([(1, "Sales"), (2, "Sales")])
    clean, _ = _pop(mk, [person(1, unit=1), person(2, name="b", unit=2), person(3, name="c", unit=2)], u)
    e = mk.exits([(10, 1, 5, "Voluntary")])
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [
        ("Sales", 1, 1, D("100.00")), ("Sales", 2, 0, D("0.00"))]


def test_f6_unrecoverable_unit_absent_from_rate_present_in_gap(mk):
    people = [person(1, role="Known"), person(2, name="b", unit=99, role="Lonely")]
    clean, u = _pop(mk, people)
    e = mk.exits([(10, 2, 5, "Voluntary")])
    assert rows(cohort.attrition_by_unit(clean, u, e)) == [("Sales", 1, 0, D("0.00"))]
    m = mk.measures([(1, 1, 0, 10), (2, 2, 0, 20)])
    assert [r[0] for r in rows(cohort.measure_gap_by_role(clean, m))] == ["known", "lonely"]


def test_rate_by_rating_filters_null_rating_and_invalid_unit(mk):
    people = [person(1, rating=5), person(2, name="b", rating=5), person(3, name="c", rating=None),
              person(4, name="d", rating=1, unit=99, role="Nowhere")]
    clean, u = _pop(mk, people)
    e = mk.exits([(10, 1, 5, "Voluntary"), (11, 3, 5, "Voluntary")])
    assert rows(cohort.attrition_by_rating(clean, u, e)) == [(5, 2, 1, D("50.00"))]


def test_tenure_mean(mk):
    clean, u = _pop(mk, [person(1, start=0), person(2, name="b", start=0), person(3, name="c", unit=2)])
    e = mk.exits([(10, 1, 365, "Voluntary"), (11, 2, 730, "Involuntary")])
    assert rows(cohort.tenure_before_exit_by_unit(clean, u, e)) == [("Sales", D("1.50"))]


def test_split_sums_to_group_and_rates_bounded(mk):
    people = [person(i, name=f"p{i}", unit=1 + i % 3, role=f"R{i % 3}") for i in range(1, 40)]
    clean, u = _pop(mk, people)
    e = mk.exits([(100 + i, i, 3, "Voluntary" if i % 2 else "Involuntary") for i in range(1, 40, 3)])
    whole = {r[0]: r[2] for r in cohort.attrition_by_unit(clean, u, e).collect()}
    split = cohort.attrition_by_unit_and_type(clean, u, e).groupBy("unit_name").agg(F.sum("leavers"))
    assert {r[0]: r[1] for r in split.collect()} == {k: v for k, v in whole.items() if v}
    rates = [r[0] for r in cohort.attrition_by_unit(clean, u, e).select("rate").collect()]
    assert all(D(0) <= r <= D(100) for r in rates)


def test_f20_empty_metrics(mk):
    clean, u = _pop(mk, [])
    e, m = mk.exits([]), mk.measures([])
    assert cohort.attrition_by_unit(clean, u, e).count() == 0
    assert cohort.attrition_by_unit_and_type(clean, u, e).count() == 0
    assert cohort.attrition_by_rating(clean, u, e).count() == 0
    assert cohort.measure_gap_by_role(clean, m).count() == 0
    assert cohort.tenure_before_exit_by_unit(clean, u, e).count() == 0


def test_permutation_invariance(mk, spark):
    people = [person(i, name=f"p{i % 7}", start=i % 2, unit=[1, 2, None, 99][i % 4],
                     role=["Desk A", "desk b", "DESK C "][i % 3]) for i in range(1, 30)]
    e = mk.exits([(100 + i, i, 40, "Voluntary") for i in range(1, 30, 4)])
    u = mk.units()
    a = cohort.attrition_by_unit(cohort.clean_people(mk.people(people), u), u, e)
    b = cohort.attrition_by_unit(cohort.clean_people(mk.people(people[::-1]).repartition(5), u), u, e)
    assert rows(a) == rows(b)


def test_mean_elapsed_counts_every_event_and_skips_undated(spark):
    pop = spark.createDataFrame(
        [(1, 1, ts(0)), (2, 1, ts(10)), (3, 1, None), (4, 2, ts(0))],
        "person_id long, g int, start_ts timestamp_ntz",
    )
    ev = spark.createDataFrame(
        [(1, ts(10, 23)), (1, ts(30)), (2, ts(40)), (3, ts(50)), (4, None)],
        "person_id long, exit_ts timestamp_ntz",
    )
    out = metrics.mean_elapsed_by_group(pop, ev, "person_id", "g", "start_ts", "exit_ts", unit_days=1)
    # group 1: spans 10, 30 (person 1), 30 (person 2); person 3 has no start -> (10+30+30)/3
    # group 2: its only event has no date -> no span, NULL mean
    assert rows(out) == [(1, D("23.33")), (2, None)]


def test_rate_by_group_dim_and_where(spark, mk):
    import pytest

    pop = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 7, 5)], "id long, u int, r int")
    dim = spark.createDataFrame([(1, "Sales")], "unit_id int, unit_name string")
    ev = spark.createDataFrame([(1,), (3,)], "id long")
    inner = metrics.rate_by_group(pop, ev, "id", ["unit_name"], dim=dim, dim_on=("u", "unit_id"))
    assert rows(inner) == [("Sales", 2, 1, D("50.00"))]  # unit 7 is not in the dimension
    semi = metrics.rate_by_group(pop, ev, "id", ["r"], dim=dim, dim_on=("u", "unit_id"),
                                 dim_how="left_semi", where=F.col("r").isNotNull())
    assert rows(semi) == [(5, 1, 1, D("100.00"))]
    with pytest.raises(ValueError):
        metrics.rate_by_group(pop, ev, "id", ["u"], dim=dim)


def test_packed_order_sorts_like_the_pair(spark):
    days = [None, "0001-01-01 00:00:00", "1899-12-31 23:59:59.999999", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-03-31 02:30:00", "9999-12-31 23:59:59.999999"]
    ids = [None, -(2**63), -1, 0, 7, 2**63 - 1]
    pairs = spark.createDataFrame([(d, i, n * 100 + m) for n, d in enumerate(days) for m, i in enumerate(ids)], "d string, i long, place int")
    for kind in ("timestamp_ntz", "timestamp", "date"):
        df = pairs.withColumn("d", F.col("d").cast(kind))
        order = packed_order("d", df.schema["d"].dataType, "i")
        got = df.withColumn("o", order).orderBy("o")
        if kind == "date":  # days only: those of one day tie
            got = got.where("place < 200 or place >= 400")
        places = [r.place for r in got.select("place").collect()]
        assert places == sorted(places), kind
        assert df.where(order.isNull()).count() == 0


def test_latest_by_date_is_the_first_by_window(spark):
    rng = random.Random(5)
    rows_ = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, "2020-01-01", "2020-01-02", "2021-05-05 10:00:00"]), rng.choice([None, 1.5, 2.5]), rng.random() < 0.5) for i in range(200)]
    rows_ += [(500, 9, None, 1.0, True), (501, 9, None, 2.0, None)]
    df = spark.createDataFrame(rows_, "id long, k int, d string, v double, flag boolean").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = metrics.latest_by_date(df, "k", "d", "id")
    want = metrics.latest_per_key(df, "k", [F.desc("d"), F.desc("id")])
    assert got.columns == df.columns and rows(got) == rows(want)
    texts = df.withColumn("note", F.concat(F.lit("n"), "id"))
    assert rows(metrics.latest_by_date(texts, "k", "d", "id")) == rows(metrics.latest_per_key(texts, "k", [F.desc("d"), F.desc("id")]))


def test_latest_by_date_does_not_sort(mk):
    m = mk.measures([(1, 1, 0, 5), (2, 1, 0, 7), (3, 2, 4, 7)])
    plan = cohort.latest_measure(m)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "Window" not in plan

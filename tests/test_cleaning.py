"""Cleaning operators: W10 dedup, W11 key recovery, W12 normalisation, W13 valid measures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from churnscope.functions.text import normalize_text
from churnscope.operators import audit, cleaning
from churnscope.plans import cohort
from conftest import person, rows, ts


def test_f1_null_row_dropped_by_dedup(mk):
    p = mk.people([person(1), (None,) * 7])
    out = cohort.dedup_people(p)
    assert rows(out, "person_id") == [(1,)]


def test_f2_same_person_twice_keeps_lowest_id(mk):
    p = mk.people([person(7, role="Desk A"), person(3, role="DESK A ")])
    out = cohort.dedup_people(p)
    assert rows(out, "person_id", "role_raw") == [(3, "DESK A ")]


def test_f3_null_key_part_compares_equal(mk):
    p = mk.people([person(5, start=None), person(2, start=None), person(9, name="Bob")])
    out = cohort.dedup_people(p)
    assert rows(out, "person_id") == [(2,), (9,)]


def test_dedup_idempotent_and_lossless(mk):
    p = mk.people([person(i, name=f"n{i % 4}", start=i % 3) for i in range(1, 30)] + [(None,) * 7])
    once = cohort.dedup_people(p)
    twice = cohort.dedup_people(once)
    assert rows(once) == rows(twice)
    dropped = p.count() - once.count()
    dups = audit.duplicate_groups(p.where("person_id is not null"), cohort.NATURAL_KEY)
    extra = dups.agg(F.sum(F.col("occurrences") - 1)).first()[0] or 0
    assert dropped == 1 + extra  # the NULL row plus every duplicate beyond the first


def test_dedup_plan_limits_before_shuffle(mk):
    p = mk.people([person(1), person(2)])
    plan = cohort.dedup_people(p)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_f4_normalize_text(spark):
    df = spark.createDataFrame([(" Desk A ",), ("DESK A",), (None,), ("\tDesk A",)], "r string")
    out = [r[0] for r in df.select(normalize_text("r")).collect()]
    assert out == ["desk a", "desk a", None, "\tdesk a"]


def test_f5_null_and_sentinel_recovered(mk):
    p = mk.people(
        [person(1, unit=2, role="Desk B"), person(2, name="x", unit=None, role="desk b "),
         person(3, name="y", unit=99, role="DESK B")]
    )
    out = cohort.clean_people(p, mk.units())
    assert rows(out, "person_id", "clean_unit_id", "clean_role") == [
        (1, 2, "desk b"), (2, 2, "desk b"), (3, 2, "desk b")]


def test_f6_unrecoverable_sentinel_is_null(mk):
    p = mk.people([person(1, unit=1, role="Desk A"), person(2, name="x", unit=99, role="Lonely")])
    out = cohort.clean_people(p, mk.units())
    assert rows(out, "person_id", "clean_unit_id") == [(1, 1), (2, None)]


def test_f7_non_sentinel_orphan_kept_unless_valid_only(mk):
    p = mk.people([person(1, unit=3, role="Desk C"), person(2, name="x", unit=98, role="Desk C")])
    units = mk.units()
    kept = cohort.clean_people(p, units)
    assert rows(kept, "person_id", "clean_unit_id") == [(1, 3), (2, 98)]
    fixed = cohort.clean_people(p, units, valid_only=True)
    assert rows(fixed, "person_id", "clean_unit_id") == [(1, 3), (2, 3)]
    orphans = audit.orphan_keys(p, units, "unit_id")
    assert rows(orphans) == [(98, "orphan", 1)]


def test_f8_ambiguous_role_takes_smallest_valid_key(mk):
    p = mk.people(
        [person(1, name="a", unit=3, role="Desk Z"), person(2, name="b", unit=2, role="desk z"),
         person(3, name="c", unit=None, role="DESK Z")]
    )
    out = cohort.clean_people(p, mk.units())
    assert rows(out.where("person_id = 3"), "clean_unit_id") == [(2,)]
    v = audit.fd_violations(p, "role_raw", "unit_id", mk.units(), determinant_name="role", count="n")
    assert rows(v) == [("desk z", 2)]


def test_f9_evidence_from_dropped_duplicate(mk):
    # The only row saying 'Desk Q' belongs to unit 2 is the duplicate (higher id).
    p = mk.people([person(1, unit=None, role="Desk Q"), person(2, unit=2, role="DESK Q")])
    out = cohort.clean_people(p, mk.units())
    assert rows(out, "person_id", "clean_unit_id") == [(1, 2)]


def test_impute_only_replaces_bad_keys(mk):
    p = mk.people([person(1, unit=1, role="R"), person(2, name="b", unit=2, role="r")])
    out = cleaning.impute_key_by_fd(p, "unit_id", "role_raw", mk.units(), sentinels=(99,), output="k")
    # Both keys are valid; the role maps to two units but nothing is replaced.
    assert rows(out, "person_id", "k") == [(1, 1), (2, 2)]


def test_f10_valid_measures(mk):
    m = mk.measures([(1, 1, 0, None), (2, 1, 1, 0), (3, 1, 2, -1), (4, 1, 3, 0.01)])
    assert audit.invalid_measure_count(m, "amount").first()[0] == 3
    assert rows(cleaning.valid_measures(m, "amount"), "measure_id", "amount") == [(4, Decimal("0.01"))]


def test_f11_latest_invalid_falls_back(mk):
    m = mk.measures([(1, 1, 0, 100), (2, 1, 5, None), (3, 1, 9, -5)])
    out = cohort.latest_measure(m)
    assert rows(out, "measure_id") == [(1,)]


def test_f12_tie_on_date_goes_to_higher_id(mk):
    m = mk.measures([(10, 1, 3, 100), (11, 1, 3, 200), (5, 1, 1, 300)])
    assert rows(cohort.latest_measure(m), "measure_id", "amount") == [(11, Decimal("200.00"))]


def test_f20_empty_inputs(mk):
    p, u = mk.people([]), mk.units([])
    assert cohort.clean_people(p, u).count() == 0
    assert cohort.latest_measure(mk.measures([])).count() == 0
    assert audit.invalid_measure_count(mk.measures([]), "amount").first()[0] == 0


def test_entry_start_ts_preserved(mk):
    p = mk.people([person(1, start=4)])
    assert rows(cohort.clean_people(p, mk.units()), "start_ts") == [(ts(4),)]

"""The staged fact-table report gives the same results as the standalone queries."""

from __future__ import annotations

import os

import pytest

from churnscope.catalog import QUERIES
from churnscope.plans import cohort, report
from churnscope.sources.tables import table_reader
from conftest import DATA_ROOT, person, rows

SF = os.path.join(DATA_ROOT, "sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_report_equals_standalone_queries(spark):
    inputs = cohort.CohortInputs.from_tables(table_reader(spark, SF))
    out = report.cohort_report(inputs, staged=True)
    assert set(out) == {"rate_by_group", "split_rate_by_group", "rate_by_rating", "salary_gap",
                        "mean_elapsed_by_group"}
    for key, df in out.items():
        expected = QUERIES[key](spark, SF)
        assert df.columns == expected.columns, key
        assert rows(df) == rows(expected), key


def test_report_edge_cases(mk):
    people = [person(1, unit=1, status="Terminated"), person(2, name="b", unit=1, start=None),
              person(3, name="c", unit=99, role="Lonely"), person(4, name="d", unit=2, rating=None),
              person(5, name="e", unit=3)]
    # person 1 has an undated third exit; unit 3's only exit is undated
    e = mk.exits([(10, 1, 400, "Voluntary"), (11, 1, 30, "Involuntary"), (12, 2, 9, "Voluntary"),
                  (13, 3, 9, "Voluntary"), (14, 1, None, "Voluntary"), (15, 5, None, "Voluntary")])
    m = mk.measures([(1, 1, 0, 10), (2, 3, 0, 20), (3, 4, 0, None)])
    inputs = cohort.CohortInputs(people=mk.people(people), units=mk.units(), exits=e, measures=m)
    got = report.cohort_report(inputs, staged=False)
    clean = cohort.clean_people(inputs.people, inputs.units)
    want = {
        "rate_by_group": cohort.attrition_by_unit(clean, inputs.units, e),
        "split_rate_by_group": cohort.attrition_by_unit_and_type(clean, inputs.units, e),
        "rate_by_rating": cohort.attrition_by_rating(clean, inputs.units, e),
        "salary_gap": cohort.measure_gap_by_role(clean, m),
        "mean_elapsed_by_group": cohort.tenure_before_exit_by_unit(clean, inputs.units, e),
    }
    for key, df in want.items():
        assert rows(got[key]) == rows(df), key

"""Differential test: Spark operators vs the oracle SQL on random messy inputs.

Hypothesis draws role tables with every defect the toolkit handles
(duplicates, NULL / sentinel / orphan units, role spellings, NULL ratings,
date ties, several and undated exits, invalid amounts). DuckDB runs the
oracle SQL bodies on exactly those rows; Spark runs the operators.
"""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pandas as pd
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from churnscope.operators import audit
from churnscope.plans import cohort
from churnscope.oracle import sql as oracle
from conftest import person, rows, ts
from tools.oracle_check import _canon

ROLES = ["Desk A", "desk a", "DESK A ", "Desk B", "desk b ", "Desk C", None]

people_st = st.lists(
    st.tuples(
        st.sampled_from(["ann", "bob", "cy", None]),
        st.sampled_from([0, 1, None]),
        st.sampled_from([1, 2, 3, 99, 98, None]),
        st.sampled_from(ROLES),
        st.sampled_from([1, 2, 5, None]),
        st.sampled_from(["Active", "Terminated"]),
    ),
    min_size=1,
    max_size=14,
)
exits_st = st.lists(
    st.tuples(st.integers(1, 16), st.sampled_from([3, 400, None]),
              st.sampled_from(["Voluntary", "Involuntary"])),
    max_size=8,
)
measures_st = st.lists(
    st.tuples(st.integers(1, 16), st.integers(0, 2), st.sampled_from([None, 0, -3, 10, 25, 31])),
    max_size=14,
)

# key -> Spark result from the role tables (p, u, e, m)
SPARK = {
    "audit_orphan_keys": lambda p, u, e, m: audit.orphan_keys(p, u, "unit_id"),
    "audit_invalid_measure": lambda p, u, e, m: audit.invalid_measure_count(m, "amount"),
    "audit_missing_match": lambda p, u, e, m: audit.missing_match_count(
        p, e, "person_id", where=p["status"] == cohort.TERMINATED),
    "audit_duplicate_groups": lambda p, u, e, m: audit.duplicate_groups(p, cohort.NATURAL_KEY),
    "audit_fd_violations": lambda p, u, e, m: audit.fd_violations(
        p, "role_raw", "unit_id", u, determinant_name="clean_role", count="unit_count"),
    "clean_dedup": lambda p, u, e, m: cohort.dedup_people(p),
    "clean_entities": lambda p, u, e, m: cohort.clean_people(p, u),
    "latest_per_key": lambda p, u, e, m: cohort.latest_measure(m),
    "quality_report": lambda p, u, e, m: cohort.quality(p, cohort.clean_people(p, u), m),
    "rate_by_group": lambda p, u, e, m: cohort.attrition_by_unit(cohort.clean_people(p, u), u, e),
    "split_rate_by_group": lambda p, u, e, m: cohort.attrition_by_unit_and_type(
        cohort.clean_people(p, u), u, e),
    "rate_by_rating": lambda p, u, e, m: cohort.attrition_by_rating(cohort.clean_people(p, u), u, e),
    "salary_gap": lambda p, u, e, m: cohort.measure_gap_by_role(cohort.clean_people(p, u), m),
    "mean_elapsed_by_group": lambda p, u, e, m: cohort.tenure_before_exit_by_unit(
        cohort.clean_people(p, u), u, e),
}


def _oracle(key: str, tables: dict[str, pd.DataFrame]):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(f"{name}_src", pdf)
    # Typed views, so empty inputs keep their column types.
    con.execute("""CREATE VIEW people AS SELECT CAST(person_id AS BIGINT) person_id,
        CAST(person_name AS VARCHAR) person_name, CAST(start_ts AS TIMESTAMP) start_ts,
        CAST(unit_id AS INTEGER) unit_id, CAST(role_raw AS VARCHAR) role_raw,
        CAST(rating AS BIGINT) rating, CAST(status AS VARCHAR) status FROM people_src""")
    con.execute("""CREATE VIEW units AS SELECT CAST(unit_id AS INTEGER) unit_id,
        CAST(unit_name AS VARCHAR) unit_name FROM units_src""")
    con.execute("""CREATE VIEW exits AS SELECT CAST(exit_id AS BIGINT) exit_id,
        CAST(person_id AS BIGINT) person_id, CAST(exit_ts AS TIMESTAMP) exit_ts,
        CAST(exit_type AS VARCHAR) exit_type FROM exits_src""")
    con.execute("""CREATE VIEW measures AS SELECT CAST(measure_id AS BIGINT) measure_id,
        CAST(person_id AS BIGINT) person_id, CAST(effective_ts AS TIMESTAMP) effective_ts,
        CAST(amount AS DECIMAL(12,2)) amount FROM measures_src""")
    cur = con.execute(f"WITH {oracle.CLEANING}\n{oracle.BODIES[key]}")
    return [d[0] for d in cur.description], cur.fetchall()


def _pdf(records, columns):
    return pd.DataFrame.from_records(records, columns=columns).astype(object)


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(people=people_st, exits=exits_st, measures=measures_st)
def test_operators_match_oracle_sql(mk, people, exits, measures):
    p_rows = [person(i + 1, name, start, unit, role, rating, status)
              for i, (name, start, unit, role, rating, status) in enumerate(people)]
    p_rows.append((None,) * 7)
    u_rows = [(1, "Sales"), (2, "Legal"), (3, "Ops")]
    e_rows = [(100 + i, pid, day, typ) for i, (pid, day, typ) in enumerate(exits)]
    m_rows = [(200 + i, pid, day, amt) for i, (pid, day, amt) in enumerate(measures)]
    p, u = mk.people(p_rows), mk.units(u_rows)
    e, m = mk.exits(e_rows), mk.measures(m_rows)

    day = lambda d: None if d is None else ts(d)
    tables = {
        "people": _pdf(p_rows, ["person_id", "person_name", "start_ts", "unit_id", "role_raw",
                                "rating", "status"]),
        "units": _pdf(u_rows, ["unit_id", "unit_name"]),
        "exits": _pdf([(a, b, day(c), d) for a, b, c, d in e_rows],
                      ["exit_id", "person_id", "exit_ts", "exit_type"]),
        "measures": _pdf([(a, b, day(c), None if x is None else Decimal(x)) for a, b, c, x in m_rows],
                         ["measure_id", "person_id", "effective_ts", "amount"]),
    }
    for key, build in SPARK.items():
        df = build(p, u, e, m)
        got = [tuple(r) for r in df.collect()]
        cols, want = _oracle(key, tables)
        assert sorted(df.columns) == sorted(cols), key
        assert _canon(df.columns, got) == _canon(cols, want), key


def test_oracle_harness_sees_planted_rows(mk):
    """The harness itself: a known input gives the known Q1 row on both engines."""
    p_rows = [person(1, "ann", 0, 1, "Desk A"), person(2, "bob", 0, 1, "desk a")]
    e_rows = [(10, 1, 3, "Voluntary")]
    tables = {
        "people": _pdf(p_rows, ["person_id", "person_name", "start_ts", "unit_id", "role_raw",
                                "rating", "status"]),
        "units": _pdf([(1, "Sales")], ["unit_id", "unit_name"]),
        "exits": _pdf([(10, 1, ts(3), "Voluntary")], ["exit_id", "person_id", "exit_ts", "exit_type"]),
        "measures": _pdf([], ["measure_id", "person_id", "effective_ts", "amount"]),
    }
    cols, want = _oracle("rate_by_group", tables)
    assert want == [("Sales", 2, 1, Decimal("50.00"))]
    got = SPARK["rate_by_group"](mk.people(p_rows), mk.units([(1, "Sales")]), mk.exits(e_rows), None)
    assert rows(got) == want

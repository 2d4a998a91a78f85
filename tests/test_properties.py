"""Randomised check of the whole clean -> rate flow against a brute-force model.

Hypothesis draws small messy people / exit tables; the model below computes
dedup, key recovery and per-unit rates by plain Python loops over the rows.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from churnscope.plans import cohort
from conftest import rows, ts

UNITS = [(1, "Sales"), (2, "Legal"), (3, "Ops")]
ROLES = ["Desk A", "desk a", "DESK B ", "Desk C", None]

person_st = st.tuples(
    st.integers(1, 40),  # id
    st.sampled_from(["ann", "bob", "cy", None]),  # name
    st.sampled_from([0, 1, None]),  # start day
    st.sampled_from([1, 2, 3, None, 99, 98]),  # unit
    st.sampled_from(ROLES),
)


def _model(people, exits):
    by_key = {}
    for p in sorted((p for p in people if p[0] is not None), key=lambda p: p[0]):
        by_key.setdefault((p[1], p[2]), p)
    valid = {u for u, _ in UNITS}
    norm = lambda r: None if r is None else r.strip(" ").lower()
    evidence = {}
    for p in people:
        if p[4] is not None and p[3] in valid:
            k = norm(p[4])
            evidence[k] = min(evidence.get(k, p[3]), p[3])
    leavers = {e for e in exits}
    agg = {}
    for p in by_key.values():
        unit = p[3]
        if unit is None or unit == 99:
            unit = evidence.get(norm(p[4])) if p[4] is not None else None
        if unit not in valid:
            continue
        t, h = agg.get(unit, (0, 0))
        agg[unit] = (t + 1, h + (p[0] in leavers))
    names = dict(UNITS)
    out = []
    for u, (t, h) in agg.items():
        rate = (Decimal(h) * 100 / Decimal(t)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        out.append((names[u], t, h, rate))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    people=st.lists(person_st, max_size=25, unique_by=lambda p: p[0]),
    exits=st.lists(st.integers(1, 40), max_size=10),
)
def test_clean_and_rate_match_brute_force(mk, people, exits):
    rows_in = [
        (pid, name, None if day is None else ts(day), unit, role, 3, "Active")
        for pid, name, day, unit, role in people
    ]
    p = mk.people(rows_in + [(None,) * 7])
    u = mk.units(UNITS)
    e = mk.exits([(1000 + i, pid, 5, "Voluntary") for i, pid in enumerate(exits)])
    got = rows(cohort.attrition_by_unit(cohort.clean_people(p, u), u, e))
    assert got == _model([(r[0], r[1], r[2], r[3], r[4]) for r in people], exits)

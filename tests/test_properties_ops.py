"""Randomised checks of single operators against plain-Python models.

Each test draws small messy tables (NULLs, duplicates, ties, skewed keys)
and compares the Spark operator with a loop over the same rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnscope.operators import audit, metrics
from conftest import rows, ts

SETTINGS = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
small_key = st.one_of(st.none(), st.integers(0, 5))


def q2(x) -> Decimal | None:
    return None if x is None else Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


@SETTINGS
@given(
    child=st.lists(st.tuples(st.integers(0, 99), small_key), max_size=30),
    parent=st.lists(st.integers(0, 5), max_size=6),
)
def test_orphans_and_missing_matches(spark, child, parent):
    c = spark.createDataFrame(child, "id long, k long")
    p = spark.createDataFrame([(x,) for x in parent], "k long")
    want_orphans = Counter(k for _, k in child if k is None or k not in parent)
    assert rows(audit.orphan_keys(c, p, "k")) == rows(
        spark.createDataFrame(
            [(k, "null" if k is None else "orphan", n) for k, n in want_orphans.items()],
            "k long, kind string, rows long",
        )
    )
    assert audit.missing_match_count(c, p, "k").first()[0] == sum(want_orphans.values())
    assert rows(audit.missing_matches(c, p, "k")) == sorted(
        [r for r in child if r[1] is None or r[1] not in parent],
        key=lambda t: tuple((x is not None, x) for x in t),
    )


@SETTINGS
@given(
    data=st.lists(
        st.tuples(st.sampled_from(["A", "a ", " B", "b", None]), small_key, small_key), max_size=30
    )
)
def test_duplicates_and_fd_violations(spark, data):
    df = spark.createDataFrame(data, "det string, dep long, other long")
    groups = Counter((d, o) for d, _, o in data)
    assert rows(audit.duplicate_groups(df, ["det", "other"])) == sorted(
        [(d, o, n) for (d, o), n in groups.items() if n > 1],
        key=lambda t: tuple((x is not None, x) for x in t),
    )
    dim = [0, 1, 2, 3]
    deps = defaultdict(set)
    for d, dep, _ in data:
        if dep in dim:
            deps[None if d is None else d.strip(" ").lower()].add(dep)
    dim_df = spark.createDataFrame([(x,) for x in dim], "dep long")
    got = audit.fd_violations(df, "det", "dep", dim_df, count="n")
    assert rows(got) == sorted(
        [(d, len(v)) for d, v in deps.items() if len(v) > 1],
        key=lambda t: tuple((x is not None, x) for x in t),
    )


@SETTINGS
@given(
    data=st.lists(
        st.tuples(
            st.integers(0, 4),  # person
            st.integers(0, 3),  # day
            st.sampled_from([None, -5, 0, 7, 12, 30]),  # amount
            st.sampled_from(["Active", "Terminated"]),
        ),
        max_size=30,
    )
)
def test_latest_and_gap(spark, data):
    rows_in = [(i, p, ts(day), None if a is None else Decimal(a), s) for i, (p, day, a, s) in enumerate(data)]
    df = spark.createDataFrame(rows_in, "mid long, pid long, t timestamp_ntz, amount decimal(12,2), status string")
    valid = [r for r in rows_in if r[3] is not None and r[3] > 0]
    best = {}
    for r in valid:
        if r[1] not in best or (r[2], r[0]) > (best[r[1]][2], best[r[1]][0]):
            best[r[1]] = r
    latest = metrics.latest_per_key(df.where("amount > 0"), "pid", [F.desc("t"), F.desc("mid")])
    assert rows(latest, "mid") == sorted((r[0],) for r in best.values())

    group = lambda pid: pid % 2
    sums = defaultdict(lambda: {"Active": [], "Terminated": []})
    for r in best.values():
        sums[group(r[1])][r[4]].append(r[3])
    want = []
    for g, sides in sums.items():
        a = sum(sides["Active"]) / len(sides["Active"]) if sides["Active"] else None
        b = sum(sides["Terminated"]) / len(sides["Terminated"]) if sides["Terminated"] else None
        # Spark keeps 6 decimals in a decimal mean, as the original engine does.
        a6 = None if a is None else a.quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
        b6 = None if b is None else b.quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
        gap = None if a6 is None or b6 is None else a6 - b6
        want.append((g, q2(a6), q2(b6), q2(gap)))
    got = metrics.group_gap(latest.withColumn("g", F.col("pid") % 2), "g", "amount", "status",
                            "Active", "Terminated")
    assert rows(got) == sorted(want)


@SETTINGS
@given(
    pop=st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0, 5, None])), min_size=1, max_size=12),
    events=st.lists(
        st.tuples(st.integers(0, 15), st.sampled_from(["V", "I", None]), st.sampled_from([1, 40, None])),
        max_size=20,
    ),
)
def test_split_rate_and_elapsed(spark, pop, events):
    people = [(i, g, None if s is None else ts(s)) for i, (g, s) in enumerate(pop)]
    p = spark.createDataFrame(people, "id long, g long, start timestamp_ntz")
    e = spark.createDataFrame(
        [(pid, typ, None if d is None else ts(d)) for pid, typ, d in events],
        "id long, typ string, t timestamp_ntz",
    )
    ids = {r[0]: r for r in people}
    total = Counter(r[1] for r in people)
    typed = defaultdict(set)
    for pid, typ, _ in events:
        if pid in ids and typ is not None:
            typed[(ids[pid][1], typ)].add(pid)
    want_split = sorted(
        (g, total[g], typ, len(v), q2(Decimal(len(v)) * 100 / total[g])) for (g, typ), v in typed.items()
    )
    assert rows(metrics.split_rate_by_group(p, e, "id", "g", "typ")) == want_split

    spans = defaultdict(list)
    joined_groups = set()
    for pid, _, d in events:
        if pid in ids:
            joined_groups.add(ids[pid][1])
            if d is not None and ids[pid][2] is not None:
                spans[ids[pid][1]].append(d - (ids[pid][2] - ts(0)).days)
    want_elapsed = sorted(
        (g, q2(Decimal(sum(spans[g])) / (len(spans[g]) * 365)) if spans[g] else None)
        for g in joined_groups
    )
    got = metrics.mean_elapsed_by_group(p, e, "id", "g", "start", "t")
    assert rows(got) == want_elapsed

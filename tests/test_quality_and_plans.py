"""W14 quality report; plan assertions over every registered query; staging."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from churnscope.catalog import QUERIES
from churnscope.plans import cohort, staging
from churnscope.sources import bindings
from churnscope.sources.tables import table_reader
from conftest import DATA_ROOT, EVENT_LOG_DIR, person, rows
from evlog import table_scans

SF_SMALL = os.path.join(DATA_ROOT, "sf0.001")


def test_quality_report_lines(mk):
    p = mk.people([person(1), person(2), person(3, name="b", unit=99, role="Lonely"), (None,) * 7])
    m = mk.measures([(1, 1, 0, 5), (2, 1, 1, None), (3, 1, 2, -1)])
    clean = cohort.clean_people(p, mk.units())
    out = {r.check_name: (r.actual, r.expected, r.passed) for r in cohort.quality(p, clean, m).collect()}
    assert out == {
        "raw_people": (4, None, None),
        "clean_people": (2, 2, True),
        "remaining_bad_units": (1, 0, False),
        "raw_measures": (3, None, None),
        "clean_measures": (1, 1, True),
    }


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_is_jvm_only_and_has_no_cartesian(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{key}: {bad}"


def test_flagship_plan_shape(spark):
    plan = _plan(QUERIES["rate_by_group"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan  # dedup limits before its shuffle
    assert "BroadcastHashJoin" in plan  # the small dimension is broadcast by size
    assert "PushedFilters: [IsNotNull(n_nationkey)]" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["audit_invalid_measure"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["unit_name", "total", "leavers", "rate"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize(
    "key", ["rate_by_group", "split_rate_by_group", "rate_by_rating", "mean_elapsed_by_group", "audit_missing_match", "salary_gap"]
)
def test_orders_are_read_once(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and "o_orderdate" in line]
    assert len(scans) == 1, final


def test_null_keys_do_not_read_orders(spark):
    assert "o_custkey" not in _plan(QUERIES["audit_null_keys"](spark, SF_SMALL))


def test_quality_report_can_fail(mk):
    p = mk.people([person(1), person(2), person(3, name="b")])
    m = mk.measures([(1, 1, 0, 5), (2, 1, 1, None)])
    clean = cohort.clean_people(p, mk.units())
    broken = cohort.quality(p, clean.unionByName(clean), m, clean_measure_rows=m)
    out = {r.check_name: (r.actual, r.expected, r.passed) for r in broken.collect()}
    assert out["clean_people"] == (4, 2, False)
    assert out["clean_measures"] == (2, 1, False)


def test_quality_report_given_counts(mk):
    p, m = mk.people([person(1)]), mk.measures([(1, 1, 0, 5)])
    out = cohort.quality(p, cohort.clean_people(p, mk.units()), m, given={"raw_people": 1, "raw_measures": 2})
    assert {r.check_name: r.passed for r in out.collect()}["raw_people"] is True
    assert {r.check_name: r.passed for r in out.collect()}["raw_measures"] is False


def test_stage_round_trip(spark, mk):
    p = mk.people([person(1), person(2, name="b")])
    staged = staging.stage(p, "test-people")
    assert rows(staged) == rows(p)
    assert staging.checkpoint_root(spark)


def test_staged_files_are_deleted(spark, mk):
    with staging.staged_files():
        staged = staging.stage(mk.people([person(1)]), "test-gone")
        assert staged.count() == 1
        path = staged.inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


@pytest.mark.parametrize("key", ["quality_report", "salary_gap"])
def test_raw_tables_are_scanned_once(spark, key):
    with staging.staged_files():
        spark.sparkContext.setJobGroup(f"scans-{key}", key)
        QUERIES[key](spark, SF_SMALL).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        reads = table_scans(EVENT_LOG_DIR, f"scans-{key}")
    assert reads["orders"] == 1, reads
    assert key != "quality_report" or reads["customer"] == 1, reads


def test_staged_quality_notices_a_broken_view(spark, monkeypatch):
    inputs = lambda: cohort.CohortInputs.from_tables(table_reader(spark, SF_SMALL), staged=True)
    with staging.staged_files():
        good = {r.check_name: tuple(r)[1:] for r in cohort.staged_quality(inputs()).collect()}
        lazy = cohort.CohortInputs.from_tables(table_reader(spark, SF_SMALL))
        want = cohort.quality(lazy.people, cohort.clean_people(lazy.people, lazy.units), lazy.measures)
        assert good == {r.check_name: tuple(r)[1:] for r in want.collect()}
        monkeypatch.setattr(bindings, "valid_measure", lambda c: F.col(c).isNotNull())
        monkeypatch.setattr(cohort, "clean_people", lambda p, *a, **k: p.withColumn("clean_unit_id", p["unit_id"]))
        bad = {r.check_name: r.passed for r in cohort.staged_quality(inputs()).collect()}
    assert bad["clean_measures"] is bad["clean_people"] is bad["remaining_bad_units"] is False


def test_staged_inputs_give_the_same_metrics(spark):
    with staging.staged_files():
        i = cohort.CohortInputs.from_tables(table_reader(spark, SF_SMALL), staged=True)
        clean = cohort.clean_people(i.people, i.units)
        assert rows(cohort.measure_gap_by_role(clean)) == rows(QUERIES["salary_gap"](spark, SF_SMALL))
        assert rows(cohort.attrition_by_unit(clean, i.units, i.exits)) == rows(QUERIES["rate_by_group"](spark, SF_SMALL))
        assert rows(cohort.measure_gap_by_role(clean, i.measures)) == rows(QUERIES["salary_gap"](spark, SF_SMALL))


def test_counts_are_taken_while_staging(spark, mk):
    with staging.staged_files():
        staged = staging.stage(mk.people([person(1), person(2)]), "test-counted", counts={"n": F.count(F.lit(1)), "top": F.max("person_id")})
        assert staging.staged_counts(staged) == {"n": 2, "top": 2}
        empty = staging.stage(mk.people([]), "test-counted", counts={"n": F.count(F.lit(1)), "top": F.max("person_id")})
        assert staging.staged_counts(empty) == {"n": 0, "top": None}


def test_a_cluster_without_a_shared_folder_fails(spark):
    def session(master):
        context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            staging.shared_root(session(master))
    for master in ("local", "local[8]", "local[*]"):
        assert os.path.isdir(staging.shared_root(session(master)))
    assert staging.shared_root(spark) == staging.checkpoint_root(spark).rstrip("/")

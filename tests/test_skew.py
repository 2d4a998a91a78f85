"""A key holding a third of all rows is reduced before it is shuffled.

The inputs are the driver tables with one hot key planted; the event log
shows how many rows each stage wrote to the shuffle.
"""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from churnscope.operators import audit, cleaning
from churnscope.plans import cohort, staging
from churnscope.sources import bindings
from churnscope.sources.tables import table_reader
from conftest import DATA_ROOT, EVENT_LOG_DIR
from evlog import stage_metrics

SF = os.path.join(DATA_ROOT, "sf0.01")
MAP_TASKS = 8

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _written_after_repartition(group: str, total: int) -> int:
    """Shuffle rows written by the stages that read the repartitioned input."""
    stats = stage_metrics(EVENT_LOG_DIR, group)
    return sum(s["written"] for s in stats.values() if s["read"] == total)


def test_dedup_hot_natural_key(spark):
    people = bindings.people(table_reader(spark, SF)).where("person_id IS NOT NULL")
    hot = F.col("person_id") % 3 == 0
    skewed = people.select(
        "person_id",
        F.when(hot, None).otherwise(F.col("person_name")).alias("person_name"),
        F.when(hot, None).otherwise(F.col("start_ts")).alias("start_ts"),
        "unit_id", "role_raw", "rating", "status",
    ).repartition(MAP_TASKS)
    total = people.count()
    n_hot = people.where(hot).count()
    assert n_hot * 3 >= total - 3

    spark.sparkContext.setJobGroup("skew-dedup", "hot natural key")
    cohort.dedup_people(skewed).write.format("noop").mode("overwrite").save()
    written = _written_after_repartition("skew-dedup", total)
    # Every hot row but one per map task stays on the map side.
    assert 0 < written <= total - n_hot + MAP_TASKS


def test_latest_hot_person(spark):
    m = bindings.measures(table_reader(spark, SF))
    hot = F.col("measure_id") % 3 == 0
    skewed = m.withColumn("person_id", F.when(hot, F.lit(-1)).otherwise(F.col("person_id")))
    skewed = skewed.repartition(MAP_TASKS)
    valid = m.where("amount > 0")
    total_valid = valid.count()
    n_hot = valid.where(hot).count()

    spark.sparkContext.setJobGroup("skew-latest", "hot person")
    out = cohort.latest_measure(skewed)
    out.write.format("noop").mode("overwrite").save()
    stats = stage_metrics(EVENT_LOG_DIR, "skew-latest")
    written = sum(s["written"] for s in stats.values() if s["tasks"] == MAP_TASKS and s["written"])
    assert 0 < written <= total_valid - n_hot + MAP_TASKS
    assert out.where("person_id = -1").count() == 1


FORCE_SHUFFLE_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _run_with_conf(spark, conf, group, df):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        df.write.format("noop").mode("overwrite").save()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return stage_metrics(EVENT_LOG_DIR, group)


def test_missing_match_null_heavy_key_is_spread(spark):
    t = table_reader(spark, SF)
    people = bindings.people(t).where("person_id IS NOT NULL")
    null_key = F.col("person_id") % 3 == 0
    # Staged, as the operator's docstring advises: both branches are scans.
    left = staging.stage(
        people.withColumn("person_id", F.when(null_key, None).otherwise(F.col("person_id"))),
        "skew-anti-left",
    )
    right = staging.stage(bindings.exits(t), "skew-anti-right")
    n_left = people.count()
    n_null = people.where(null_key).count()
    stats = _run_with_conf(
        spark, FORCE_SHUFFLE_JOINS, "skew-anti", audit.missing_matches(left, right, "person_id")
    )
    # Only keyed rows go through the join shuffle, spread over its tasks.
    shuffled = [s for s in stats.values() if s["read"]]
    assert sum(s["read"] for s in shuffled) <= n_left - n_null + right.count()
    assert all(s["max_read"] < n_null * 0.8 for s in shuffled), stats
    out = audit.missing_matches(left, right, "person_id")
    assert out.where("person_id IS NULL").count() == n_null


def test_key_recovery_hot_role_is_split(spark):
    """With the role map too big to broadcast, a role held by a third of the
    people still spreads over many join tasks (salted lookup)."""
    t = table_reader(spark, SF)
    people = bindings.people(t)
    hot = F.col("person_id") % 3 == 0
    skewed = people.withColumn(
        "role_raw", F.when(hot, F.lit("Desk NATION_7")).otherwise(F.col("role_raw"))
    )
    n_people = people.where("person_id IS NOT NULL").count()
    n_hot = people.where(hot).count()
    # At test scale a "hot" determinant is one with more than 25 rows (about 21 salts
    # for the hot role, so their hashes cover the 8 partitions).
    stats = _run_with_conf(
        spark, FORCE_SHUFFLE_JOINS, "skew-role",
        cohort.clean_people(skewed, bindings.units(t), rows_per_salt=25),
    )
    # The stage joining deduplicated people (about n_people rows) with the salted map.
    # The result stage joins the deduplicated people with the salted role map.
    join_stage = stats[max(stats)]
    assert join_stage["tasks"] == 8 and join_stage["written"] == 0
    assert join_stage["read"] >= n_people - 30
    # Unsalted, one task would read every person of the hot role.
    assert join_stage["max_read"] < n_hot * 0.8, join_stage


def test_salted_lookup_equals_plain_left_join(spark):
    df = spark.createDataFrame(
        [(i, k) for i, k in enumerate(["a"] * 9 + ["b"] * 3 + [None] * 5 + ["zz"] * 4 + ["c"])],
        "id long, k string",
    )
    lookup = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int")
    plain = df.join(lookup, "k", "left")
    for rows_per_salt in (1, 2, 100):
        salted = cleaning.salted_lookup(df, lookup, "k", salt_by="id", rows_per_salt=rows_per_salt)
        assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=str) == sorted(
            map(tuple, plain.select("id", "k", "v").collect()), key=str
        )


def test_key_recovery_null_roles_are_spread(spark):
    """A third of the people without a role: they can never match the role
    map and are spread over many join tasks instead of meeting in one."""
    t = table_reader(spark, SF)
    people = bindings.people(t)
    no_role = F.col("person_id") % 3 == 0
    skewed = people.withColumn("role_raw", F.when(no_role, None).otherwise(F.col("role_raw")))
    n_people = people.where("person_id IS NOT NULL").count()
    n_null = people.where(no_role).count()
    stats = _run_with_conf(
        spark, FORCE_SHUFFLE_JOINS, "skew-null-role", cohort.clean_people(skewed, bindings.units(t))
    )
    join_stage = stats[max(stats)]
    assert join_stage["tasks"] == 8 and join_stage["written"] == 0
    assert join_stage["read"] >= n_people - 30
    assert join_stage["max_read"] < n_null * 0.8, join_stage

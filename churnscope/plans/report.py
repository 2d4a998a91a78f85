"""All five cohort metrics from one staged per-person fact table.

Run one by one, each metric re-does the dedup, the key recovery and a join
of people to events on ``person_id``. ``person_facts`` does that work once:
clean people, their exits reduced to one row per person and their latest
valid measure meet in one sort-merge join stage on ``person_id`` (the exit
aggregate and the latest-measure window are already partitioned on it, so
people are shuffled once). After staging, every metric is a scan of one
narrow table plus a partial aggregation; the only join left is between two
aggregates of a few rows (Q2).

Results equal the standalone queries (``tests/test_report.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import day_number
from churnscope.operators import metrics
from churnscope.plans import cohort
from churnscope.plans.staging import stage


METRIC_KEYS = (
    "rate_by_group",
    "split_rate_by_group",
    "rate_by_rating",
    "salary_gap",
    "mean_elapsed_by_group",
)


def person_facts(
    clean: DataFrame, units: DataFrame, exits: DataFrame, measures: DataFrame
) -> DataFrame:
    """One row per clean person.

    ``exit_types`` is the sorted set of the person's exit types: bounded by
    the number of exit types, not by the data (partial aggregation keeps it
    that small on the map side too). ``exit_days`` is the summed calendar
    days from start to each dated exit, ``exit_spans`` the number of such
    spans (NULL without a start date); both are exact integers.
    """
    per_person = exits.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_exits"),
        F.count(day_number("exit_ts")).alias("n_dated"),
        F.sum(day_number("exit_ts")).alias("exit_day_sum"),
        F.array_sort(F.collect_set("exit_type")).alias("exit_types"),
    )
    latest = cohort.latest_measure(measures).select(
        "person_id", F.col("amount").alias("latest_amount")
    )
    unit_cols = units.select("unit_id", "unit_name")
    people = clean.join(unit_cols, clean["clean_unit_id"] == unit_cols["unit_id"], "left")
    start = day_number("start_ts")
    return (
        people.join(per_person, "person_id", "left")
        .join(latest, "person_id", "left")
        .select(
            "person_id",
            "clean_role",
            "rating",
            "status",
            "unit_id",
            "unit_name",
            F.coalesce(F.col("n_exits") > 0, F.lit(False)).alias("has_exit"),
            "exit_types",
            (F.col("exit_day_sum") - F.col("n_dated") * start).alias("exit_days"),
            F.when(start.isNotNull(), F.col("n_dated")).alias("exit_spans"),
            "latest_amount",
        )
    )


def metrics_from_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """The five metrics, named like the registered queries, from the fact table."""
    unit = ["unit_id", "unit_name"]
    in_unit = facts.where(F.col("unit_id").isNotNull())
    hit = F.col("has_exit")
    names = {"total": "total", "hits": "leavers", "rate": "rate"}
    by_unit = metrics.rate_of(in_unit, unit, hit, **names)
    split = metrics.split_rate_of(in_unit, unit, "exit_types", "exit_type", **names)
    by_rating = metrics.rate_of(in_unit.where(F.col("rating").isNotNull()), ["rating"], hit, **names)
    gap = metrics.group_gap(
        facts.where(F.col("latest_amount").isNotNull()), "clean_role", "latest_amount", "status",
        cohort.ACTIVE, cohort.TERMINATED, names=("avg_stayers", "avg_leavers", "gap"),
    )
    tenure = metrics.mean_elapsed_of(in_unit.where(hit), unit, F.col("exit_days"), F.col("exit_spans"))
    return {
        "rate_by_group": by_unit.orderBy(F.desc("rate"), "unit_name", "unit_id").select(
            "unit_name", "total", "leavers", "rate"
        ),
        "split_rate_by_group": split.orderBy("unit_name", "exit_type", "unit_id").select(
            "unit_name", "total", "exit_type", "leavers", "rate"
        ),
        "rate_by_rating": by_rating.orderBy(F.desc("rate"), "rating"),
        "salary_gap": gap.orderBy(F.asc_nulls_first("gap"), "clean_role"),
        "mean_elapsed_by_group": tenure.orderBy(F.asc_nulls_first("mean_years"), "unit_name", "unit_id").select(
            "unit_name", "mean_years"
        ),
    }


def cohort_report(inputs: cohort.CohortInputs, staged: bool = True) -> dict[str, DataFrame]:
    """Clean once, build the fact table, stage it (cut lineage), derive all metrics."""
    clean = cohort.clean_people(inputs.people, inputs.units)
    facts = person_facts(clean, inputs.units, inputs.exits, inputs.measures)
    if staged:
        facts = stage(facts, "person_facts")
    return metrics_from_facts(facts)

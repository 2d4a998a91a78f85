"""Registered queries: one per work item, each ``(spark, data_dir) -> DataFrame``.

Every query reads the driver tables (through the bindings) in full; none
works on a subset, a sample or a fixed literal input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.text import normalize_text
from churnscope.operators import audit, cleaning
from churnscope.plans import cohort
from churnscope.plans.cohort import CohortInputs
from churnscope.sources import bindings
from churnscope.sources.tables import SCHEMAS, footer_reader, table_reader

QueryFn = Callable[[SparkSession, str], DataFrame]


def _inputs(spark: SparkSession, root: str) -> CohortInputs:
    return CohortInputs.from_tables(table_reader(spark, root))


def _clean(i: CohortInputs) -> DataFrame:
    return cohort.clean_people(i.people, i.units)


# ------------------------------------------------------------------ audit


def audit_row_counts(spark, root):
    i = _inputs(spark, root)
    return audit.row_counts({"people": i.people, "measures": i.measures, "exits": i.exits})


def audit_table_counts(spark, root):
    """Every raw table, counted from its files' footers."""
    read = footer_reader(spark, root)
    return audit.row_counts({name: read(name) for name in SCHEMAS})


def audit_preview(spark, root):
    return audit.preview(_inputs(spark, root).people, 10, F.col("person_id").asc_nulls_first())


def audit_reference_table(spark, root):
    return audit.preview(_inputs(spark, root).units, None)


def audit_distinct_values(spark, root):
    return audit.distinct_values(_inputs(spark, root).people, "role_raw")


def audit_distinct_units(spark, root):
    return audit.distinct_values(_inputs(spark, root).people, "unit_id")


def audit_distinct_counts(spark, root):
    return audit.distinct_values(_inputs(spark, root).people, "unit_id", counts=True)


def audit_distinct_ratings(spark, root):
    return audit.distinct_values(_inputs(spark, root).people, "rating")


def audit_orphan_keys(spark, root):
    i = _inputs(spark, root)
    return audit.orphan_keys(i.people, i.units, "unit_id")


def audit_invalid_measure(spark, root):
    return audit.invalid_measure_count(_inputs(spark, root).measures, "amount")


def audit_missing_match(spark, root):
    i = _inputs(spark, root)
    return audit.missing_match_count(
        i.people, i.exits, "person_id", where=F.col("status") == cohort.TERMINATED
    )


def audit_missing_rows(spark, root):
    i = _inputs(spark, root)
    missing = audit.missing_matches(i.people, i.exits, "person_id", where=F.col("status") == cohort.TERMINATED)
    return missing.select("person_id", "person_name", "status")


def audit_unlabeled_documents(spark, root):
    t = table_reader(spark, root)
    return audit.missing_match_count(t("documents"), t("labels"), "doc_id")


def audit_duplicate_groups(spark, root):
    return audit.duplicate_groups(_inputs(spark, root).people, cohort.NATURAL_KEY)


def audit_duplicate_lineitems(spark, root):
    return audit.duplicate_groups(table_reader(spark, root)("lineitem"), ["l_orderkey", "l_linenumber"])


def audit_null_keys(spark, root):
    people = bindings.people(table_reader(spark, root), null_keys_only=True)
    return audit.null_key_rows(people, "person_id")


def audit_fd_violations(spark, root):
    i = _inputs(spark, root)
    return audit.fd_violations(
        i.people, "role_raw", "unit_id", i.units,
        determinant_name="clean_role", count="unit_count",
    )


def audit_fd_violations_part(spark, root):
    return audit.fd_violations(
        table_reader(spark, root)("part"), "p_brand", "p_type",
        determinant_name="brand", count="type_count",
    )


def audit_fd_violations_dim(spark, root):
    """Part brand -> size, only sizes that are also a nation's key: a non-empty answer through a dimension."""
    t = table_reader(spark, root)
    return audit.fd_violations(
        t("part"), "p_brand", "p_size", t("nation"), "n_nationkey",
        determinant_name="brand", count="size_count",
    )


# ------------------------------------------------------------------ cleaning


def clean_dedup(spark, root):
    return cohort.dedup_people(_inputs(spark, root).people)


def clean_impute_key(spark, root):
    i = _inputs(spark, root)
    return cleaning.impute_key_by_fd(
        cohort.dedup_people(i.people), "unit_id", "role_raw", i.units,
        source=i.people, sentinels=cohort.SENTINEL_UNITS, output="clean_unit_id",
        salt_by="person_id",
    ).select("person_id", "unit_id", "clean_unit_id")


def clean_impute_key_valid_only(spark, root):
    """Every key outside the dimension is bad; here those are the 99s, not listed as a sentinel."""
    i = _inputs(spark, root)
    return cleaning.impute_key_by_fd(
        cohort.dedup_people(i.people), "unit_id", "role_raw", i.units,
        source=i.people, valid_only=True, output="clean_unit_id", salt_by="person_id",
    ).select("person_id", "unit_id", "clean_unit_id")


def clean_normalize_text(spark, root):
    return _inputs(spark, root).people.select(
        "person_id", "role_raw", normalize_text("role_raw").alias("clean_role")
    )


def clean_entities(spark, root):
    return _clean(_inputs(spark, root))


def clean_distinct_values(spark, root):
    return audit.distinct_values(_clean(_inputs(spark, root)), "clean_role")


def clean_measures(spark, root):
    return cohort.clean_measures(_inputs(spark, root).measures)


def latest_per_key(spark, root):
    return cohort.latest_measure(_inputs(spark, root).measures)


def quality_report(spark, root):
    return cohort.staged_quality(CohortInputs.from_tables(table_reader(spark, root), staged=True))


# ------------------------------------------------------------------ metrics


def rate_by_group(spark, root):
    i = _inputs(spark, root)
    return cohort.attrition_by_unit(_clean(i), i.units, i.exits)


def split_rate_by_group(spark, root):
    i = _inputs(spark, root)
    return cohort.attrition_by_unit_and_type(_clean(i), i.units, i.exits)


def rate_by_rating(spark, root):
    i = _inputs(spark, root)
    return cohort.attrition_by_rating(_clean(i), i.units, i.exits)


def salary_gap(spark, root):
    i = _inputs(spark, root)
    return cohort.measure_gap_by_role(cohort.clean_people(i.measured_people, i.units))


def mean_elapsed_by_group(spark, root):
    i = _inputs(spark, root)
    return cohort.tenure_before_exit_by_unit(_clean(i), i.units, i.exits)


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in [
        audit_row_counts,
        audit_table_counts,
        audit_preview,
        audit_reference_table,
        audit_distinct_values,
        audit_distinct_units,
        audit_distinct_ratings,
        audit_distinct_counts,
        audit_orphan_keys,
        audit_invalid_measure,
        audit_missing_match,
        audit_missing_rows,
        audit_unlabeled_documents,
        audit_duplicate_groups,
        audit_duplicate_lineitems,
        audit_null_keys,
        audit_fd_violations,
        audit_fd_violations_part,
        audit_fd_violations_dim,
        clean_dedup,
        clean_impute_key,
        clean_impute_key_valid_only,
        clean_normalize_text,
        clean_entities,
        clean_distinct_values,
        clean_measures,
        latest_per_key,
        quality_report,
        rate_by_group,
        split_rate_by_group,
        rate_by_rating,
        salary_gap,
        mean_elapsed_by_group,
    ]
}

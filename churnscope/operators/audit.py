"""Audit operators (W1-W9): read-only checks on raw tables.

Every check is a distributed aggregation or join; results are small tables
(one row per check, per bad key or per duplicate group), never the input
pulled to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions._cols import as_col, as_list
from churnscope.functions.text import BINARY, normalize_text, text_key


def row_counts(
    tables: Mapping[str, DataFrame], name: str = "table_name", count: str = "row_count"
) -> DataFrame:
    """One row per table with its row count (W1). Each count is a global
    aggregate: per-partition partial counts plus one tiny final merge. Plain Parquet
    tables read by ``sources.tables.footer_reader`` are counted from their footers."""
    parts = [
        df.agg(F.count(F.lit(1)).alias(count)).select(F.lit(t).alias(name), count)
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(
    df: DataFrame, n: int | None = 10, order_by: Column | str | Sequence[Column | str] | None = None
) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (W2); ``n=None`` is the whole table.

    With an order and a limit Spark plans TakeOrderedAndProject: a per-task
    top-n and a merge of ``n x tasks`` rows, never a full sort.
    """
    if order_by is not None:
        cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        df = df.orderBy(*[as_col(c) for c in cols])
    return df if n is None else df.limit(n)


def distinct_values(df: DataFrame, column: str, counts: bool = False, count: str = "rows") -> DataFrame:
    """Sorted distinct values of a column, NULL included as one value.
    With ``counts`` each value carries its frequency."""
    out = (
        df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
        if counts
        else df.select(column).distinct()
    )
    return out.orderBy(F.col(column).asc_nulls_first())


def orphan_keys(
    child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None, count: str = "rows"
) -> DataFrame:
    """Foreign-key values of ``child`` that are NULL or absent from ``parent``.

    One row per bad value: (fk, kind in {'null', 'orphan'}, rows). The child
    is first reduced to one row per key value (partial aggregation, so a hot
    or NULL key collapses map-side); only that small table meets the parent.
    """
    keyed = child.groupBy(fk).agg(F.count(F.lit(1)).alias(count))
    parents = parent.select(F.col(pk or fk).alias("__pk"))
    return (
        keyed.join(parents, keyed[fk] == parents["__pk"], "left_anti")
        .select(
            fk,
            F.when(F.col(fk).isNull(), F.lit("null")).otherwise(F.lit("orphan")).alias("kind"),
            count,
        )
        .orderBy(F.col(fk).asc_nulls_first())
    )


def invalid_measure_count(df: DataFrame, column: str, name: str = "bad_rows") -> DataFrame:
    """Count of rows whose measure is NULL or not positive."""
    c = F.col(column)
    return df.agg(F.count_if(c.isNull() | (c <= 0)).alias(name))


def missing_matches(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Rows of ``left`` (optionally filtered) without a match in ``right``.

    Same result as ``LEFT JOIN ... WHERE right.key IS NULL``, planned as an
    anti join: no fan-out, and only the key column of ``right`` is read. A
    NULL key never matches, and an audited table may hold a third of its
    rows with a NULL key; those rows go around the join (no shuffle at all)
    instead of all hashing into one join task. ``left`` is read once per
    branch, so stage it first if it is expensive to compute. A hot non-NULL
    key is left to AQE's skew-join split (the right side is a plain shuffle).
    """
    if where is not None:
        left = left.where(where)
    key = F.col(on)
    keys = right.select(F.col(right_on or on).alias("__rk"))
    matched_side = left.where(key.isNotNull())
    unmatched = matched_side.join(keys, matched_side[on] == keys["__rk"], "left_anti")
    return unmatched.unionByName(left.where(key.isNull()))


def missing_match_count(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str | None = None,
    where: Column | None = None,
    name: str = "missing",
) -> DataFrame:
    """Count of left rows with no match on the right.

    Both sides are reduced to one row per key value before they meet (left
    with its row count), so the join is bounded by the number of distinct
    keys, and a NULL or hot key costs one partial row per map task.
    """
    if where is not None:
        left = left.where(where)
    per_key = left.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    keys = right.select(F.col(right_on or on).alias("__rk")).distinct()
    missing = per_key.join(keys, per_key[on] == keys["__rk"], "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0).cast("long")).alias(name))


def duplicate_groups(
    df: DataFrame, keys: str | Sequence[str], name: str = "occurrences", collation: str = BINARY
) -> DataFrame:
    """Natural-key groups with more than one row (W7); NULL key parts compare equal.

    Under a case-folding ``collation`` a group shows its keys in lower case."""
    return (
        df.groupBy(*[text_key(df, k, collation).alias(k) for k in as_list(keys)])
        .agg(F.count(F.lit(1)).alias(name))
        .where(F.col(name) > 1)
    )


def null_key_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is NULL."""
    return df.where(F.col(key).isNull())


def fd_violations(
    df: DataFrame,
    determinant: str,
    dependent: str,
    dim: DataFrame | None = None,
    dim_key: str | None = None,
    *,
    normalize: bool = True,
    determinant_name: str | None = None,
    count: str = "dependent_count",
) -> DataFrame:
    """Determinant values mapping to more than one dependent value.

    The determinant is normalised (``lower(trim())``) unless
    ``normalize=False``; with ``dim`` only dependents present in it count
    (the reference's inner join to the dimension, done as a semi join so a
    duplicated dimension key cannot fan out). Empty result: the dependency
    holds and imputation through it is safe.

    First each determinant's smallest and largest dependent are compared, a
    partial + final aggregation with a state of constant size: where they are equal
    the dependency holds, whatever the dimension, and the determinant is done. Only rows of the
    others send their distinct pairs, which meet the dimension before they are counted, so a
    dependent that most rows share is one row a determinant there. ``df`` is read twice.
    """
    det_name = determinant_name or determinant
    det = normalize_text(determinant) if normalize else F.col(determinant)
    pairs = df.select(det.alias(det_name), F.col(dependent).alias("__dep"))
    # Null-safe: rows without a determinant are a determinant of their own.
    least, most = F.min("__dep"), F.max("__dep")
    suspects = pairs.groupBy(F.col(det_name).alias("__det")).agg(least.alias("__least"), most.alias("__most")).where("__least <> __most")
    suspects = suspects.select(F.coalesce("__det", F.lit("")).alias("__det"), F.col("__det").isNull().alias("__none"))
    own = (F.coalesce(det_name, F.lit("")) == F.col("__det")) & (F.col(det_name).isNull() == F.col("__none"))
    pairs = pairs.join(suspects, own, "left_semi").distinct()
    if dim is not None:
        keys = dim.select(F.col(dim_key or dependent).alias("__dk"))
        pairs = pairs.join(keys, pairs["__dep"] == keys["__dk"], "left_semi")
    return (
        pairs.groupBy(det_name)
        .agg(F.count("__dep").alias(count))
        .where(F.col(count) > 1)
    )

"""Cleaning operators (W10, W11, W13). Raw inputs are never modified: every
operator returns a new DataFrame, like the reference's views."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions._cols import as_col, as_list
from churnscope.functions.salting import row_hash
from churnscope.functions.text import BINARY, normalize_text, text_key

_RN = "__rn"
MAX_HOT = 10_000


def dedup_keep_first(
    df: DataFrame,
    keys: str | Sequence[str],
    order_by: Column | str | Sequence[Column | str],
    require: str | Iterable[str] = (),
    collation: str = BINARY,
) -> DataFrame:
    """Keep one row per natural key: the first one by ``order_by``.

    Rows with a NULL in any ``require`` column are dropped first (the garbage
    row). NULL parts of the natural key compare equal, so such rows share a
    group. Make ``order_by`` total (end it with a unique id) for a
    deterministic result; ``dropDuplicates`` makes no promise about which row
    stays. ``collation``: whether text keys that differ in case are the same.

    Plan: ``row_number() = 1`` becomes WindowGroupLimit partial (before the
    shuffle) + final. Each map task keeps one row per key, so a natural key
    holding a third of the table reaches the reducer as one row per map
    task, never as a third of the table.
    """
    for c in as_list(require):
        df = df.where(F.col(c).isNotNull())
    orders = [as_col(c) for c in ([order_by] if isinstance(order_by, (str, Column)) else order_by)]
    w = Window.partitionBy(*[text_key(df, k, collation) for k in as_list(keys)]).orderBy(*orders)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def fd_map(
    source: DataFrame,
    determinant: str,
    key: str,
    dim: DataFrame,
    dim_key: str | None = None,
    normalize: bool = True,
) -> DataFrame:
    """``normalised determinant -> min(valid key)`` over ``source``.

    Columns ``__det``, ``__imputed`` and ``__n`` (rows of ``source`` with
    that determinant, which sizes the salting of hot determinants). Only
    keys present in ``dim`` count as evidence. The source is reduced to one
    row per (determinant, key) before it meets the dimension, so neither a hot
    determinant nor a hot or NULL key reaches the join as more than one row a
    pair.
    """
    det = normalize_text(determinant) if normalize else F.col(determinant)
    valid = dim.select(F.col(dim_key or key).alias("__valid"))
    rows = source.select(det.alias("__det"), F.col(key).alias("__key")).where(
        F.col("__det").isNotNull()
    )
    pairs = rows.groupBy("__det", "__key").agg(F.count(F.lit(1)).alias("__pair"))
    return (
        pairs.join(valid.distinct(), pairs["__key"] == valid["__valid"], "left")
        .groupBy("__det")
        .agg(F.min("__valid").alias("__imputed"), F.sum("__pair").alias("__n"))
    )


def salted_lookup(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    *,
    counts: DataFrame | None = None,
    salt_by: str | Sequence[str] | None = None,
    rows_per_salt: int = 1_000_000,
) -> DataFrame:
    """Left join ``df`` to ``lookup`` (one row per ``key``) with hot keys split.

    ``counts`` (``key``, ``__n``) gives the rows of ``df`` per key, or an
    upper bound; by default it is computed from ``df``. A key with more than
    ``rows_per_salt`` rows is hot and gets ``ceil(n / rows_per_salt)``
    salts: its rows take the salt ``pmod(xxhash64(salt_by), salts)`` and its
    lookup row is replicated once per salt, so each join task receives about
    ``rows_per_salt`` rows of it however large it is. Other keys keep salt 0
    and are not replicated. NULL keys never match; their salt is their whole
    hash, so they spread evenly however many there are.

    Hot keys are the ``MAX_HOT`` largest of those over ``rows_per_salt``: any
    other holds less than 1 / ``MAX_HOT`` of the rows. So the hot-key table has
    a constant bound and is broadcast explicitly; the lookup itself is left to
    AQE (broadcast when its measured size is small, otherwise a sort-merge join
    on (key, salt)). Salts are row hashes, not random, so recomputed partitions
    reproduce them.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(
        counts.where(F.col("__n") > rows_per_salt)
        .orderBy(F.desc("__n"), key)
        .limit(MAX_HOT)
        .select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / F.lit(rows_per_salt)).alias("__salts"))
    )
    k = F.col(key)
    left = df.withColumn("__h", row_hash(df, salt_by)).join(hot, k == F.col("__hot"), "left")
    salt = (
        F.when(k.isNull(), F.col("__h"))
        .when(F.col("__salts").isNotNull(), F.pmod(F.col("__h"), F.col("__salts")))
        .otherwise(F.lit(0).cast("long"))
    )
    left = left.withColumn("__salt", salt).drop("__h", "__hot", "__salts")
    replicas = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__salts"), F.lit(1).cast("long")) - 1)
    right = (
        lookup.join(hot, k == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(replicas))
        .drop("__hot", "__salts")
    )
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def impute_key_by_fd(
    df: DataFrame,
    key: str,
    determinant: str,
    dim: DataFrame,
    *,
    dim_key: str | None = None,
    source: DataFrame | None = None,
    sentinels: Sequence = (),
    valid_only: bool = False,
    output: str | None = None,
    normalize: bool = True,
    salt_by: str | Sequence[str] | None = None,
    rows_per_salt: int = 1_000_000,
) -> DataFrame:
    """Recover a bad foreign key through a functional dependency.

    A key is bad when NULL or one of ``sentinels`` (with ``valid_only``: also
    when absent from ``dim``). A bad key is replaced by the smallest valid
    key seen on any row of ``source`` (default ``df``; pass the raw,
    undeduplicated table to use all evidence; it must contain ``df``'s rows)
    whose normalised determinant equals this row's; no evidence gives NULL.
    Any other key is kept as is, including orphans that are not sentinels
    unless ``valid_only``.

    Plan: the evidence map is one row per determinant, with the number of
    source rows behind it. Only rows with a bad key carry their determinant
    into the lookup; the others go through it with a NULL key, which never
    matches and spreads evenly. AQE broadcasts the map when its measured size
    is small. Otherwise the join is a shuffle join, and AQE cannot split a hot
    determinant there (the map side is an aggregate, not a bare shuffle), so
    the join is salted in proportion to each determinant's row count
    (``salted_lookup``); ``salt_by`` should be a unique column.
    """
    output = output or key
    evidence = fd_map(source if source is not None else df, determinant, key, dim, dim_key, normalize)
    det = normalize_text(determinant) if normalize else F.col(determinant)
    bad = F.col(key).isNull()
    if sentinels:
        bad = bad | F.col(key).isin(list(sentinels))
    out = df
    if valid_only:
        known = (
            dim.select(F.col(dim_key or key).alias(key)).distinct().withColumn("__known", F.lit(True))
        )
        out = salted_lookup(out, known, key, salt_by=salt_by, rows_per_salt=rows_per_salt)
        bad = bad | F.col("__known").isNull()
    # The row counts cost one more narrow aggregation of the source (the
    # determinant column only); when no determinant is hot, AQE finds the
    # broadcast hot-key table empty and removes its joins.
    out = salted_lookup(
        out.withColumn("__bad", bad).withColumn("__det", F.when(F.col("__bad"), det)),
        evidence.select("__det", "__imputed"),
        "__det",
        counts=evidence.select("__det", "__n"),
        salt_by=salt_by,
        rows_per_salt=rows_per_salt,
    )
    return out.withColumn(
        output, F.when(F.col("__bad"), F.col("__imputed")).otherwise(F.col(key))
    ).drop("__det", "__imputed", "__known", "__bad")


def valid_measure(column: str) -> Column:
    """Whether a measure is present and positive. ``x > 0`` is NULL, so not true, for NULL."""
    return F.col(column) > 0


def valid_measures(df: DataFrame, column: str) -> DataFrame:
    """Rows whose measure is present and positive."""
    return df.where(valid_measure(column))

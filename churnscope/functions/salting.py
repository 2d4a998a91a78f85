"""Deterministic salts for spreading hot join keys over many partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.functions._cols import as_list


def row_hash(df: DataFrame, by: str | Sequence[str] | None = None) -> Column:
    """``xxhash64`` of ``by`` (default: every column that can be hashed; maps cannot).

    A hash of the row rather than ``rand()``: when an executor is lost and a
    partition is recomputed, every row gets the same salt again, so the
    shuffle it feeds stays consistent.
    """
    cols = (
        as_list(by)
        if by is not None
        else [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    )
    return F.xxhash64(*[F.col(c) for c in cols])


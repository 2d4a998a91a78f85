"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.functions._cols import as_col


def normalize_text(col: Column | str) -> Column:
    """``lower(trim(col))``: folds case and strips surrounding spaces.

    NULL stays NULL. Like SQL TRIM, only the space character is stripped;
    tabs and other whitespace are kept.
    """
    return F.lower(F.trim(as_col(col)))


#: How natural keys and flags compare: byte by byte, or with case folded, as
#: MySQL's usual default collations do.
BINARY, CASE_INSENSITIVE = "binary", "case_insensitive"


def text_key(df: DataFrame, column: str, collation: str = BINARY) -> Column:
    """``column`` as it takes part in grouping and equality under ``collation``."""
    if collation not in (BINARY, CASE_INSENSITIVE):
        raise ValueError(f"collation must be {BINARY!r} or {CASE_INSENSITIVE!r}, not {collation!r}")
    folds = collation == CASE_INSENSITIVE and isinstance(df.schema[column].dataType, T.StringType)
    return F.lower(F.col(column)) if folds else F.col(column)

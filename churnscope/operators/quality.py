"""Quality report (W14): the verification counts after cleaning as one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Side = Sequence[tuple[DataFrame, Mapping[str, Column]]]


def _rows(df: DataFrame, counts: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """(check_name, actual, expected) rows of all counts over one DataFrame, in one pass over it."""
    named = [(check, side, c) for check, sides in counts.items() for side, c in sides.items()]
    row = df.agg(*[c.cast("long").alias(f"c{i}") for i, (_, _, c) in enumerate(named)])
    at = {(check, side): F.col(f"c{i}") for i, (check, side, _) in enumerate(named)}
    none = F.lit(None).cast("long")
    lines = [
        F.struct(F.lit(check).alias("check_name"), *[at.get((check, side), none).alias(side) for side in ("actual", "expected")])
        for check in counts
    ]
    return row.select(F.inline(F.array(*lines)))


def quality_report(actual: Side, expected: Side = (), given: Mapping[str, int] | None = None, counted: Mapping[str, int] | None = None) -> DataFrame:
    """(check_name, actual, expected, passed) rows.

    ``actual`` counts the tables under test, ``expected`` counts what they must
    equal, from other tables; all counts over one DataFrame share one pass.
    ``counted`` has actual counts that were taken before, such as those observed
    while a table was written; ``given`` states expected counts outright and
    wins. A check without an expected count has NULL there and in ``passed``.
    """
    passes: dict[int, tuple[DataFrame, dict[str, dict[str, Column]]]] = {}
    for side, tables in (("actual", actual), ("expected", expected)):
        for df, checks in tables:
            counts = passes.setdefault(id(df), (df, {}))[1]
            for check, c in checks.items():
                counts.setdefault(check, {})[side] = c
    parts = [_rows(df, counts) for df, counts in passes.values()]
    if counted:
        spark = (actual or expected)[0][0].sparkSession
        lines = ", ".join(f"('{check}', {int(n)}L, CAST(NULL AS BIGINT))" for check, n in counted.items())
        parts.append(spark.sql(f"SELECT * FROM VALUES {lines} AS t(check_name, actual, expected)"))
    found = reduce(DataFrame.unionByName, parts)
    # A row or two per check come together.
    out = found.groupBy("check_name").agg(F.max("actual").alias("actual"), F.max("expected").alias("expected"))
    for name, count in (given or {}).items():
        out = out.withColumn("expected", F.when(F.col("check_name") == name, F.lit(count).cast("long")).otherwise(F.col("expected")))
    return out.withColumn("passed", F.col("actual") == F.col("expected"))

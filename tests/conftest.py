from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from churnscope.plans.staging import checkpoint_root, ensure_checkpoint_dir  # noqa: E402
from churnscope.session import build_session  # noqa: E402
from churnscope.sources.bindings import AMOUNT_TYPE, PEOPLE_SCHEMA  # noqa: E402

UNITS_SCHEMA = T.StructType(
    [T.StructField("unit_id", T.IntegerType()), T.StructField("unit_name", T.StringType())]
)
EXITS_SCHEMA = T.StructType(
    [
        T.StructField("exit_id", T.LongType()),
        T.StructField("person_id", T.LongType()),
        T.StructField("exit_ts", T.TimestampNTZType()),
        T.StructField("exit_type", T.StringType()),
    ]
)
MEASURES_SCHEMA = T.StructType(
    [
        T.StructField("measure_id", T.LongType()),
        T.StructField("person_id", T.LongType()),
        T.StructField("effective_ts", T.TimestampNTZType()),
        T.StructField("amount", AMOUNT_TYPE),
    ]
)

DATA_ROOT = "/root/testdata"


EVENT_LOG_DIR = tempfile.mkdtemp(prefix="churnscope-events-")


@pytest.fixture(scope="session")
def spark():
    # The event log (task metrics) lets tests check where rows travel.
    s = build_session(
        master="local[*]",
        shuffle_partitions=8,
        app="churnscope-tests",
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": EVENT_LOG_DIR,
            "spark.eventLog.compress": "false",
        },
    )
    # Only when the session names no checkpoint folder (as on a laptop).
    if not checkpoint_root(s):
        ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="churnscope-ckpt-"))
    yield s


def ts(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hour)


def person(pid, name="Ann", start=0, unit=1, role="Desk A", rating=3, status="Active"):
    return (pid, name, None if start is None else ts(start), unit, role, rating, status)


@pytest.fixture
def mk(spark):
    class Maker:
        def people(self, rows):
            return spark.createDataFrame(rows, PEOPLE_SCHEMA)

        def units(self, rows=((1, "Sales"), (2, "Legal"), (3, "Ops"))):
            return spark.createDataFrame(list(rows), UNITS_SCHEMA)

        def exits(self, rows):
            return spark.createDataFrame(
                [(eid, pid, None if day is None else ts(day), typ) for eid, pid, day, typ in rows],
                EXITS_SCHEMA,
            )

        def measures(self, rows):
            return spark.createDataFrame(
                [
                    (mid, pid, ts(day), None if amt is None else Decimal(str(amt)))
                    for mid, pid, day, amt in rows
                ],
                MEASURES_SCHEMA,
            )

    return Maker()


def rows(df, *cols):
    """Sorted list of tuples (None sorts first) for order-insensitive checks."""
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))

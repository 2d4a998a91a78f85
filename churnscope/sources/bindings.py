"""Input roles of the toolkit, derived from the driver tables.

The toolkit works on four roles:

* ``units``    (unit_id, unit_name)                      -- the dimension
* ``people``   (person_id, person_name, start_ts, unit_id, role_raw, rating, status)
* ``exits``    (exit_id, person_id, exit_ts, exit_type)   -- one event per leaver
* ``measures`` (measure_id, person_id, effective_ts, amount decimal(12,2))

The driver tables are clean, so defects are planted by key arithmetic: NULL
and orphaned unit keys, case/space variants of a role, NULL ratings,
duplicate persons under a new id, a fully NULL row, terminated persons
without an exit row and invalid amounts. Every rule is a Spark SQL expression
over the scanned tables, so the roles grow with the data and never pass
through the driver. ``churnscope.oracle.sql`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.operators.cleaning import valid_measure
from churnscope.sources.tables import TableReader

# Planted-defect rules of the bindings (FIXTURES.md section 4).
# The oracle SQL repeats them literally.
NULL_UNIT_MOD, NULL_UNIT_REM = 33, 1  # unit_id NULL
ORPHAN_UNIT_MOD, ORPHAN_UNIT_REM, ORPHAN_UNIT = 50, 2, 99  # unit_id 99
ROLE_CASE_MOD = 8  # remainder 0 upper, 1 lower, 2 trailing space
NULL_RATING_MOD, NULL_RATING_REM = 24, 3  # rating NULL
RATING_LEVELS = 5  # rating = 1 + key % 5
DUP_MOD, DUP_REM = 68, 5  # duplicate person copies
PERSON_IDS = 2  # person_id = 2 * customer key, of its copy 2 * key + 1: no copy meets another customer
EXIT_GAP_MOD, EXIT_GAP_REM = 97, 4  # terminated but no exit row
INVOLUNTARY_PRIORITIES = ("1-URGENT", "2-HIGH")
BAD_MEASURE_MOD = 100  # remainder 0 NULL, 1 zero, 2 negative
ROLE_PREFIX = "Desk "
TERMINATED, ACTIVE = "Terminated", "Active"

AMOUNT_TYPE = T.DecimalType(12, 2)

PEOPLE_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("person_name", T.StringType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("unit_id", T.IntegerType()),
        T.StructField("role_raw", T.StringType()),
        T.StructField("rating", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


def units(tables: TableReader) -> DataFrame:
    return tables("nation").select(
        F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit_name")
    )


_AMOUNT = f"""CASE o_orderkey % {BAD_MEASURE_MOD}
                 WHEN 0 THEN CAST(NULL AS {AMOUNT_TYPE.simpleString()})
                 WHEN 1 THEN CAST(0 AS {AMOUNT_TYPE.simpleString()})
                 WHEN 2 THEN CAST(-o_totalprice AS {AMOUNT_TYPE.simpleString()})
                 ELSE CAST(o_totalprice AS {AMOUNT_TYPE.simpleString()}) END"""


def order_history(tables: TableReader) -> DataFrame:
    """One row per customer key: what people, exits and measures say of it, in one pass over the orders.

    ``first_ts`` and ``last`` (the latest order) make people and exits, ``latest``
    is the latest valid measure (date desc, key desc), ``n_measures`` and
    ``n_valid`` count measures. Every aggregate is partial + final, so a customer
    holding a third of all orders is reduced map-side before the shuffle; those that a
    query does not use are pruned.
    """
    amounts = tables("orders").selectExpr("*", f"{_AMOUNT} AS amount")
    valid = valid_measure("amount")
    return amounts.groupBy("o_custkey").agg(
        F.expr("min(o_orderdate) AS first_ts"),
        F.expr("max(struct(o_orderdate, o_orderkey, o_orderstatus, o_orderpriority)) AS last"),
        F.max(F.when(valid, F.struct("o_orderdate", "o_orderkey", "amount"))).alias("latest"),
        F.count(F.lit(1)).alias("n_measures"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(F.expr("amount IS NULL OR amount <= 0")).alias("n_bad"),
    )


def order_summary(tables: TableReader, history: DataFrame | None = None) -> DataFrame:
    """``order_history`` (or a staged one) of the customers with a key."""
    # Both roles filter on the key and on the id made of it; stated here, the filters are the
    # same for both and so is the exchange.
    history = order_history(tables) if history is None else history
    return history.where(f"o_custkey IS NOT NULL AND {PERSON_IDS} * o_custkey IS NOT NULL")


# The rules below are SQL expression strings: one JVM call parses a whole
# projection, where the same rules as Column objects cost one call per node.
_ROLE = f"concat('{ROLE_PREFIX}', n_name)"
_PEOPLE_BASE = (
    f"{PERSON_IDS} * c_custkey AS person_id",
    "c_name AS person_name",
    # The first date is never after the last; both are read, as ``exits`` does (one exchange).
    "least(first_ts, last.o_orderdate) AS start_ts",
    f"""CASE WHEN c_custkey % {NULL_UNIT_MOD} = {NULL_UNIT_REM} THEN CAST(NULL AS INT)
             WHEN c_custkey % {ORPHAN_UNIT_MOD} = {ORPHAN_UNIT_REM} THEN {ORPHAN_UNIT}
             ELSE c_nationkey END AS unit_id""",
    f"""CASE c_custkey % {ROLE_CASE_MOD} WHEN 0 THEN upper({_ROLE})
                                     WHEN 1 THEN lower({_ROLE})
                                     WHEN 2 THEN concat({_ROLE}, ' ')
                                     ELSE {_ROLE} END AS role_raw""",
    f"""CASE WHEN c_custkey % {NULL_RATING_MOD} = {NULL_RATING_REM} THEN CAST(NULL AS BIGINT)
             ELSE 1 + c_custkey % {RATING_LEVELS} END AS rating""",
    f"""CASE WHEN last.o_orderstatus = 'F' AND first_ts <= last.o_orderdate THEN '{TERMINATED}'
             ELSE '{ACTIVE}' END AS status""",
    # Duplicate persons: the same row again under the odd id with an
    # upper-case role; a generator keeps it to one pass over the rows.
    f"""explode(CASE WHEN c_custkey % {DUP_MOD} = {DUP_REM} THEN array(0, 1)
                     ELSE array(0) END) AS copy""",
)
# A copy has an id of its own, which no measure carries.
_LATEST = "CASE WHEN copy = 0 THEN latest.amount END AS latest_amount"
_PEOPLE_COPIES = (
    "person_id + copy AS person_id",
    "person_name",
    "start_ts",
    "unit_id",
    "CASE WHEN copy = 1 THEN upper(role_raw) ELSE role_raw END AS role_raw",
    "rating",
    "status",
)


def people(
    tables: TableReader, null_keys_only: bool = False, measured: bool = False, history: DataFrame | None = None
) -> DataFrame:
    """All people. ``null_keys_only``: those without a key, who by definition have
    no orders, so that the orders are not read for them. ``measured``: with
    ``latest_amount``, the amount of their latest valid measure, from the same pass
    over the orders. ``history``: a staged ``order_history`` to read instead of the orders."""
    cust = tables("customer")
    named = cust.join(tables("nation"), F.expr("c_nationkey = n_nationkey"))
    if null_keys_only:
        dated = named.where("c_custkey IS NULL").selectExpr(
            "*", "CAST(NULL AS TIMESTAMP_NTZ) AS first_ts", "named_struct('o_orderstatus', CAST(NULL AS STRING), 'o_orderdate', CAST(NULL AS TIMESTAMP_NTZ)) AS last"
        )
    else:
        dated = named.join(order_summary(tables, history), F.expr("c_custkey = o_custkey"), "left")
    extra = ("latest",) if measured else ()
    base = dated.selectExpr(*_PEOPLE_BASE, *extra).selectExpr(*_PEOPLE_COPIES, *(_LATEST,) * measured)
    # One fully NULL garbage row. As a VALUES row it adds no "is null" constraint to the union,
    # which would travel over joins into the other role's filters.
    fields = [*PEOPLE_SCHEMA.fields, *[T.StructField("latest_amount", AMOUNT_TYPE)] * measured]
    nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in fields)
    garbage = cust.sparkSession.sql(f"SELECT * FROM VALUES ({nulls}) AS t({', '.join(f.name for f in fields)})")
    return base.unionByName(garbage)


def exits(tables: TableReader, history: DataFrame | None = None) -> DataFrame:
    """Exit events: the latest order of a customer when it is finished ('F').

    An exit is never before the start; stating that here makes this role read
    the same columns of ``order_summary`` as ``people`` does, so a query that
    uses both shuffles the orders once (a reused exchange).
    """
    involuntary = ", ".join(f"'{p}'" for p in INVOLUNTARY_PRIORITIES)
    return (
        order_summary(tables, history)
        .where(
            f"""CASE WHEN last.o_orderstatus = 'F' AND first_ts <= last.o_orderdate
                     THEN o_custkey % {EXIT_GAP_MOD} <> {EXIT_GAP_REM} ELSE false END"""
        )
        .selectExpr(
            "last.o_orderkey AS exit_id",
            f"{PERSON_IDS} * o_custkey AS person_id",
            "last.o_orderdate AS exit_ts",
            f"""CASE WHEN last.o_orderpriority IN ({involuntary}) THEN 'Involuntary'
                     ELSE 'Voluntary' END AS exit_type""",
        )
    )


def measures(tables: TableReader) -> DataFrame:
    """Salary-like measures: one per order, with NULL / zero / negative amounts planted."""
    return tables("orders").selectExpr(
        "o_orderkey AS measure_id",
        f"{PERSON_IDS} * o_custkey AS person_id",
        "o_orderdate AS effective_ts",
        f"{_AMOUNT} AS amount",
    )

"""Tables in the HR layout of the original project, mapped onto the roles.

``employees``, ``departments``, ``salary_history`` and ``attrition`` with the
renaming only; the natural key of a person is (first_name, last_name,
hire_date). ``churnscope.plans.hr`` runs the original audit, cleaning and
five business questions on them and names the outputs as the original
queries do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.sources.tables import table_path

# Ids are wider than the original INT: a value past 2^31 must not turn into NULL.
_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()

# Table names, column names and types of the original HR layout,
# and the original natural key of a person. They must match for the tables of
# a user of the original scripts to load unchanged.
SCHEMAS: dict[str, T.StructType] = {
    "departments": T.StructType(
        [T.StructField("department_id", _L), T.StructField("department_name", _S)]
    ),
    "employees": T.StructType(
        [
            T.StructField("employee_id", _L),
            T.StructField("first_name", _S),
            T.StructField("last_name", _S),
            T.StructField("department_id", _L),
            T.StructField("job_role", _S),
            T.StructField("hire_date", _D),
            T.StructField("gender", _S),
            T.StructField("age", _I),
            T.StructField("performance_rating", _I),
            T.StructField("employment_status", _S),
        ]
    ),
    "salary_history": T.StructType(
        [
            T.StructField("salary_id", _L),
            T.StructField("employee_id", _L),
            T.StructField("salary_amount", T.DecimalType(12, 2)),
            T.StructField("effective_date", _D),
        ]
    ),
    "attrition": T.StructType(
        [
            T.StructField("attrition_id", _L),
            T.StructField("employee_id", _L),
            T.StructField("exit_date", _D),
            T.StructField("exit_type", _S),
            T.StructField("exit_reason", _S),
        ]
    ),
}

# original column -> role column
ROLE_NAMES: dict[str, dict[str, str]] = {
    "employees": {
        "employee_id": "person_id",
        "department_id": "unit_id",
        "job_role": "role_raw",
        "hire_date": "start_ts",
        "performance_rating": "rating",
        "employment_status": "status",
    },
    "departments": {"department_id": "unit_id", "department_name": "unit_name"},
    "salary_history": {
        "salary_id": "measure_id",
        "employee_id": "person_id",
        "salary_amount": "amount",
        "effective_date": "effective_ts",
    },
    "attrition": {"attrition_id": "exit_id", "employee_id": "person_id", "exit_date": "exit_ts"},
}

NATURAL_KEY = ("first_name", "last_name", "start_ts")


def read_hr_tables(spark: SparkSession, root: str, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """The four tables from ``root`` in any Spark file format (parquet, orc, csv, json).

    Text formats fail on a value that does not fit its column (``mode=FAILFAST``)
    instead of reading it as NULL; pass ``mode="PERMISSIVE"`` for Spark's default.
    Parquet tables are ``<name>.parquet``, others ``<name>``.
    """
    if fmt in ("csv", "json"):
        options = {"mode": "FAILFAST", **options}
    out = {}
    for name, schema in SCHEMAS.items():
        path = table_path(root, name, suffix=".parquet" if fmt == "parquet" else "")
        out[name] = spark.read.format(fmt).schema(schema).options(**options).load(path)
    return out


def as_roles(name: str, df: DataFrame) -> DataFrame:
    """Rename the original columns of table ``name`` to role columns; others stay."""
    names = ROLE_NAMES[name]
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])

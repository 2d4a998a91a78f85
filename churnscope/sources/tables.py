"""Readers for the input tables.

Schemas are declared up front instead of inferred: at scale, inference means
opening footers across thousands of files on the driver before any job runs.
Only the columns a query uses are read; Catalyst prunes the parquet
``ReadSchema`` to them and pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.TimestampNTZType(),
)


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(
        ("c_custkey", _L),
        ("c_name", _S),
        ("c_nationkey", _I),
        ("c_acctbal", _D),
        ("c_mktsegment", _S),
    ),
    "supplier": _schema(
        ("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)
    ),
    "part": _schema(
        ("p_partkey", _L),
        ("p_name", _S),
        ("p_brand", _S),
        ("p_type", _S),
        ("p_size", _I),
        ("p_retailprice", _D),
    ),
    "orders": _schema(
        ("o_orderkey", _L),
        ("o_custkey", _L),
        ("o_orderstatus", _S),
        ("o_totalprice", _D),
        ("o_orderdate", _TS),
        ("o_orderpriority", _S),
    ),
    "lineitem": _schema(
        ("l_orderkey", _L),
        ("l_partkey", _L),
        ("l_suppkey", _L),
        ("l_linenumber", _I),
        ("l_quantity", _D),
        ("l_extendedprice", _D),
        ("l_discount", _D),
        ("l_tax", _D),
        ("l_returnflag", _S),
        ("l_linestatus", _S),
        ("l_shipdate", _TS),
    ),
    "events": _schema(
        ("event_id", _L),
        ("ts", _TS),
        ("user_id", _L),
        ("event_type", _S),
        ("value", _D),
        ("props", _S),
    ),
    "documents": _schema(
        ("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)
    ),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
}

TableReader = Callable[[str], DataFrame]


def table_path(root: str, name: str, suffix: str = ".parquet") -> str:
    """``<root>/<name><suffix>``, a file or directory on any filesystem Spark reads.

    The layout is stated by ``suffix`` (empty for plain ``<root>/<name>``), not
    probed: the driver's own disk says nothing of the cluster's filesystem.
    """
    return f"{root.rstrip('/')}/{name}{suffix}"


def read_table(spark: SparkSession, root: str, name: str, suffix: str = ".parquet") -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(root, name, suffix))


def table_reader(spark: SparkSession, root: str, suffix: str = ".parquet") -> TableReader:
    """``name -> DataFrame`` for one data directory."""
    return lambda name: read_table(spark, root, name, suffix)


def footer_reader(spark: SparkSession, root: str, suffix: str = ".parquet") -> TableReader:
    """``name -> DataFrame`` whose unfiltered counts come from the Parquet footers.

    Spark pushes COUNT(*) into its second-generation file reader only, which a
    session has to choose for all its tables; so these are read in a session of their
    own, and the caller's settings stay as they are. Each task opens footers and returns
    a number per file; a filter or a column makes it an ordinary scan. The frames
    combine with others of the caller's session.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return lambda name: read_table(own, root, name, suffix)

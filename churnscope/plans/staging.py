"""Staging intermediate results to the shared checkpoint folder.

A staged DataFrame is written as parquet under ``spark.checkpoint.dir`` and
read back, which cuts the lineage: several metrics can share the cleaned
people without re-running the dedup, and a lost executor costs a re-read of
the staged files instead of a recomputation from the raw tables. The folder
must be shared storage on a cluster; only a session that runs in one process
falls back to a temporary folder of its machine.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Staged DataFrames by identity, with their paths and counts, until unstaged.
_STAGED: dict[int, tuple[DataFrame, str, dict[str, int]]] = {}


def checkpoint_root(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir`` (or set via setCheckpointDir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # no SparkContext on a Spark Connect session
            root = None
    return root or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint folder; set ``fallback`` only when none is set (tests)."""
    root = checkpoint_root(spark)
    if root:
        return root
    try:
        spark.sparkContext.setCheckpointDir(fallback)
    except Exception:  # Spark Connect: no SparkContext; a session conf instead
        spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def shared_root(spark: SparkSession) -> str:
    """The folder that all processes of the session share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (driver and executors are one process) gets a
    temporary folder; on a cluster that would lose what executors write, so it fails.
    """
    root = checkpoint_root(spark)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        root = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="churnscope-shared-"))
    return root.rstrip("/")


def stage(df: DataFrame, name: str, root: str | None = None, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the checkpoint folder and return a reader of it.

    ``counts``: aggregates over the rows written, taken by the job that writes
    them (``staged_counts`` has the results). They are observed in the writing
    stage itself, so a stage repeated after the loss of an executor counts nothing twice.
    """
    spark = df.sparkSession
    root = root.rstrip("/") if root else shared_root(spark)
    path = f"{root}/churnscope/{name}-{uuid.uuid4().hex}"
    schema, seen = df.schema, None
    if counts:
        seen = Observation()
        df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _STAGED[id(out)] = (out, path, seen.get if seen is not None else {})
    return out


def staged_counts(staged: DataFrame) -> dict[str, int]:
    """The counts taken while ``staged`` was written."""
    return _STAGED[id(staged)][2]


def unstage(*staged: DataFrame) -> None:
    """Delete the files of staged DataFrames; they can't be read any more."""
    for df in staged:
        _, path, _ = _STAGED.pop(id(df), (None, None, None))
        if path is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staged_files():
    """Deletes on leaving what was staged inside."""
    before = set(_STAGED)
    try:
        yield
    finally:
        for key in set(_STAGED) - before:
            unstage(_STAGED[key][0])

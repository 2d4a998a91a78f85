"""Helpers shared by the operators: tables, staging in the shared folder, id filters."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.plans.staging import shared_root

#: White space as every contract of this subpackage means it.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"

#: Most rows of a (id) table that is sent to every executor; 16 bytes a row in the joined form.
#: Tables over this bound meet the documents in a shuffled join instead.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/churnscope-llm/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables staged as Parquet in the shared folder; ``drop`` deletes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return shared_path(self.spark, name)

    def stage(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` once; the returned frame reads the files, so lineage ends here."""
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def where(self, staged: DataFrame) -> str:
        return self.paths[id(staged)]

    def drop(self, staged: Iterable[DataFrame]) -> None:
        for df in staged:
            if (path := self.paths.pop(id(df), None)) is not None:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def sized(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged, narrow) marked for broadcast if it has at most ``bound`` rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one staged column named like ``id_col``)."""
    return docs.join(sized(ids, bound=bound), id_col, "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids``; rows without an id stay."""
    return docs.join(sized(ids, bound=bound), id_col, "left_anti")


def text_digest(col: Column) -> Column:
    """SHA-256 of the text; null as empty."""
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)


def _keyed(docs: DataFrame, keys: dict[str, Column], rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are (not) a row of ``rows``; nulls are equal, other columns' names don't matter."""
    names = {k: f"__{k}_{uuid.uuid4().hex[:8]}" for k in keys}
    left = docs.withColumns({names[k]: c for k, c in keys.items()})
    on = [left[names[k]].eqNullSafe(rows[k]) for k in keys]
    return left.join(sized(rows), on, how).drop(*names.values())


def drop_texts(docs: DataFrame, texts: DataFrame, digest: Column, id_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose digest, and id if ``id_col`` is given, are not a row of ``texts`` (staged: sha, id).

    A decision belongs to a text: rows that only share its id are not touched.
    """
    keys = {"sha": digest} | ({"id": F.col(id_col)} if id_col else {})
    return _keyed(docs, keys, texts, "left_anti")


def one_of_each(docs: DataFrame, repeated: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """``docs`` with one row of each (id, text) in ``repeated`` (staged: sha, id), whichever; other rows as they are.

    Only the repeated rows are shuffled, reduced within each task before.
    """
    if repeated.isEmpty():
        return docs
    keys = {"sha": digest, "id": F.col(id_col)}
    several = _keyed(docs, keys, repeated, "left_semi")
    mark = f"__sha_{uuid.uuid4().hex[:8]}"
    once = several.withColumn(mark, digest).dropDuplicates([mark, id_col]).drop(mark)
    return _keyed(docs, keys, repeated, "left_anti").unionByName(once)


def normal_spaces(col: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), WHITE, " ")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows that a task function gets at once.
SLICE_ROWS = 512


def lean(run: Batches) -> Batches:
    """``run`` for mapInArrow with small memory: it gets batches in slices, and what it has freed goes
    back to the system when the task ends, as Spark keeps its Python workers for the stages to come."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                yield b.slice(at, SLICE_ROWS)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)

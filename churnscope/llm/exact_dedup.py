"""Exact deduplication as a stateful stream.

Each document becomes (digest, id, locator) and runs through a Structured
Streaming aggregation keyed by digest. The state lives in RocksDB on the
executors' disks, is checkpointed to the shared folder, and has no watermark:
a digest is never forgotten. Per digest it retains the smallest id, that row's
content locator and the number of rows. Documents that hit a digest seen
before are then compared by their full text: within a digest, rows are grouped
by the text itself, so two texts that only share a digest are separated.

Skew: the stream aggregates partially before its shuffle, and so does the
full-text grouping, so a text that makes up a third of the corpus reaches its
reducer as one row per map task. The join that brings the decision back has
two staged tables as inputs, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm.common import Scratch, drop_texts, keep_ids, normal_spaces, one_of_each

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # One bound for all state stores of an executor, outside the heap.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # Stores of a stream that has ended are closed this soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "10",
    # Many small state stores: no space allocated ahead for each one's logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None, key_chars: int = 64) -> DataFrame:
    """Per document: id, locator, the SHA-256 of its normalised text and the state's key."""
    at = F.lit(None).cast("string") if locator is None else locator.cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        at.alias("locator"),
        F.sha2(normal_spaces(F.col(text_col)).cast("binary"), 256).alias("sha"),
    ).withColumn("key", F.col("sha").substr(1, key_chars))


def first_seen(stream: DataFrame) -> DataFrame:
    """The stateful operator: per key the smallest id with its locator, and the rows so far."""
    return stream.groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")).alias("first"),
        F.count(F.lit(1)).alias("rows"),
    )


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and those of the stream, which reach nothing else that runs beside it."""
    streaming = spark.newSession()
    for k, v in {**spark.conf.getAll, **ROCKSDB}.items():
        # Spark has no entries for the settings under ``rocksdb``, so it calls none of them modifiable.
        if k.startswith("spark.sql.streaming.stateStore.rocksdb.") or streaming.conf.isModifiable(k):
            streaming.conf.set(k, v)
    return streaming


def run_stream(scratch: Scratch, source: str, schema, max_bytes_per_trigger: int, checkpoint: str | None = None) -> DataFrame:
    """Stream the digests under ``source`` through the state; returns the state's rows.

    A stream restarted on the same ``checkpoint`` goes on with the retained
    digests: documents that arrive later are held against all earlier ones.
    """
    spark = scratch.spark
    checkpoint = checkpoint or scratch.path("dedup-state")
    streaming = stream_session(spark)
    stream = streaming.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(source)
    query = (
        first_seen(stream)
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = streaming.read.format("statestore").load(checkpoint)
    first, rows = state.schema["value"].dataType.names
    return state.select(
        F.col("key.key").alias("key"),
        F.col("value")[first]["id"].alias("keep_id"),
        F.col("value")[first]["locator"].alias("keep_locator"),
        F.col("value")[rows].alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    locator: Column | None = None,
    key_chars: int = 64,
    max_bytes_per_trigger: int = 64 << 30,
    checkpoint: str | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when identical after each white-space run became one space;
    null counts as empty. Of equal texts the smallest id stays. Rows repeating
    both id and text are one document: they share their decision. Rows without
    an id never displace one that has an id; if no row of a text has an id,
    keep_id is null and all of them are kept. An empty table gives no rows.
    Other columns of ``docs`` are not read, whatever their names.

    ``key_chars``: hex characters of the digest that key the state; fewer make
    collisions likely, which the full-text comparison then resolves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    narrow = scratch.stage(digests(docs, id_col, text_col, locator, key_chars), "dedup-digests")
    state = scratch.stage(
        run_stream(scratch, scratch.where(narrow), narrow.schema, max_bytes_per_trigger, checkpoint), "dedup-first"
    )
    # Hits: documents whose digest the state has met in more than one row.
    decided = scratch.stage(narrow.join(state, "key"), "dedup-decided")
    hits = scratch.stage(decided.where("group_size > 1 and id is not null").select(F.col("id").alias(id_col)).distinct(), "dedup-hits")
    own = docs.select(F.col(id_col), normal_spaces(F.col(text_col)).alias("full"))
    texts = keep_ids(own, hits, id_col).withColumn("key", F.sha2(F.col("full").cast("binary"), 256).substr(1, key_chars))
    if key_chars < 64:
        texts = texts.unionByName(own.where(F.col(id_col).isNull()).withColumn("key", F.sha2(F.col("full").cast("binary"), 256).substr(1, key_chars)))
    # The full texts under each digest; more than one: the digest has collided.
    classes = texts.groupBy("key", "full").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    collided = scratch.stage(
        classes.select("key", "class_id", "class_size", F.sha2(F.col("full").cast("binary"), 256).alias("sha"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where("texts > 1")
        .select("key"),
        "dedup-collided",
    )
    scratch.drop([narrow, state, hits])  # the result reads the others
    out = decided.select("id", "keep_id", "group_size", "sha", "keep_locator")
    if not collided.isEmpty():
        # Only these digests' documents travel with their texts.
        again = own.withColumn("sha", F.sha2(F.col("full").cast("binary"), 256)).withColumn("key", F.col("sha").substr(1, key_chars)).join(collided, "key", "left_semi")
        by_text = again.groupBy("key", "full").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = again.join(by_text, ["key", "full"]).select(
            F.col(id_col).alias("id"), "keep_id", "group_size", "sha", F.lit(None).cast("string").alias("keep_locator")
        )
        out = decided.join(collided, "key", "left_anti").select(*out.columns).unionByName(split)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "keep_locator",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, up to white space; its columns are unchanged.

    Of equal texts a row of the smallest id stays; of rows that repeat both id and
    text, one. Rows without an id stay only where no row of their text has one, and
    then one does. Rows that share an id but not the text don't affect each other. Null
    counts as the empty text; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    decided = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    seen = scratch.stage(decided.groupBy("id", "sha", "kept").agg(F.count(F.lit(1)).alias("n")), "dedup-seen")
    gone = scratch.stage(seen.where("not kept").select("sha", "id"), "dedup-copies")
    repeated = scratch.stage(seen.where("kept and n > 1").select("sha", "id"), "dedup-repeated")
    scratch.drop([seen])
    sha = F.sha2(normal_spaces(F.col(text_col)).cast("binary"), 256)
    return one_of_each(drop_texts(docs, gone, sha, id_col), repeated, sha, id_col)

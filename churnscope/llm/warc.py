"""Content-addressed WARC archive.

An archive is two tables in one folder:

* ``payloads``: each distinct payload once, keyed by its SHA-256 (``digest``,
  ``payload``); a payload is never written a second time, whatever the number
  of records that carry it;
* ``records``: one row per record with its exact header bytes (``header``,
  through the blank line), the digest of its payload and the length of its
  own block (0 for a revisit, whose payload is stored with its response).

``read_records`` joins the two and gives back whole WARC records: header,
block and the closing CRLF CRLF. Digests are verified against the bytes when
read. Everything is built-in Spark; a digest shared by a third of all records
is counted with partial aggregation and joined between staged tables, which
AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm.common import Scratch, drop_ids

#: Payloads shorter than this are stored with every record as a response (their bytes still once).
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"


def _record_id(digest: Column, key: Column) -> Column:
    """A URN that only depends on the record: reruns write the same bytes."""
    h = F.sha2(F.concat_ws(":", F.lit("record"), key.cast("string")).cast("binary"), 256)
    return F.concat(F.lit("<urn:sha256:"), h, F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Control characters are percent-encoded."""
    clean = F.regexp_replace(value, r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def write_archive(
    records: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    content_type: str = "text/html; charset=utf-8",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> str:
    """Write one WARC record per row of ``records`` under ``path``; returns ``path``.

    ``payload_col`` is text (stored as UTF-8) or binary; null is an empty
    payload. Of rows with equal payloads of at least ``min_revisit_bytes`` the
    one with the smallest id is the response and the others revisit it;
    shorter ones are all responses. A null URI leaves its header out. Rows
    without an id are written after those with one: they are revisits where
    the payload has a response, else responses. Rows that repeat an id and a
    payload give a record each. An empty table gives an empty archive. Other
    columns are not read.
    """
    scratch = Scratch(records.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = records.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")
    )
    narrow = scratch.stage(
        rows.select("id", "uri", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")),
        "warc-digests",
    )
    owners = scratch.stage(
        narrow.groupBy("digest").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")), "warc-owners"
    )
    marked = narrow.join(owners, "digest")
    revisit = (F.col("bytes") >= min_revisit_bytes) & F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    block = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("digest"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none:"), F.col("digest"), F.coalesce("uri", F.lit(""))))), F.lit(CRLF)),
        _line("WARC-Target-URI", F.col("uri")),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("digest"), F.col("owner")), F.lit(CRLF))).otherwise(""),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Key: "), F.col("owner").cast("string"), F.lit(CRLF))).otherwise(""),
        F.coalesce(F.concat(F.lit("X-Record-Key: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "),
        block.cast("string"),
        F.lit(CRLF + CRLF),
    )
    marked.select("id", "digest", block.alias("block_bytes"), header.cast("binary").alias("header")).write.parquet(f"{path}/records")

    # Payload bytes go out once: from the row that owns the digest. Rows of one
    # id with different payloads are told apart by (id, digest).
    others = scratch.stage(
        narrow.join(owners.where("n > 1"), "digest").where(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "digest").distinct(),
        "warc-copies",
    )
    stored = rows.withColumn("digest", F.sha2("payload", 256))
    if others.where("id is null").isEmpty():
        once = _without(stored, others)
    else:
        ownerless = owners.where("owner is null").select("digest")
        once = _without(stored.where("id is not null"), others).unionByName(stored.where("id is null").join(ownerless, "digest", "left_semi"))
    repeated = owners.where("n > 1 and owner is not null").join(narrow, "digest").where("id = owner").groupBy("digest").count().where("count > 1")
    once = once.select("digest", "payload")
    if not repeated.isEmpty() or not owners.where("n > 1 and owner is null").isEmpty():
        once = once.dropDuplicates(["digest"])  # rows that repeat id and payload
    once.write.parquet(f"{path}/payloads")
    scratch.drop([narrow, owners, others])
    return path


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    if "id" in others.columns and others.isEmpty():
        return rows
    return drop_ids(rows, others, ["id", "digest"])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, verified: whether the stored bytes still have their digest."""
    return spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads").withColumn(
        "verified", F.sha2("payload", 256) == F.col("digest")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """id, header, payload, record, digest, verified for every record of the archive.

    ``record`` is the record as WARC has it: header, block, CRLF CRLF (a
    revisit's block is empty); ``payload`` is the full payload, fetched through
    its digest. A record whose payload is missing has null there.
    """
    records = spark.read.schema("id long, digest string, block_bytes long, header binary").parquet(f"{path}/records")
    joined = records.join(read_payloads(spark, path), "digest", "left")
    empty = F.lit("").cast("binary")
    block = F.when(F.col("block_bytes") > 0, F.col("payload")).otherwise(empty)
    return joined.select(
        "id", "header", "payload", F.concat("header", block, F.lit(CRLF + CRLF).cast("binary")).alias("record"), "digest",
        F.coalesce("verified", F.lit(False)).alias("verified"),
    )


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null where the header has none."""
    found = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of every record, read from the reconstructed records."""
    r = read_records(spark, path)
    return r.select(
        header_field(F.col("header"), "X-Record-Key").cast("long").alias("id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace(header_field(F.col("header"), "WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        header_field(F.col("header"), "X-Refers-To-Key").cast("long").alias("refers_to"),
        (
            F.octet_length("record") - F.octet_length("header") - 4 == header_field(F.col("header"), "Content-Length").cast("long")
        ).alias("length_ok"),
        "verified",
    )

"""A content-addressed archive of WARC records.

Three tables in one folder, all in Parquet:

* ``payloads`` (digest, payload): the bytes of every payload once, by SHA-256;
* ``records`` (page_id, record_id, digest, header): the exact header block of
  every record, with its record type and, for a revisit, what it refers to;
* ``origin`` is not stored: a record is its header, an empty line, the payload
  that a join by digest finds (none for a revisit), and two line ends.

Payloads are checked against their digest when they are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.sources.files import shared_dir

LEAST_BYTES = 100
CRLF = "\r\n"


def header(
    page_id: Column, url: Column, kind: Column, refers_to: Column, digest: Column, n_bytes: Column, record: Column, date: str,
) -> Column:
    """The header block of a record; a line whose value is null is left out.
    A line break in a URL would end the line, so it is percent-encoded."""
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(kind == "response", n_bytes).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), record.cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), n_bytes.cast("string")),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">")),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def write_archive(pages: DataFrame, target: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, empty for null.  Of records with equal
    payloads of ``least_bytes`` or more, that with the smallest page_id is the
    response (every row with it, if it is repeated) and the others revisit it;
    shorter payloads are all responses, stored once as well.  A null page_id is
    never the smallest unless all are null.  A record id is the page_id and a
    number of the record's own, so repeated rows have ids of their own too.
    ``date`` is that of all records (the rows have none).  Further columns are
    ignored; an empty table gives an empty archive.

    Payloads are reduced inside each task before one shuffle by digest; what is
    joined to find the responses are rows without payloads.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"), "payload")
    stored = rows.groupBy("digest").agg(F.min("page_id").alias("owner"), F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{target}/payloads")
    owners = spark.read.parquet(f"{target}/payloads").select("digest", "owner")
    records = rows.drop("payload").join(owners, "digest")
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = records.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("owner")))
    records.select(
        "page_id", "digest",
        header(*(F.col(c) for c in ("page_id", "url", "kind", "refers_to", "digest", "n_bytes")), F.monotonically_increasing_id(), date).cast("binary").alias("header"),
    ).write.option("compression", "zstd").parquet(f"{target}/records")


def field(name: str) -> Column:
    """The value of a header line, null without the line."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.nullif(found, F.lit(""))


def read_archive(spark: SparkSession, target: str) -> DataFrame:
    """Every record put together again: page_id, record_type, refers_to,
    payload_bytes and payload_digest as measured on the stored payload, the
    payload (of a revisit: of what it refers to), the record's exact bytes, and
    whether the stored payload has the digest and length that the header names.
    Columns that are not used are not read or joined."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{target}/payloads").select(
        "digest", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    records = spark.read.schema("page_id long, digest string, header binary").parquet(f"{target}/records")
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.join(payloads, "digest").select(
        "page_id", field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        "payload_bytes", "payload_digest", "payload",
        F.concat(F.col("header"), F.lit(CRLF).cast("binary"), body, F.lit(CRLF + CRLF).cast("binary")).alias("record"),
        ((F.concat(F.lit("sha256:"), F.col("payload_digest")) == field("WARC-Payload-Digest"))
         & (F.col("payload_bytes").cast("string") == field("WARC-Payload-Length"))).alias("verified"),
    )


def archive(pages: DataFrame) -> str:
    """Writes an archive to a new folder in the shared folder; its path."""
    target = shared_dir(pages.sparkSession, "warc")
    write_archive(pages, target)
    return target

"""Content-addressed WARC archive.

``write_archive`` keeps two tables, both bucketed by the SHA-256 of the payload:

* payloads: each distinct payload once, under its SHA-256, with its length and SHA-1;
* headers: one exact WARC header block per record.

``read_archive`` joins the two on their buckets (no shuffle), rebuilds the bytes of every
record, checks payload length and both digests, and parses the header block again.
``export_warc`` writes the rebuilt records as plain WARC files through Spark's own writer,
and ``import_warc`` parses such files by Content-Length.

A payload is identified by SHA-256 and length; the SHA-1 that WARC asks for is verified on reading.

Defined results: a null payload counts as empty; a null or odd URL is percent-encoded where
it holds CR or LF, and left out if null; a null id gives a record whose id reads
back as null, and it is the response only if no other row has its payload; repeated rows with
the largest id are all responses, and records of repeated ids have the same WARC-Record-ID; an empty table gives an empty
archive; extra columns are ignored. A very long payload is one value of at most 2 GB in each step; import_warc() holds one
file at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_table, fresh_table
from .common import ready

#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_of_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1, without Python: 5 hexadecimal digits are 4 of base 32."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe_uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


@dataclass(frozen=True)
class Archive:
    """Names of the two bucketed tables, and where they lie. They go when the driver ends, or by drop_archive()."""

    payloads: str
    headers: str
    payloads_at: str
    headers_at: str


def drop_archive(spark: SparkSession, archive: Archive) -> None:
    drop_table(spark, archive.payloads, archive.payloads_at)
    drop_table(spark, archive.headers, archive.headers_at)


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, buckets: int | None = None) -> Archive:
    """Stores one record per row. Of rows with equal payloads of min_bytes or more, those
    with the largest id are responses, and the others revisit it; smaller payloads are all responses.

    Copies are combined before the shuffle, so a payload that a third of all rows hold costs
    one row a task.
    """
    spark = pages.sparkSession
    n = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("rid"), F.col(url_col).cast("string").alias("uri"), raw.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256))).withColumn("n_bytes", F.octet_length("payload").cast("long"))

    (payloads, payloads_at), (headers, headers_at) = fresh_table(spark, "payloads"), fresh_table(spark, "headers")
    names = Archive(payloads, headers, payloads_at, headers_at)

    def store(df: DataFrame, name: str, path: str) -> None:
        df.write.format("parquet").bucketBy(n, "address").sortBy("address").option("compression", "zstd").option("path", path).saveAsTable(name)

    # the aggregate's own shuffle deals out by address as the buckets do
    once = rows.groupBy("address").agg(F.first("payload").alias("payload"), F.first("n_bytes").alias("n_bytes"), F.max("rid").alias("top"))
    store(once.withColumn("sha1", base32_of_sha1(F.col("payload"))), payloads, payloads_at)

    tops = spark.table(payloads).select("address", "sha1", "top")
    head = rows.select("rid", "uri", "address", "n_bytes").join(tops, "address")
    response = (F.col("n_bytes") < min_bytes) | F.col("rid").eqNullSafe(F.col("top"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", urn(F.col("rid"))),
        _line("WARC-Target-URI", _safe_uri(F.col("uri"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(~response, urn(F.col("top")))),
        _line("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(response, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    store(head.select("address", block.cast("binary").alias("header")).repartition(n, "address"), headers, headers_at)
    return names


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record: its exact bytes (record), its full payload, and the parsed header.

    Fails if a payload doesn't have its recorded length or digests.
    """
    stored = spark.table(archive.payloads).select("address", "payload", "n_bytes", "top")
    rows = spark.table(archive.headers).join(stored, "address").withColumn("head", F.decode("header", "UTF-8"))
    rid = lambda name: F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    rows = rows.select(
        "header", "payload", "address", "n_bytes",
        number(rid("WARC-Record-ID")).alias("rid"), _field("WARC-Target-URI").alias("uri"), _field("WARC-Type").alias("kind"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("digest"), number(rid("WARC-Refers-To")).alias("refers_to"),
    )
    whole = (F.octet_length("payload") == F.col("n_bytes")) & (F.unhex(F.sha2("payload", 256)) == F.col("address")) & (base32_of_sha1(F.col("payload")) == F.col("digest"))
    rows = rows.withColumn("payload", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digests"))))
    block = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def export_warc(records: DataFrame, path: str) -> None:
    """Plain WARC files: the two line ends after a record are the text writer's separator, so
    any file system that Spark reaches will do."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value")
    records.select(body).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes):
    """(header block, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        fields = dict(x.split(b": ", 1) for x in header.split(b"\r\n")[1:] if b": " in x)
        n = int(fields[b"Content-Length"])
        yield header, data[end : end + n]
        if data[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        at = end + n + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of each record of the WARC files below path, a file at a time."""

    ready(spark)
    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf.content:
                found = list(parse_warc(bytes(data)))
                yield pd.DataFrame({"header": [h for h, _ in found], "block": [b for _, b in found]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "header binary, block binary")


def page_records(pages: DataFrame) -> DataFrame:
    """Of each record of an archive, read back after writing: its digest columns, and size and SHA-256 of its rebuilt bytes."""
    back = read_archive(pages.sparkSession, write_archive(pages))
    return back.select(
        F.col("rid").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"),
    )

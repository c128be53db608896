"""A content-addressed WARC archive.

An archive is two tables in one shared folder.  `payloads` has every
distinct payload once, under its SHA-256 and with its length; `headers` has
one row per record: the exact header block of the WARC record and the
address of its payload.  Records are put together again by a join on the
address.

The address is strong, and yet verified on both ways: on writing, the row
that is stored is the one whose record is the response (of equal addresses
lengths must be equal), and on reading, the digests of the stored bytes are
computed again and compared with the address and with the digest that the
header block claims.

Payload bytes are never shuffled for choosing responses: digests are
aggregated with map-side combining, and the chosen rows are picked by their
record id, which is unique.  A payload that a third of all records share
costs one stored row, and the joins of headers with the small table of
responses may be split by adaptive execution.

Defined cases: a null payload is empty; an empty payload is stored like any
other; null url gives an empty WARC-Target-URI; line breaks in a url are
percent-encoded, so that a header block stays one; rows without an id are
not archived; rows that repeat an id are one record (the largest payload
digest counts); an empty table gives an empty archive; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.shared import new_folder

#: Payloads from this size on are stored as revisits when they repeat.
MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
EMPTY = bytearray()

PAYLOADS = T.StructType([
    T.StructField("address", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])
HEADERS = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("header", T.BinaryType()), T.StructField("address", T.StringType()),
])


@dataclass
class Archive:
    spark: SparkSession
    folder: str

    def payloads(self) -> DataFrame:
        return self.spark.read.schema(PAYLOADS).parquet(f"{self.folder}/payloads")

    def headers(self) -> DataFrame:
        return self.spark.read.schema(HEADERS).parquet(f"{self.folder}/headers")


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))


def _header(kind: Column, refers: Column, date: str) -> Column:
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # a null (no reference) would make the whole block null
    refer = F.coalesce(line("WARC-Refers-To", _urn(refers)), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(F.col("record_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        refer,
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(records: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> Archive:
    """Archive records (record_id long, url string, payload binary).

    Of records with equal payloads of at least `min_revisit_bytes`, that with
    the largest record_id is the response and the others are revisits of it.
    """
    spark = records.sparkSession
    archive = Archive(spark, folder or new_folder(spark, "warc"))
    rows = records.filter("record_id IS NOT NULL").select(
        F.col("record_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload"), F.lit(EMPTY)).alias("payload"),
    )
    digests = rows.groupBy("record_id").agg(
        F.max(F.struct(
            F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"),
            F.octet_length("payload").cast("long").alias("n_bytes"), F.col("url").alias("url"),
        )).alias("d")
    ).select("record_id", "d.*")
    path = f"{archive.folder}/digests"
    digests.write.option("compression", "zstd").parquet(path)
    digests = spark.read.schema(digests.schema).parquet(path)

    holders = digests.groupBy("address", "n_bytes").agg(F.max("record_id").alias("holder"))
    chosen = holders.select(F.col("holder").alias("record_id"), F.col("address").alias("stored"))
    stored = (
        rows.join(chosen, "record_id")
        .filter(F.sha2("payload", 256) == F.col("stored"))
        .select(F.col("stored").alias("address"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    )
    # repeated rows of one id would store their payload twice
    repeats = rows.groupBy("record_id").count().filter("count > 1")
    if not repeats.isEmpty():
        stored = stored.dropDuplicates(["address"])
    stored.write.option("compression", "zstd").parquet(f"{archive.folder}/payloads")

    large = F.col("n_bytes") >= min_revisit_bytes
    told = digests.join(holders, ["address", "n_bytes"])
    kind = F.when(large & (F.col("record_id") != F.col("holder")), "revisit").otherwise("response")
    refers = F.when(kind == "revisit", F.col("holder"))
    told.select("record_id", _header(kind, refers, date).alias("header"), "address").write.option(
        "compression", "zstd"
    ).parquet(f"{archive.folder}/headers")
    return archive


def field(header: Column, name: str) -> Column:
    """A named field of a header block, null where it is absent."""
    found = F.regexp_extract(header.cast("string"), rf"\r\n(?i:{name}): ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def verified_payloads(archive: Archive) -> DataFrame:
    """payloads with sha1 of the stored bytes; a row whose bytes do not belong to its address is an error."""
    checked = archive.payloads().select("address", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    right = F.sha2("payload", 256) == F.col("address")
    return checked.withColumn("sha1", F.when(right, F.col("sha1")).otherwise(F.raise_error(F.lit("payload does not match its address"))))


def read_index(archive: Archive) -> DataFrame:
    """One row per record, from its header block and the verified payload behind it, without the bytes.

    record_id, header, address, record_type, refers_to, url, n_bytes, sha1.
    """
    payloads = verified_payloads(archive).select("address", "n_bytes", "sha1")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    h = F.col("header")
    claimed = F.regexp_extract(field(h, "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    return archive.headers().join(payloads, "address").select(
        number(field(h, "WARC-Record-ID")).alias("record_id"), "header", "address",
        field(h, "WARC-Type").alias("record_type"), number(field(h, "WARC-Refers-To")).alias("refers_to"),
        F.coalesce(field(h, "WARC-Target-URI"), F.lit("")).alias("url"), "n_bytes",
        F.when(claimed == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("digest in the header is wrong"))).alias("sha1"),
    )


def read_records(archive: Archive) -> DataFrame:
    """record_id, payload (whole, of revisits too) and record: the exact bytes of the WARC record."""
    payloads = verified_payloads(archive).select("address", "payload")
    end = F.lit(bytearray(b"\r\n\r\n"))
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(EMPTY)).otherwise(F.col("payload"))
    return archive.headers().join(payloads, "address").select("record_id", "payload", F.concat("header", body, end).alias("record"))


def read_back(archive: Archive) -> DataFrame:
    """record_id, record_type, refers_to, n_bytes and sha1, all taken from the records put together.

    A response's payload is cut from its record; a revisit's record has none,
    its payload is the one it refers to.  A wrong digest or length is an error.
    """
    end = "\r\n\r\n"
    rows = read_records(archive).withColumn("head", F.concat(F.substring_index(F.col("record").cast("string"), end, 1), F.lit(end)))
    start = F.octet_length("head")
    body = F.substring(F.col("record"), start + 1, F.octet_length("record") - start - len(end))
    head = F.col("head")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    found = rows.select(
        number(field(head, "WARC-Record-ID")).alias("record_id"), field(head, "WARC-Type").alias("record_type"),
        number(field(head, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(field(head, "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("claimed"),
        field(head, "Content-Length").cast("long").alias("length"), F.octet_length(body).cast("long").alias("in_record"),
        F.when(field(head, "WARC-Type") == "revisit", F.col("payload")).otherwise(body).alias("whole"),
    ).select("*", F.sha1("whole").alias("sha1"))
    right = (F.col("claimed") == F.col("sha1")) & (F.col("length") == F.col("in_record"))
    return found.select(
        "record_id", "record_type", "refers_to", F.octet_length("whole").cast("long").alias("n_bytes"),
        F.when(right, F.col("sha1")).otherwise(F.raise_error(F.lit("record does not match its header"))).alias("sha1"),
    )

"""A content-addressed archive of web records.

Payload bytes are stored once, under their verified SHA-256; the exact headers of every record are
kept apart with that digest; original records come back through a join of the two.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, hot_join

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: ten hex digits are eight of these."""
    digest = F.sha1(data)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31))), _DIGITS, _BASE32)


def _field(header: str, name: str) -> Column:
    """A header field's value; null if it is missing or empty."""
    value = F.regexp_extract(header, rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(value != "", value)


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def records(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0) -> DataFrame:
    """One light row per page: page_id, url, sha256, payload_digest, payload_bytes, record, record_type, refers_to, refers_record.

    Of the pages with one payload, the one with the smallest page_id is a response and the others
    revisit it, if the payload has ``min_revisit_bytes`` or more. A null html is an empty payload.
    Rows that repeat an id with the payload are one record each: all rows with the smallest id are
    responses. Ids are integers; null ids come last, and if a payload has no other, its rows are responses.
    ``record`` numbers the rows. An empty table gives an empty one.
    """
    light = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.unhex(F.sha2(_payload(), 256)).alias("sha256"), base32_sha1(_payload()).alias("payload_digest"), F.octet_length(_payload()).cast("long").alias("payload_bytes")
    )
    light = scratch.write(light.withColumn("record", F.monotonically_increasing_id()), "light")
    first = F.min(F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "record", "page_id")).alias("first")
    found = hot_join(light, scratch.write(light.groupBy("sha256").agg(first, F.count(F.lit(1)).alias("n")), "first"), ["sha256"])
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return found.select(*light.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.record")).alias("refers_record"))


def with_headers(light: DataFrame, date: str) -> DataFrame:
    """sha256, record_type and the exact header block of each record, as WARC 1.1 text up to and with the empty line.

    Record ids name page and record number, so rows that repeat a page have ids of their own. Line
    ends within a url are percent-encoded.
    """
    urn = lambda page, record: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(record).cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id", "record")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Refers-To", F.when(revisit, urn("refers_to", "refers_record"))),
        F.when(revisit, "").otherwise("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    return light.select("sha256", "record_type", header.alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once, with its SHA-256. Copies meet before the shuffle first."""
    return pages.select(F.unhex(F.sha2(_payload(), 256)).alias("sha256"), _payload().alias("payload")).dropDuplicates(["sha256"])


class Archive:
    """A written archive: ``headers`` (sha256, header; a folder for each type of record) and ``payloads`` (sha256, payload)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: datetime | None = None, scratch: Scratch | None = None) -> "Archive":
        """``date``: when the pages were archived, now unless given."""
        scratch = scratch or Scratch(pages.sparkSession, "warc")
        at = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        with_headers(records(pages, scratch, min_revisit_bytes), at).write.mode("overwrite").option("compression", "zstd").partitionBy("record_type").parquet(f"{path}/headers")
        payloads(pages).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
        return cls(pages.sparkSession, path)

    def headers(self, record_type: str | None = None) -> DataFrame:
        """Records (of one type) as their headers say, parsed again from the stored text."""
        page = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"<urn:page:(-?\d+):\d+>", 1)
        raw = self.spark.read.schema("sha256 binary, header string, record_type string").parquet(f"{self.path}/headers")
        raw = raw if record_type is None else raw.where(F.col("record_type") == record_type)
        own, refers = page(_field("header", "WARC-Record-ID")), page(_field("header", "WARC-Refers-To"))
        return raw.select(
            "sha256",
            "header",
            F.when(own != "", own).cast("long").alias("page_id"),
            _field("header", "WARC-Target-URI").alias("url"),
            F.substring_index(_field("header", "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
            _field("header", "WARC-Type").alias("record_type"),
            F.when(refers != "", refers).cast("long").alias("refers_to"),
            _field("header", "Content-Length").cast("int").alias("content_length"),
        )

    def payloads(self) -> DataFrame:
        """Payloads whose bytes still have their digest; others raise an error."""
        raw = self.spark.read.schema("sha256 binary, payload binary").parquet(f"{self.path}/payloads")
        return raw.select("sha256", F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")).cast("binary")).alias("payload"))

    def read(self, record_type: str | None = None) -> DataFrame:
        """Every record (of one type) with its full payload; a record without a stored payload raises an error."""
        found = self.headers(record_type).join(self.payloads(), "sha256", "left")
        return found.withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("a record has no payload")).cast("binary")))

    def original(self, record_type: str | None = None) -> DataFrame:
        """The headers' fields and ``record`` as it would stand in a WARC file: header, block (none for a revisit), end."""
        block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
        return self.read(record_type).withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))).drop("payload")

    def summary(self, scratch: Scratch | None = None) -> DataFrame:
        """Per record what its header says, once the record has been rebuilt and its block measured. A
        revisit has no block: it is held against the stored payload that it refers to, whose bytes stay where they are."""
        block = F.expr("substring(record, octet_length(header) + 1, content_length)")
        built = self.original("response").withColumn("block", block)
        whole = F.octet_length("record") == F.octet_length("header") + F.col("content_length") + 4
        light = ["page_id", "payload_digest", "record_type", "refers_to"]
        responses = built.select(*light, F.octet_length("block").cast("long").alias("payload_bytes"), F.when(whole, base32_sha1(F.col("block"))).alias("measured"))
        # A payload that much of a crawl shares, such as the empty page, is sent to its revisits.
        scratch = scratch or Scratch(self.spark, "warc")
        times = self.headers("revisit").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
        measured = self.payloads().select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("measured"))
        stored = scratch.write(times.join(measured, "sha256", "left"), "measured")
        revisits = hot_join(self.headers("revisit").select("sha256", *light), stored, ["sha256"]).select(*light, "payload_bytes", "measured")
        found = responses.unionByName(revisits)
        same = F.col("measured").eqNullSafe(F.col("payload_digest"))
        return found.select("page_id", "payload_bytes", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's digest is not that of its payload"))).alias("payload_digest"), "record_type", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return Archive.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archive"), scratch=scratch).summary(scratch)


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
b as (select page_id, strlen(html)::bigint as payload_bytes, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint) >> (35 - 5 * (i % 8))) & 31)::int, 1) for i in range(32)], '') as payload_digest,
      min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to from b
"""

"""Content-addressed WARC archive (op7).

An archive is two tables in a shared folder: `payloads` holds the bytes of each distinct payload
once, keyed by SHA-256, and `headers` holds the exact bytes of each record's header with the key
of its payload. Joining them by key gives back the records, byte for byte.

The payload bytes of copies meet only after each map task has kept one of each, so a page copied a
million times costs one payload a task. That a key stands for one payload is checked on writing
(length, SHA-1 and xxHash of all copies agree) and on reading (the bytes are digested again).

Defined results: a null html is an empty payload; a null url is written as an empty target; a null
page_id sorts below every id, and its record's ids are written as `null`; rows that repeat the
largest page_id of a payload are all responses; an empty table gives an empty archive; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's two tables."""

    headers: str
    payloads: str


def _lines(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _record_id(page_id: Column) -> Column:
    """A UUID made from the page's id, so that reruns agree."""
    x = F.md5(_lines("page:", F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return _lines("<urn:uuid:", F.substring(x, 1, 8), "-", F.substring(x, 9, 4), "-", F.substring(x, 13, 4), "-", F.substring(x, 17, 4), "-", F.substring(x, 21, 12), ">")


def header_bytes() -> Column:
    """The header block of a record, up to and with its blank line."""
    revisit = F.col("refers_to").isNotNull()
    return _lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        CRLF + "WARC-Record-ID: ", _record_id(F.col("page_id")),
        CRLF + "WARC-Date: " + DATE + CRLF + "WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "),
        CRLF + "WARC-Payload-Digest: sha1:", F.col("sha1"),
        F.when(revisit, _lines(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: ", _record_id(F.col("refers_to")), CRLF + "X-Refers-To-Page: ", F.col("refers_to").cast("string"))).otherwise(""),
        CRLF + "X-Page: ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        CRLF + "X-Payload-Length: ", F.col("n").cast("string"),
        CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string")),
        CRLF + CRLF,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None) -> Archive:
    """Writes pages (page_id, url, html) as an archive below path, by default a new one in the shared folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    out = Archive(f"{path}/headers", f"{path}/payloads")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("key", F.sha2("payload", 256))
    same = F.struct(F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("x"))
    store = rows.groupBy("key").agg(F.any_value("payload").alias("payload"), F.min(same).alias("low"), F.max(same).alias("high"), F.max("page_id").alias("owner"))
    wrong = F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("key"))).cast("long")
    n = F.when(F.col("low") == F.col("high"), F.col("low.n")).otherwise(wrong)
    store.select("key", "payload", n.alias("n"), F.col("low.sha1").alias("sha1"), "owner").write.parquet(out.payloads)
    owners = spark.read.parquet(out.payloads).select("key", "n", "sha1", "owner")
    heads = pages.select("page_id", "url", F.sha2(body, 256).alias("key")).join(owners, "key")
    revisit = (F.col("n") >= LEAST_REVISIT) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    heads = heads.withColumn("refers_to", F.when(revisit, F.col("owner")))
    heads.select("page_id", "url", "key", header_bytes().alias("header")).write.parquet(out.headers)
    return out


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, url, header, payload, the fields parsed from the header, and what the stored bytes digest to.

    Each stored payload is digested once, before the join, and held against its key.
    """
    store = spark.read.parquet(archive.payloads).select("key", "payload")
    wrong = F.raise_error(F.concat(F.lit("stored bytes differ from their digest "), F.col("key"))).cast("string")
    sound = F.when(F.sha2("payload", 256) == F.col("key"), F.sha1("payload")).otherwise(wrong)
    store = store.withColumns({"payload_digest": sound, "payload_bytes": F.octet_length("payload").cast("long")})
    rows = spark.read.parquet(archive.headers).join(store, "key")
    text = F.decode("header", "utf-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return rows.select(
        "page_id", "url", "key", "header", "payload", "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"), field("X-Refers-To-Page").cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id and the whole record: header, block (none for a revisit) and two line ends."""
    rows = read_archive(spark, archive)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))

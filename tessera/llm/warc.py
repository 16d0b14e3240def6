"""Content-addressed WARC archive: payload bytes once, exact record heads apart, records rebuilt by joins.

An archive is two tables.  ``payloads`` holds every distinct payload once under its address, the
SHA-256 of its bytes.  ``heads`` holds, for every record, the exact bytes before its payload (the
WARC head and the HTTP head) and the payload's address.  A record is rebuilt by joining its head
with the payload at its address.  Among records with one payload the one with the largest id is
the response; the others are revisits that refer to it and end after the HTTP head, while their
payload is still there through the address.

Addresses are verified.  When writing, payloads that share a digest are compared byte by byte (equal
ones collapse in the task that reads them), and a digest of different payloads gets one address
for each of them.  When reading, every payload must have the digest of its address, the length
that the HTTP head names and the digest that the WARC head names; else the job fails.

Payload bytes move once, in the join that reads; writing scans them where they are.  Records of a hot
payload are salted in that join.  Nothing here is Python on the executors.

Defined cases: a null payload is an empty one, and empty payloads are equal; a null id is the
smallest; among equal ids the first row in the files is the response; rows equal in every column
are records of their own; a null URL leaves its head line out, CR and LF in a URL are percent-encoded; an
empty table gives an empty archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from .common import Scratch, fixed, met, places, read, small

# --- fixed values: WARC 1.1 fields and the base32 alphabet ---------------------------------
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

#: Records of one payload that one task of the reading join takes.
HOT_RECORDS = 2048


@dataclass
class Archive:
    """``heads``: head, http, address (all binary); ``payloads``: address, payload (binary)."""

    heads: DataFrame
    payloads: DataFrame


def base32(sha1: Column) -> Column:
    """Base32 of a SHA-1 in 40 hex digits: 20 bits are five hex digits and four characters."""
    parts = [F.lpad(F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _first() -> Column:
    """Least for the record that is the response: the largest id, then the first place."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.bitwise_not("id").alias("down"), "id", "_file", "_row")


def _indexed(rows: DataFrame, scratch: Scratch, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(index, copies, split): a row per record without its payload; the addresses of several records; the
    records whose digest stands for different payloads, with addresses of their own, or None."""

    def copies_of(index: DataFrame, name: str) -> DataFrame:
        found = index.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.min(_first()).alias("first"))
        return scratch.table(found.where("n > 1").select("address", "first"), name)

    facts = [base32(F.sha1("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes")]
    keep = ["id", "url", "_file", "_row"]
    index = scratch.table(rows.select(*keep, digest(F.col("payload")).alias("address"), *facts), "index")
    copies = copies_of(index, "copies")
    shared = rows.withColumn("address", digest(F.col("payload")))
    shared = shared.join(small(copies.select("address"), 64), "address", "left_semi")
    contents = shared.groupBy("address", "payload").agg(F.count(F.lit(1)).alias("n"))
    collided = scratch.table(contents.groupBy("address").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("address"), "collided")
    if collided.isEmpty():
        return index, copies, None
    own = shared.join(collided, "address", "left_semi")
    serial = F.row_number().over(Window.partitionBy("address").orderBy("payload"))
    named = own.select("address", "payload").distinct().withColumn("serial", F.lpad(serial.cast("string"), 10, "0").cast("binary"))
    split = own.join(named, ["address", "payload"]).withColumn("address", F.concat("address", "serial"))
    split = scratch.table(split.select(*keep, "address", *facts, "payload"), "split")
    index = scratch.table(index.join(collided, "address", "left_anti").unionByName(split.drop("payload")), "index")
    return index, copies_of(index, "copies"), split


def _lines(*lines: Column | str) -> Column:
    """Lines, each ended by CR LF; a null line is left out."""
    ended = [F.concat(F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")) for x in lines]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in ended])


def _name(key: Column, file: Column, row: Column) -> Column:
    """A record's id: the page's id, and the place of its row to tell equal ids apart."""
    place = F.md5(F.concat(F.element_at(F.split(file, "/"), -1), F.lit("#"), row.cast("string")))
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), place, F.lit(">"))


def write_archive(
    pages: DataFrame,
    scratch: Scratch,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    digest: Callable[[Column], Column] = sha256,
) -> Archive:
    """Writes a record per row of ``pages``.  Payloads of fewer than ``least`` bytes are never revisits (they are stored once too)."""
    pages = fixed(pages, scratch)
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary").alias("payload")
    rows = places(pages, F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{uri}`").alias("url"), body)
    index, copies, split = _indexed(rows, scratch, digest)

    # payloads: the scan without the rows whose payload another row stores
    joined = met(index, copies, "address", "left", 256)
    own = (F.col("_file") == F.col("first._file")) & (F.col("_row") == F.col("first._row"))
    gone = scratch.table(joined.where(F.col("first").isNotNull() & ~own).select(F.col("_file").alias("_f"), F.col("_row").alias("_r")), "gone")
    at = (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))
    once = rows.join(small(gone, 256), at, "left_anti").select(digest(F.col("payload")).alias("address"), "payload", "_file", "_row")
    if split is not None:
        apart = split.select(F.col("_file").alias("_f"), F.col("_row").alias("_r"))
        once = once.join(apart, at, "left_anti").unionByName(split.join(gone, at, "left_anti").select("address", "payload", "_file", "_row"))
    payloads = scratch.table(once.select("address", "payload"), "payloads")

    # heads
    revisit = F.coalesce((F.col("bytes") >= least) & F.col("first").isNotNull() & ~own, F.lit(False))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")), "")
    there = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("id"), F.col("_file"), F.col("_row"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first.id"), F.col("first._file"), F.col("first._row")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Target-URI: "), there),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        "",
    )
    made = joined.withColumn("http", http).select(head.cast("binary").alias("head"), F.col("http").cast("binary").alias("http"), "address")
    return Archive(scratch.table(made, "heads"), payloads)


def read_archive(archive: Archive, hot_records: int = HOT_RECORDS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row per record: head, http, payload, address, and from the head type, id, refers_to (page ids), sha1, bytes.

    A head without its payload, or one that doesn't fit it, fails the job.
    """
    rows = skew_join(archive.heads, archive.payloads, "address", "left", hot_rows=hot_records)
    text, http = F.col("head").cast("string"), F.col("http").cast("string")
    field = lambda of, pattern: F.regexp_extract(of, f"\r\n{pattern}\r\n", 1)
    page = lambda name: field(text, f"{name}: <urn:page:(-?\\d+):[0-9a-f]+>")
    number = lambda digits: F.when(digits != "", digits.cast("long"))
    sha1, size = base32(F.sha1("payload")), F.length("payload").cast("long")
    own = digest(F.col("payload"))
    fits = (field(text, "WARC-Payload-Digest: sha1:([A-Z2-7]+)") == sha1) & (field(http, "Content-Length: (\\d+)") == size.cast("string"))
    fits = fits & (F.col("address").substr(F.lit(1), F.length(own)) == own)
    checked = F.when(F.coalesce(fits, F.lit(False)), sha1).otherwise(F.raise_error(F.lit("a record's head doesn't fit its payload")).cast("string"))
    return rows.select(
        "head", "http", "payload", "address", field(text, "WARC-Type: ([a-z]+)").alias("type"),
        number(page("WARC-Record-ID")).alias("id"), number(page("WARC-Refers-To")).alias("refers_to"),
        checked.alias("sha1"), size.alias("bytes"),
    )


def record_bytes() -> Column:
    """The whole record as a WARC file holds it, from a row of :func:`read_archive`."""
    body = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat("head", "http", body, F.lit(b"\r\n\r\n"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archive(write_archive(read(spark, sf_dir, "pages"), Scratch(spark, "op12")))
    return found.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS kept,
                  list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS parts FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((parts[1 + i // 4] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""

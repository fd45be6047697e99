"""Content-addressed WARC archive: payloads once by digest, headers of every record beside them.

`store` writes two tables.  `payloads` holds every different payload once, under its SHA-256.
`headers` holds the exact header block of every record (bytes up to and with the empty line), the
key of its payload and the number of the record.  Two rows share a payload only if SHA-256, SHA-1
and length agree; a SHA-256 with two SHA-1 or lengths is an error, not a record.  `read` parses
the stored headers, recomputes both digests from the stored bytes, and fails if they differ from
the key or the header.  `restore` joins the two tables to the bytes of the original records.

Of records whose equal payloads have at least MIN_REVISIT bytes, the one with the largest page_id
is the response (of several with that id, the one with the largest url, then the first read), the
others are revisits that name its record id and carry no block; smaller payloads are responses all.

Jobs: the pages are read twice.  Once for digests and lengths, which are written as a narrow table
together with a row number, so that the numbers stay the same however often it is read; once for
the payloads, of which copies are dropped before the shuffle.  The rest joins digests.  A payload
with a third of all copies is one row on its side of each join, and Spark splits the other side.

Defined results: a null html is an empty payload, a null url an empty target, a null page_id is
smaller than any; control characters, blanks and % in a url are percent-coded in the header, so
that no header has more lines than it should.  Equal rows are records of their own.  Very long
payloads are one row.  An empty table gives empty tables.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.llm.common import settled

MIN_REVISIT = 1000   # bytes of payload from which copies are stored as revisits
END = "\r\n"


@dataclass
class Archive:
    headers: DataFrame    # record_no, page_id, header (binary), payload_key (null: no block)
    payloads: DataFrame   # payload_key, payload (binary)


def record_id(number: Column) -> Column:
    """A record id of the form uuid, from the number of the record."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.lpad(F.lower(F.hex(number)), 32, "0"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5"), F.lit(">"))


def _target(url: Column) -> Column:
    """The url with control characters, blanks and % percent-coded."""
    coded = F.replace(F.coalesce(url, F.lit("")), F.lit("%"), F.lit("%25"))
    for code in (*range(33), 127):
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20%\x7F]"), coded).otherwise(F.coalesce(url, F.lit("")))


def store(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> Archive:
    """Write a record per page (page_id, url, html) and read the tables back."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = settled(pages.select(
        F.monotonically_increasing_id().alias("record_no"), F.col("page_id").cast("long")
        .alias("page_id"), F.col("url"), F.sha2(payload, 256).alias("payload_key"),
        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size")),
        "records")

    best = F.max(F.struct(F.col("page_id").isNotNull().alias("a"), "page_id",
                          F.col("url").isNotNull().alias("b"), "url",
                          (-F.col("record_no")).alias("record_no"))).alias("best")
    same = rows.groupBy("payload_key").agg(
        best, F.min("sha1").alias("s"), F.max("sha1").alias("s2"), F.min("size").alias("n"),
        F.max("size").alias("n2"), F.count("*").alias("copies")).where(
        (F.col("copies") > 1) & ((F.col("n") >= min_revisit)
                                 | (F.col("s") != F.col("s2")) | (F.col("n") != F.col("n2"))))
    same = same.select("payload_key", F.when(
        (F.col("s") == F.col("s2")) & (F.col("n") == F.col("n2")), -F.col("best.record_no"))
        .otherwise(F.raise_error(F.lit("two payloads with one SHA-256"))).alias("response_no"))
    told = rows.join(same, "payload_key", "left")
    revisit = F.coalesce(F.col("response_no") != F.col("record_no"), F.lit(False))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit"))
                 .otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("record_no"))),
        F.concat(F.lit("WARC-Target-URI: "), _target(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("response_no")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/"
                              "identical-payload-digest")),
        F.concat(F.lit("Content-Length: "),
                 F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(END)]
    headers = settled(told.select(
        "record_no", "page_id", F.concat_ws(END, *lines).cast("binary").alias("header"),
        "payload_key"), "headers")
    # dropDuplicates keeps one row per key in every task before it shuffles
    payloads = settled(pages.select(F.sha2(payload, 256).alias("payload_key"),
                                    payload.alias("payload"))
                       .dropDuplicates(["payload_key"]), "payloads")
    return Archive(headers, payloads)


def field(name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read(archive: Archive) -> DataFrame:
    """Every record as its stored header and payload tell: record_no, page_id, record_type,
    target, payload_bytes, payload_digest, refers_to (the page_id of the response)."""
    # the digests of the payload are taken from the bytes that were stored
    held = archive.payloads.select(
        "payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("payload_key")).alias("whole"))
    records = archive.headers.select(
        "record_no", "page_id", "payload_key", field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target"), field("WARC-Record-ID").alias("id"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1).alias("sha1"),
        field("WARC-Refers-To").alias("refers_id"),
        field("Content-Length").cast("long").alias("length"))
    named = records.where(F.col("record_type") == "response").select(
        F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    full = records.join(held, "payload_key", "left")
    sound = (F.col("whole") & (F.col("sha1") == F.col("payload_digest"))
             & (F.col("length") == F.when(F.col("record_type") == "revisit", 0)
                .otherwise(F.col("payload_bytes"))))
    full = full.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), F.col("record_no").cast("string")))))
    # only revisits name another record: the others need no shuffle for it
    kept = ["record_no", "page_id", "record_type", "target", "payload_bytes", "payload_digest"]
    first = full.where(F.col("record_type") == "response").select(
        *kept, F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(full.where(F.col("record_type") != "response")
                             .join(named, "refers_id", "left").select(*kept, "refers_to"))


def restore(archive: Archive) -> DataFrame:
    """record_no, page_id and the exact bytes of every record; a revisit has no block."""
    return archive.headers.join(archive.payloads, "payload_key", "left").select(
        "record_no", "page_id", F.concat(
            "header", F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(
                F.col("payload")), F.lit((END * 2).encode())).alias("record"))

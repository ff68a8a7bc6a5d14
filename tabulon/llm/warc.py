"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest and reduced to the original of each digest; the other pages
of a digest become revisit records, which have no payload. Payloads stay where they are read but for the responses whose
digest several pages have. Records are written under fresh headers through Spark's text writer, whose line separator is
the blank line that ends a WARC record, so any store that Spark writes to will do. Files are gzip-compressed whole.
Reading streams the pieces between blank lines and puts records together by Content-Length, whatever the size of a file,
then joins revisits to their responses.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, may_hold, scratch_path

_END = "\r\n\r\n"
_BLANK = _END.encode()
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digits: Column) -> Column:
    """Upper-case base32 of a SHA-1: 40 hexadecimal digits, five at a time, give four letters each."""
    letters = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.lit(_ALPHABET).substr(F.shiftright(value, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)))
    return F.concat(*letters)


def _record_id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


def resolve(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, size, payload_digest, refers_to): refers_to and an empty payload for revisits.

    Of equal payloads of at least min_bytes the largest id is the original. A null payload is empty. Rows repeated
    with the original's id are responses too (a record can't refer to itself); a null id is never an original
    unless all of its group are null, and then all are responses.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    heads = materialize(base.select("page_id", "url", "sha", "size"), "warc-heads")
    originals = heads.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    originals = materialize(originals, "warc-originals")
    several = may_hold(heads, "sha", originals).where("may").drop("may")
    # both sides grow with the pages, so neither is broadcast: one plan at every size
    known = several.join(originals.hint("merge"), "sha", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))
    known = materialize(known.select("page_id", "url", "sha", "size", "refers_to"), "warc-known")
    revisits = known.where("refers_to is not null").withColumn("payload", F.lit(""))
    ids = known.where("refers_to is null").select("page_id", "sha").distinct()
    marked = may_hold(base, "sha", originals)
    asked = may_hold(marked.where("may").drop("may"), "page_id", ids.select("page_id")).where("may or page_id is null").drop("may")
    same = asked["page_id"].eqNullSafe(ids["page_id"]) & (asked["sha"] == ids["sha"])
    responses = marked.where("not may").drop("may").unionByName(asked.join(ids.hint("merge"), same, "left_semi")).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "url", "payload", "size", "sha", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns)).withColumn("payload_digest", base32_sha1(F.col("sha"))).drop("sha")


def record_text(df: DataFrame, date: str) -> DataFrame:
    """One WARC record a row, without its final blank line (the writer's line separator)."""
    payload, revisit = F.col("payload"), F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    size = F.col("size").cast("string")
    http = F.concat(F.lit(_HTTP), size, F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return df.select(F.concat(head, block).alias("value"))


def write_archives(df: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    record_text(df, date).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records from the pieces between blank lines of WARC files: header fields (lower-case names) and 'block'.

    A block goes on, blank lines included, until it has the length that its header names.
    """
    for head in pieces:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        left, block = int(fields["content-length"]), []
        for piece in pieces:
            block.append(piece)
            left -= len(piece)
            if left <= 0:
                break
            left -= len(_BLANK)
        else:
            raise ValueError("a WARC record is cut short")
        if left:
            raise ValueError("a WARC record is longer than its header says")
        fields["block"] = _BLANK.join(block)
        yield fields


def _id_of(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return None if inner in ("", "null") else int(inner)


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("valid", pa.bool_())])


def _read(batches):
    pieces = (x for batch in batches for x in batch.column(0).cast(pa.large_binary()).to_pylist())
    rows = []
    for r in parse_records(pieces):
        _, _, payload = r["block"].partition(_BLANK)
        response = r["warc-type"] == "response"
        named = r["warc-payload-digest"].removeprefix("sha1:")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else named
        rows.append((_id_of(r["warc-record-id"]), r["warc-type"], digest, len(payload) if response else None, _id_of(r.get("warc-refers-to")), digest == named))
        if len(rows) == 2000:
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, x, strict=True)) for x in rows], schema=_READ)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, x, strict=True)) for x in rows], schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_digest, payload_bytes, refers_to, valid) of every record.

    Digests and lengths of responses are computed from what was read; a revisit takes its length from the response
    with its digest (all responses of one digest have one payload). valid: the digest in the header is right.
    """
    fields = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, valid boolean"
    bounded_batches(spark)
    return spark.read.option("lineSep", _END).text(path).select(F.col("value").cast("binary").alias("piece")).mapInArrow(_read, fields)


def with_lengths(records: DataFrame) -> DataFrame:
    """Revisits joined to their originals by digest, for the length of the full payload."""
    sizes = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("n"))
    revisits = records.where("record_type = 'revisit'").join(sizes.hint("merge"), "payload_digest", "left").withColumn("payload_bytes", F.col("n")).drop("n")
    return records.where("record_type = 'response'").unionByName(revisits.select(*records.columns))


def archive_round_trip(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages as deduplicated WARC archives in the shared folder, read them back, and describe each record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(resolve(pages, id_col=id_col, url=url, html=html, min_bytes=min_bytes), path)
    return with_lengths(read_archives(spark, path))

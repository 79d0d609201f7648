"""WARC archives with revisit resolution.

Records are written by Spark's text sink with the record separator of the format between them, so writing is
distributed, committed per task and works in any store Spark knows. Files hold a bounded number of records and are read
back by their Content-Length framing, so no payload can break the reading; a reader unpacks a file bit by bit and passes on
a bounded number of bytes at a time. Which record stays and which revisits it is decided on headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, written

CRLF = "\r\n"
#: Records in an archive file at most.
FILE_RECORDS = 2_000
#: Bytes of records that a reader passes on at once, and that it unpacks at once.
BATCH_BYTES, UNPACK_BYTES = 8 << 20, 1 << 20
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF
FIELDS = "record_type string, record_id string, page_id long, uri string, date string, payload_digest string, refers_to_record string, payload_bytes long, payload string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """A response record per page: ``page_id, uri, date, payload, payload_digest``; null html is an empty payload, a null url the empty uri.

    A null page_id stays null. Line breaks in a url are percent-encoded, as a header holds one line. Other columns are not read.
    """
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("uri"), F.coalesce(F.col(html), F.lit("")).alias("payload"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(payload_digest=[digest(p.encode()) for p in pdf["payload"]], page_id=pdf["page_id"].astype("Int64"))

    out = plain.mapInPandas(hashed, "page_id long, uri string, payload string, payload_digest string")
    return out.withColumns({"date": F.lit(date), "record_type": F.lit("response"), "refers_to_record": F.lit(None).cast("string"), "refers_to_uri": F.lit(None).cast("string")})


def _named(h) -> object:
    """A record id of 32 hexadecimal digits."""
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def fresh_id(record_id, generation: str = "2") -> object:
    """The id in the next generation of archives of a record with this id: another one for each."""
    return _named(F.md5(F.concat_ws(":", F.lit(generation), record_id).cast("binary")))


def write_archives(records: DataFrame, path: str, *, file_records: int = FILE_RECORDS) -> None:
    """Writes records (as from :func:`responses` or :func:`revisits`) to gzip archives under ``path``, with fresh headers.

    Records without a ``record_id`` of their own get a random one, so rows that repeat a page are told apart. A revisit has the digest of the full payload, the record and uri that it refers to, and no payload.
    """
    full = F.col("record_type") == "response"
    block = F.when(full, F.concat(F.lit(HTTP_HEADER), F.col("payload"))).otherwise(F.lit(HTTP_HEADER))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id") if "record_id" in records.columns else F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(full, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("refers_to_record")), line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")))),
        F.coalesce(line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    text = records.select(F.concat(header, F.lit(CRLF), block).alias("value"))
    text.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive that comes in chunks, by Content-Length."""
    data, at = bytearray(), 0
    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0 or len(data) < (last := end + 4 + length(data[at:end])) + 4:
            chunk = next(chunks, None)
            if chunk is None:
                if at < len(data):
                    raise ValueError("the archive ends inside a record")
                return
            del data[:at]
            at = 0
            data.extend(chunk)
        lines = data[at:end].decode().split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        yield dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), bytes(data[end + 4 : last])
        at = last + 4


def length(header: bytearray) -> int:
    """Content-Length of a record's header."""
    return int(header[header.rindex(b"Content-Length: ") + 16 :].split(b"\r", 1)[0])


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file, ``UNPACK_BYTES`` at a time."""
    while content:
        z = zlib.decompressobj(31)
        part = z.decompress(content, UNPACK_BYTES)
        while part:
            yield part
            part = z.decompress(z.unconsumed_tail, UNPACK_BYTES)
        if not z.eof:
            raise ValueError("a file of the archive is cut off")
        content = z.unused_data


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``: type, ids, uri, digest, what a revisit refers to, the payload's bytes and the payload (both null for revisits).

    Without ``payloads`` only headers leave the reader, and the payload is null throughout.
    """
    names = [c.split()[0] for c in FIELDS.split(", ")]

    def table(found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=names)
        return out.assign(page_id=pd.array(out["page_id"], dtype="Int64"), payload_bytes=pd.array(out["payload_bytes"], dtype="Int64"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                found, held = [], 0
                for h, block in parse(unpacked(content)):
                    kind, page = h["WARC-Type"], h.get("WARC-Page-ID")
                    body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    found.append((kind, h["WARC-Record-ID"], int(page) if page else None, h.get("WARC-Target-URI", ""), h["WARC-Date"], h["WARC-Payload-Digest"].removeprefix("sha1:"), h.get("WARC-Refers-To"), None if body is None else len(body), body.decode() if payloads and body is not None else None))
                    held += len(block) if payloads else 500
                    if held >= BATCH_BYTES:
                        yield table(found)
                        found, held = [], 0
                yield table(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(rows, FIELDS)


def revisits(headers: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """``record_id, refers_page, refers_record, refers_uri`` of each record that becomes a revisit, from headers alone.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id stays a response and the others revisit it. Null
    page ids come last in the choice; of rows that repeat a page_id the largest record id stands for all, and all of them stay responses.
    """
    key = F.struct(F.col("page_id"), F.col("record_id"), F.col("uri"))
    long = headers.filter(F.col("payload_bytes") >= least_bytes)
    # stored, so that a digest with very many records can be dealt to several tasks in the join
    chosen = written(long.groupBy("payload_digest").agg(F.max(key).alias("_keep")), "warc-chosen")
    met = long.select("payload_digest", "record_id", "page_id").join(chosen, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("_keep.page_id")))
    return met.select("record_id", F.col("_keep.page_id").alias("refers_page"), F.col("_keep.record_id").alias("refers_record"), F.col("_keep.uri").alias("refers_uri"))


def dedup_archives(spark: SparkSession, source: str, target: str, *, least_bytes: int = 0) -> None:
    """Reads the archives under ``source``, resolves revisits and writes the deduplicated archives with fresh headers under ``target``.

    Headers are shuffled by digest; payloads only by their own record id, to meet what was decided.
    """
    headers = written(read_archives(spark, source, payloads=False).drop("payload"), "warc-headers")
    decided = written(revisits(headers, least_bytes=least_bytes), "warc-revisits")
    old = read_archives(spark, source).select("record_id", "page_id", "uri", "date", "payload_digest", "payload").join(decided, "record_id", "left")
    gone = F.col("refers_record").isNotNull()
    new = old.select(
        fresh_id(F.col("record_id")).alias("record_id"), "page_id", "uri", "date", "payload_digest",
        F.when(~gone, F.col("payload")).alias("payload"),
        F.when(gone, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(gone, fresh_id(F.col("refers_record"))).alias("refers_to_record"),
        F.col("refers_uri").alias("refers_to_uri"),
    )
    write_archives(new, target)
    forget(headers, decided)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path`` with revisits joined to the responses they refer to: ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri``."""
    records = written(read_archives(spark, path, payloads=False).drop("payload"), "warc-headers")
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"))
    joined = records.filter("record_type = 'revisit'").join(originals, "refers_to_record", "left").select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"), "uri")
    return records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "uri").unionByName(joined)

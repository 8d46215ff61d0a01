"""Operator 4: a content-addressed web archive.

Payload bytes are stored once, deflated, under their SHA-256 digest. Exact record headers are kept apart, one row for
each record with the digest of its payload. Records are rebuilt by joining both and written as WARC files, a gzip
member for each record; a record whose bytes don't have the digest that it is stored under is an error. Reading takes
the files alone: each member is parsed, its payload hashed anew and compared with what its header states, and a revisit
gets length and digest from the payload of the record that it refers to.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import shared_dir, stored

#: Digits of base 32 as conv() writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the WARC standard
CAPTURED = "1970-01-01T00:00:00Z"  # the date of records of pages that state none
CHUNK = 1 << 20  # bytes of a file that are read at once
READ = 64  # records in a batch that a reader hands over, or READ_BYTES of payload
READ_BYTES = 16 << 20


class Archive(NamedTuple):
    headers: DataFrame  # sha256, record_type, header
    payloads: DataFrame  # sha256, body (deflated payload)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 40 hex digits, taken five at a time, make 8 groups of four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row for each page, without its payload: page_id, url, record_id, digests and length of the payload, record_type, refers_to, refers_id.

    Of equal payloads of min_bytes or more, rows with the largest page_id are responses and the others revisit one of
    them; a row without a page_id revisits unless no equal payload has one. Smaller payloads are all responses. A null
    html is an empty payload. Rows that repeat the largest page_id are responses all, each with a record_id of its own.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    made = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    made = made.select(
        "page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("_n")
    )
    made = stored(
        made.withColumn(
            "record_id", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("_n"))
        ).drop("_n"),
        "warc-records"
    )
    owner = made.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.max_by("record_id", "page_id").alias("owner_id"))
    made = made.join(owner, "sha256")
    response = (F.col("payload_bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("owner"))
    return made.withColumns({
        "record_type": F.when(response, "response").otherwise("revisit"), "refers_to": F.when(~response, F.col("owner")),
        "refers_id": F.when(~response, F.col("owner_id"))
    }).drop("owner", "owner_id")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")


def header_block(captured: Column) -> Column:
    """The exact header of a record, up to and with the empty line that ends it. A revisit has no block of its own.

    A url with a line end can't stand in a header; it is quoted (%, CR, LF) under a name of its own.
    """
    revisit = F.col("record_type") == "revisit"
    named = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    broken = F.col("url").rlike(r"[\r\n]")
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", named(F.col("record_id"))),
        _header("WARC-Date", captured),
        _header("WARC-Target-URI", F.when(~broken, F.col("url"))),
        _header("WARC-Quoted-Target-URI", F.when(broken, quoted)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", named(F.col("refers_id"))),
        _header("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
    )


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [x.encode() for x in batch.column(0).fill_null("").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(x).hexdigest() for x in bodies]), pa.array([zlib.compress(x) for x in bodies], pa.binary())],
            names=["sha256", "body"]
        )


def write_archive(pages: DataFrame, min_bytes: int = 0, captured: str = CAPTURED) -> Archive:
    """The two tables of the archive, written to the shared folder.

    Payloads are deflated before they are moved, and equal ones of a task are picked before that.
    """
    headers = records(pages, min_bytes).select("sha256", "record_type", header_block(F.lit(captured)).alias("header"))
    bodies = pages.select(F.col("html").cast("string")).mapInArrow(_deflated, "sha256 string, body binary")
    return Archive(stored(headers, "warc-headers"), stored(bodies.dropDuplicates(["sha256"]), "warc-payloads"))


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _writer(path: str):
    """A file for each task, named anew for each attempt; only the files of attempts that end are in the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(path)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for sha256, header, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = b"" if body is None else zlib.decompress(body)
                if body is not None and hashlib.sha256(payload).hexdigest() != sha256:
                    raise ValueError(f"payload differs from its digest: {sha256}")
                if out is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                out.write(gzip.compress(header.encode() + payload + b"\r\n\r\n", 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return run


def write_warc(archive: Archive, path: str) -> DataFrame:
    """Rebuild the records and write them as WARC files into the folder; (file, n_records) of the files written.

    Only responses meet their payloads: a large group of copies is one payload and many headers.
    """
    response = F.col("record_type") == "response"
    whole = archive.headers.filter(response).join(archive.payloads, "sha256", "left").select(
        "sha256", "header", F.coalesce("body", F.raise_error(F.lit("a payload is missing")).cast("binary")).alias("body")
    )
    rows = whole.unionByName(archive.headers.filter(~response).select("sha256", "header", F.lit(None).cast("binary").alias("body")))
    return stored(rows.mapInArrow(_writer(path), "file string, n_records long"), "warc-files")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The members of a gzip stream, one by one."""
    held, left = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    for chunk in chunks:
        left = chunk
        while left:
            parts.append(held.decompress(left))
            left = held.unused_data
            if held.eof:
                yield b"".join(parts)
                held, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a WARC file ends within a record")


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    heads, bodies = [], []
                    for raw in members(iter(lambda: stream.read(CHUNK), b"")):  # noqa: B023
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        heads.append(head.decode() + CRLF + CRLF)
                        bodies.append(rest[:-4])
                        if len(heads) == READ or sum(map(len, bodies)) >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], names=["header", "block"]
                            )
                            heads, bodies = [], []
                    if heads:
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], names=["header", "block"])

    return run


def _field(name: str, pattern: str = "([^\r\n]*)") -> Column:
    return F.nullif(F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1), F.lit(""))


def read_warc(written: DataFrame, path: str) -> DataFrame:
    """A row for each record in the files: record_id, page_id, url, record_type, refers_id, stated_digest, header, block."""
    out = written.select("file").repartition(F.col("file")).mapInArrow(_reader(path), "header string, block binary")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(_field("WARC-Quoted-Target-URI"), "%0A", "\n"), "%0D", "\r"), "%25", "%")
    return out.select(
        _field("WARC-Record-ID", "<([^>]*)>").alias("record_id"),
        _field("WARC-Record-ID", "<urn:page:([^:>]*):[^>]*>").try_cast("long").alias("page_id"),
        F.coalesce(plain, _field("WARC-Target-URI")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To", "<([^>]*)>").alias("refers_id"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("stated_digest"),
        "header",
        "block",
    )


def described(found: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of each record that read_warc found.

    Length and digest are of the bytes in the file, for a revisit those of the record that it refers to; bytes that
    differ from what a header states raise an error.
    """
    known = found.withColumns({
        "payload_bytes": F.octet_length("block").cast("long"), "payload_digest": base32_sha1(F.col("block"))
    }).drop("block", "header")
    known = stored(known, "warc-read")
    held = known.filter("record_type = 'response'")
    seen = held.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = known.filter("record_type <> 'response'").drop("payload_bytes", "payload_digest").join(seen, "refers_id", "left")
    every = held.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again.select(*held.columns, "refers_to"))
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id")))
    digest = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(bad)
    return every.select("page_id", "url", "record_type", "refers_to", "payload_bytes", digest.alias("payload_digest"))


def payloads_of(found: DataFrame) -> DataFrame:
    """(record_id, page_id, url, payload) of each record that read_warc found, revisits with the payload they refer to."""
    held = found.filter("record_type = 'response'").select("record_id", "page_id", "url", F.col("block").alias("payload"))
    again = found.filter("record_type <> 'response'").select("record_id", "page_id", "url", F.col("refers_id").alias("_id"))
    return held.unionByName(again.join(held.select(F.col("record_id").alias("_id"), "payload"), "_id").drop("_id"))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) written as an archive in the shared folder and read back: described() of its records.

    A row for each page. A null url has no field; other columns are ignored; an empty table gives an empty result.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return described(read_warc(write_warc(write_archive(pages, min_bytes), path), path))

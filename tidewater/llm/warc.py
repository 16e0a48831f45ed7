"""WARC archives: writing and sequential reading, one gzip member per record.

Writing is two steps.  Spark decides the record type (a digest's largest id is
the response, the others revisit it) from (id, digest) pairs only, with a
partial aggregate before the shuffle and an adaptive join, so a payload that
fills a third of the table is spread out.  Tasks then append records to files
of bounded size below the shared folder and return a manifest.  A file is
written under an attempt's own name, so retried tasks leave no half-written
file in the manifest, and the manifest itself is written before it is used.

Reading takes one file per task: bytes come in blocks, one ``zlib``
decompressor per gzip member, headers up to the empty line, then exactly
Content-Length bytes; block and payload digests are verified.  Memory is a
block and the record at hand.

Defined results: a null payload is the empty one; rows with a null id are
written and read back with a null id and are never the one that others refer
to unless all ids of that payload are null; rows with equal id and payload are
of the same type; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialised, shared_dir, shuffle_partitions, text_or_empty

BLOCK = 1 << 20
FILE_BYTES = 1 << 28  # compressed bytes after which a new file begins
BATCH_BYTES = 8 << 20  # payload bytes per Arrow batch that the reader gives
LEVEL = 4
HEADER_LIMIT = 1 << 20

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "page_id long, record_type string, payload_bytes long, payload_digest string,"
    " refers_to long, url string, date string, payload binary"
)
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("date", pa.string()),
        ("payload", pa.binary()),
    ]
)


class WarcError(ValueError):
    """An archive that breaks the format or a digest that does not fit."""


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def header_value(text: str | None) -> str:
    """One header line's worth of text; line ends and per cent signs become escapes."""
    out = (text or "").replace("%", "%25") if re.search(r"[\r\n]", text or "") else text or ""
    return out.replace("\r", "%0D").replace("\n", "%0A").strip()


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str
) -> bytes:
    """An uncompressed record.  A revisit keeps the response's HTTP header, with the payload's length, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, decompressed block by block."""
    rest, unpacker, parts = b"", None, []
    while True:
        data = rest or stream.read(BLOCK)
        rest = b""
        if not data:
            break
        if unpacker is None:
            unpacker = zlib.decompressobj(31)
        try:
            parts.append(unpacker.decompress(data))
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from e
        if unpacker.eof:
            rest = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = None, []
    if unpacker is not None:
        raise WarcError("the archive ends inside a gzip member")


def headers(data: bytes, start: int = 0) -> tuple[str, dict[str, str], int]:
    """(first line, fields with lower-case names, where the block begins)."""
    end = data.find(b"\r\n\r\n", start, start + HEADER_LIMIT)
    if end < 0:
        raise WarcError("a header without an end")
    first, *lines = data[start:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def parsed(member: bytes) -> dict:
    """A record's fields; framing and digests are verified."""
    version, fields, at = headers(member)
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("a record without a valid Content-Length") from e
    block = member[at : at + length]
    if len(block) != length or member[at + length :] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    if fields.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise WarcError("block digest does not fit")
    _, http, body = headers(block)
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block[body:] if kind == "response" else None
    if payload is not None:
        if base32_sha1(payload) != digest:
            raise WarcError("payload digest does not fit")
        if int(http.get("content-length", len(payload))) != len(payload):
            raise WarcError("the HTTP length does not fit the payload")
    return {
        "page_id": page_of(fields.get("warc-record-id")),
        "record_type": kind,
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers_to": page_of(fields.get("warc-refers-to")),
        "url": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload": payload,
    }


def with_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``refers_to`` and ``revisit`` to rows of (id, digest, payload, ...).

    Payloads below ``min_bytes`` are all responses.  Only ids and digests are
    shuffled for the choice; the payloads meet it on (id, digest), which no
    large group shares.
    """
    keyed = pages.where(F.octet_length("payload") >= min_bytes).select("id", "digest")
    top = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id")))["id"]
    first = keyed.groupBy("digest").agg(top.alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = keyed.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("id").alias("of"), F.col("digest").alias("by"), "refers_to", F.lit(True).alias("revisit"))
    out = pages.join(again, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("by")), "left")
    return out.withColumn("revisit", F.coalesce("revisit", F.lit(False)))


def write_archives(
    pages: DataFrame,
    root: str,
    date: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Write the archives below ``root``; the manifest as (path, n_records, n_bytes)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        text_or_empty(payload_col).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    typed = with_types(rows, min_bytes).select("id", "url", "payload", "refers_to", "revisit")

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        out, path, n, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers, revisit = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                digest = base32_sha1(payload)
                member = gzip_member(record(page, url, payload, digest, refers, revisit, date))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    close()
        close()
        if done:
            columns = [pa.array(c) for c in zip(*done, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "n_records", "n_bytes"])

    return materialised(typed.mapInArrow(append, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``manifest``: columns of ``RECORDS``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

        for files in batches:
            for path, n_records in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                rows, held, found = [], 0, 0
                with fs.open_input_stream(path, compression=None, buffer_size=BLOCK) as stream:
                    for member in members(stream):
                        row = parsed(member)
                        found += 1
                        held += len(row["payload"] or b"")
                        rows.append(row if with_payload else row | {"payload": None})
                        if held >= BATCH_BYTES or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                if found != n_records:
                    raise WarcError(f"{path}: {found} records, the manifest says {n_records}")
                if rows:
                    yield batch(rows)

    files = manifest.select("path", "n_records")
    return files.repartition(shuffle_partitions(spark)).mapInArrow(scan, RECORDS)


def archived(pages: DataFrame, date: str, **columns) -> DataFrame:
    """Write archives below the shared folder and read their records back."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    return read_archives(spark, write_archives(pages, root, date, **columns), root)

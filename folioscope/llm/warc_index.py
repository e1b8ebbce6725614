"""WARC archives, index first.

``write`` puts one gzip member per record into archive files in the shared
folder and returns the index: file, offset, length, url and digest of each
record. ``read`` takes any selection of the index, sorts it by file and offset,
joins neighbouring byte ranges into one read and returns the parsed records,
with every payload held against its digest.

Of the records with equal payloads (of at least ``least_bytes`` bytes) the one
with the smallest id is a ``response``, the others are ``revisit`` records
without a payload that refer to it. The choice needs only digest and id: they
are aggregated first, then joined to the pages.

An archive file belongs to one attempt of one task; the index, written as a
table before anything is read, names the files of successful attempts only. So
a lost executor leaves an unused file, never a wrong record.

Defined results: a null payload is empty. A null url has no target header, and
reads back as null. Null ids sort last; if a payload has null ids only, all its
records are responses. Rows that repeat the smallest id of a payload are all
responses. Control characters of a url are percent-encoded in the header.
An empty table gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices, written
from folioscope.session import shared_path

#: Bytes after which a task begins another archive file.
FILE_BYTES = 1 << 30
#: Two reads whose gap is at most this are one, up to ``READ_BYTES``.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX_SCHEMA = ("page_id bigint, url string, file string, offset bigint, length bigint, "
                "digest string, record_type string")
RECORD_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
                 "payload_bytes bigint, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One WARC record, uncompressed."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the payload of a response is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(m) if (m := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("WARC-Record-ID"),
            "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
            "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_digest": digest,
            "payload_bytes": int(fields["X-Payload-Length"]), "payload": payload}


def _writer(base: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(base)
        out, name, at = None, "", 0
        try:
            for part in slices(batches, 2):
                rows: list[tuple] = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    payload = (html or "").encode()
                    digest = base32_sha1(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, digest, first, date)) + packer.flush()
                    out.write(data)
                    rows.append((page_id, url, name, at, len(data), digest, "response" if first is None else "revisit"))
                    at += len(data)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()
    return run


def write(pages: DataFrame, base: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
          id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> tuple[DataFrame, str]:
    """Writes the archives below ``base`` (default: a new folder in the shared
    folder); returns the index table and ``base``."""
    spark = pages.sparkSession
    if base is None:
        base = shared_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    store, top = pafs.FileSystem.from_uri(base)
    store.create_dir(top, recursive=True)
    html = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = (rows.where(F.octet_length("html") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first")))
    chosen = rows.join(firsts.hint("shuffle_hash"), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    return written(chosen.mapInArrow(_writer(base, date), INDEX_SCHEMA), "warc-index"), base


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined into (file, start, end, its parts)."""
    file, start, end, parts = "", 0, 0, []
    for name, offset, length in rows:
        if parts and name == file and offset - end <= GAP_BYTES and offset + length - start <= READ_BYTES:
            parts.append((offset, length))
            end = max(end, offset + length)
            continue
        if parts:
            yield file, start, end, parts
        file, start, end, parts = name, offset, offset + length, [(offset, length)]
    if parts:
        yield file, start, end, parts


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(base)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
                 "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, start, end, parts in _ranges(rows):
                if opened[0] != file:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = file, store.open_input_file(f"{top}/{file}")
                data = opened[1].read_at(end - start, start)
                found = [parse(zlib.decompress(data[o - start:o - start + n], 31)) for o, n in parts]
                yield pa.record_batch([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))
        if opened[1] is not None:
            opened[1].close()
    return run


def read(index: DataFrame, base: str) -> DataFrame:
    """The records that ``index`` (any selection of its rows) names."""
    ordered = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(base), RECORD_SCHEMA)

"""WARC archives: one gzip member per record, written per partition and read back sequentially.

Writing: records are streamed into archives below a shared folder (any file system that Arrow can open by URI; Hadoop's
names for object stores are understood). Each attempt of a task writes archives of its own names, and only those of the
attempt that succeeds get into the manifest, so nothing is moved or overwritten. A response's block is an HTTP response
whose body is the payload; a revisit's block is the head of such a response alone. Reading: an archive is read in blocks,
members are inflated incrementally, the record is framed by its Content-Length, block and payload are compared with their
digests, and the payload's length with that of the HTTP head.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: that with the smallest id is a response, others are
revisit records that name it and carry no payload. The smallest id per digest comes from a partially aggregated
group-by; a skewed digest is split by AQE in the join that follows.

Defined results: null html is an empty payload; a null or empty url is written as the target ``about:blank``; rows
repeated (equal id) are written once each, of equal ids and payloads all are responses; null page_ids sort after all
others, and if all ids of a payload are null all are responses; an empty table gives no archive and no row; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut, ensure_checkpoint_dir

MIN_REVISIT = 100
ROLL_BYTES = 1 << 30
BLOCK = 1 << 20
_END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive whose framing or digests are wrong."""


#: Hadoop's names of schemes, and what Arrow calls them. (fixed values)
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gcs": "gs"}


def _opened(uri: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark:
        uri = SCHEMES.get(scheme, scheme) + mark + rest
    elif uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    """A header value: control characters and percent signs are percent-encoded, so a value can't end its line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed as a gzip member of its own."""
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url or "about:blank")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block + _END
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, length of the full payload) of each record of an open binary file; a revisit's payload is empty.

    Holds one record and one block of the file in memory.
    """
    inflate, raw, begun = zlib.decompressobj(31), bytearray(), False
    while data := source.read(BLOCK):
        while data:
            begun = True
            raw += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                yield _parsed(bytes(raw))
                inflate, raw, begun = zlib.decompressobj(31), bytearray(), False
    if begun:
        raise ArchiveError("the archive ends inside a record")


def _fields(lines: list[str]) -> dict[str, str]:
    return {name: value.strip() for name, _, value in (x.partition(":") for x in lines)}


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise ArchiveError("a member doesn't begin with a WARC header")
    fields = _fields(lines)
    length = int(fields["Content-Length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != _END:
        raise ArchiveError("Content-Length doesn't frame the record")
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ArchiveError("the block digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    if not gap or not re.match(r"HTTP/\d\.\d \d{3}", status):
        raise ArchiveError("the block isn't an HTTP response")
    size = int(_fields(lines)["Content-Length"])
    if fields["WARC-Type"] == "response":
        if fields["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise ArchiveError("the payload digest is wrong")
        if size != len(payload):
            raise ArchiveError("the payload hasn't the length that its head names")
    elif payload:
        raise ArchiveError("a revisit carries a payload")
    return fields, payload, size


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    ident, html = pages[id_col].cast("long"), F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(ident.alias("page_id"), pages[url_col].alias("url"), html.alias("html"), F.coalesce(F.sha2(html, 256), F.lit("")).alias("digest"))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Payloads that occur once need no partner: the join carries ids and digests of the others only.
    again = large.select("page_id", "digest").join(firsts.where("n > 1").drop("n"), "digest")
    refers = again.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to"))
    refers = refers.distinct()
    joined = rows.join(refers, rows["page_id"].eqNullSafe(refers["__id"]) & (rows["digest"] == refers["__digest"]), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes ``records`` (of plan_records) below ``folder``; the manifest: path, n_records, bytes."""
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, base = _opened(folder)
        done, out, k, n, size = [], None, 0, 0, 0

        def name() -> str:
            return f"part-{part:06d}-{k:04d}-{attempt}.warc.gz"

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name()}", n, size))

        for b in batches:
            for page, url, html, digest, refers in zip(*(b[c].tolist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page, refers = (None if x is None or x != x else int(x) for x in (page, refers))
                member = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers, refers is not None, stamp)
                if out is None:
                    files.create_dir(base, recursive=True)
                    out, n, size = files.open_output_stream(posixpath.join(base, name()), compression=None), 0, 0
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_records", "bytes"])

    typed = records.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return cut(typed.mapInPandas(run, "path string, n_records long, bytes long"))


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, content string"


def read_archives(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records of the archives that ``manifest`` lists, one task per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for b in batches:
            for path, expected in zip(b["path"], b["n_records"], strict=True):
                files, name = _opened(path)
                rows, size, n = [], 0, 0
                with files.open_input_stream(name, compression=None) as source:
                    for head, payload, full in read_archive(source):
                        number = lambda k, h=head: int(h[k]) if h.get(k) else None
                        rows.append((number("X-Page-ID"), head["WARC-Target-URI"], head["WARC-Type"], number("X-Refers-To-Page-ID"), head["WARC-Payload-Digest"].removeprefix("sha256:"), full, payload.decode("utf-8", "surrogatepass")))
                        size, n = size + len(payload), n + 1
                        if size >= 16 * BLOCK:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if n != expected:
                    raise ArchiveError(f"{path} has {n} records, not {expected}")
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.repartition(tasks or max(1, manifest.count())).mapInPandas(run, READ_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives below a shared folder and reads them back."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(plan_records(pages), folder))

"""WARC archives and the normaliser of monolithic gzip files.

Captures are first written as whole-file gzip streams, as some crawlers leave them: no record can be read
without inflating all before it. The normaliser inflates such a file once, as a stream,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets. Readers then seek
to a record. Records whose payload an earlier page has become revisits on the way; that is decided on
index rows only, payloads are never shuffled.

Each task attempt writes files under a name of its own; only those listed in a written table count, so a lost
executor or a repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import materialize, new_path

FILE_BYTES = 32 << 20  # payload bytes after which a task begins another file
LEVEL = 3
_CHUNK = 1 << 18
_GZIP = 31
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = "file string, ordinal long, page_id long, digest string, payload_bytes long"
ARCHIVE = "archive string, sidecar string, records long, archive_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, payload string"


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(place: str) -> str:
    """The id of the record captured at ``<file>#<ordinal>``."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def _opened(uri: str, how: str):
    """A stream of a file in any store that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if how == "write":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None) if how == "read" else system.open_input_file(path)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record. Control characters in header values are percent-encoded."""
    lines = ["WARC/1.1"]
    for key, value in headers.items():
        if value is not None:
            safe = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
            lines.append(f"{key}: {safe}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def inflated_records(stream) -> Iterator[bytes]:
    """The records of a whole-file gzip stream, inflated once and never held as a whole.

    Files of several members are read as well; the normaliser may be given what it wrote.
    """
    inflate, buffer, more = zlib.decompressobj(_GZIP), bytearray(), True
    while True:
        end = buffer.find(b"\r\n\r\n")
        size = None
        if end >= 0:
            length = re.search(rb"\r\nContent-Length: (\d+)", buffer[:end])
            if not length:
                raise ValueError("a record without Content-Length")
            size = end + 4 + int(length[1]) + 4
        if size is not None and len(buffer) >= size:
            yield bytes(buffer[:size])
            del buffer[:size]
            continue
        if not more:
            if buffer:
                raise ValueError("the archive ends inside a record")
            return
        chunk = stream.read(_CHUNK)
        more = bool(chunk)
        while chunk:
            buffer += inflate.decompress(chunk)
            chunk = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(_GZIP)


def _write(folder: str, date: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = packer = name = None
        size = ordinal = 0
        for batch in batches:
            rows = []
            for page, url, html in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], strict=True):
                if out is None:
                    name, size, ordinal = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = _opened(name, "write"), zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                page = None if page is pd.NA else int(page)
                payload = (html or "").encode()
                digest = payload_digest(payload)
                headers = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": record_id(f"{name}#{ordinal}"),
                    "WARC-Date": date, "WARC-Target-URI": url or f"urn:page:{page}",
                    "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": None if page is None else str(page),
                    "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response",
                }
                out.write(packer.compress(record(headers, _HTTP + payload)))
                rows.append((name, ordinal, page, digest, len(payload)))
                size, ordinal = size + len(payload), ordinal + 1
                if size >= file_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=["file", "ordinal", "page_id", "digest", "payload_bytes"]).astype({"page_id": "Int64"})
        if out is not None:
            out.write(packer.flush())
            out.close()

    return run


def write_monolithic(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as whole-file gzip archives; returns a written row per record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(rows.mapInPandas(_write(folder, date, file_bytes), CAPTURE), "captures")


def revisits(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures with record_type, refers_to (the response's page_id) and refers_place (where it was captured).

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id (nulls last, then the first written)
    is the response, the others revisit it.
    """
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "ordinal")
    firsts = (
        captures.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & (place != F.col("first")) & (F.col("payload_bytes") >= least_bytes)
    return captures.join(firsts, "digest", "left").select(
        *captures.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.concat("first.file", F.lit("#"), F.col("first.ordinal").cast("string"))).alias("refers_place"),
    )


def _normalise(folder: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = records = out = sidecar = stream = None
        offset = count = 0

        def closed() -> pd.DataFrame:
            for x in (out, sidecar, stream):
                x.close()
            return pd.DataFrame([(target, f"{target}.idx", count, offset)], columns=["archive", "sidecar", "records", "archive_bytes"])

        for batch in batches:
            for row in batch.astype({"refers_to": "Int64"}).to_dict("records"):
                if row["file"] != name:
                    if name is not None:
                        yield closed()
                    name, offset, count = row["file"], 0, 0
                    target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    stream, out, sidecar = _opened(name, "read"), _opened(target, "write"), _opened(f"{target}.idx", "write")
                    records = inflated_records(stream)
                whole = next(records)
                if row["record_type"] == "revisit":
                    headers, block = split_record(whole)
                    headers.pop("Content-Length")
                    headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    headers["WARC-Refers-To"] = record_id(row["refers_place"])
                    if row["refers_to"] is not pd.NA:
                        headers["X-Refers-To-Page-ID"] = str(row["refers_to"])
                    whole = record(headers, block[: len(_HTTP)])
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                member = pack.compress(whole) + pack.flush()
                out.write(member)
                sidecar.write(json.dumps([offset, len(member), row["record_type"], row["digest"]]).encode() + b"\n")
                offset, count = offset + len(member), count + 1
        if name is not None:
            yield closed()

    return run


def normalise(captures: DataFrame, folder: str) -> DataFrame:
    """Rewrites the monolithic files that ``captures`` (with record types) list; a written row per new archive."""
    files = max(captures.select("file").distinct().count(), 1)  # a stated number of partitions is not coalesced by their few bytes
    ordered = captures.repartition(files, "file").sortWithinPartitions("file", "ordinal")
    rows = ordered.select("file", "record_type", "refers_to", "refers_place", "digest").mapInPandas(_normalise(folder), ARCHIVE)
    return materialize(rows, "archives")


def _read(with_payload: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for archive, sidecar in zip(batch["archive"], batch["sidecar"], strict=True):
                with _opened(sidecar, "read") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                rows = []
                with _opened(archive, "seek") as f:
                    for offset, length, _, _ in index:
                        f.seek(offset)
                        headers, block = split_record(zlib.decompress(f.read(length), _GZIP))
                        kind, page = headers["WARC-Type"], headers.get("X-Page-ID")
                        refers = headers.get("X-Refers-To-Page-ID")
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        payload = None
                        if kind == "response":
                            body = block[len(_HTTP) :]
                            if (payload_digest(body), len(body)) != (digest, size):
                                raise ValueError(f"damaged record at {offset} of {archive}")
                            payload = body.decode() if with_payload else None
                        rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers), archive, offset, length, payload))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each read by its offset; payloads are checked against their digests.

    There are as many tasks as archives. Null page_ids stay null, an empty payload is an empty text, and no archives
    give no rows.
    """
    return archives.repartition(max(archives.count(), 1), "archive").mapInPandas(_read(with_payload), RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written, normalised with revisits, and the written table of archives.

    Null html is an empty payload, a null url becomes ``urn:page:<id>``; a null page_id stays null. Repeated rows are
    records of their own, all but the first revisits. An empty table gives no archives. Other columns are ignored.
    """
    root = new_path(pages.sparkSession, "warc")
    captures = write_monolithic(pages, f"{root}/raw")
    return normalise(revisits(captures, least_bytes), f"{root}/members")

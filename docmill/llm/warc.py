"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

`write_archives` writes a record per page into archives that are compressed as a whole, as some
crawlers leave them: nothing in them can be read without inflating all that is before it.
`normalise` inflates such a file once, from start to end, writes every record again as a gzip
member of its own, and puts an index of offsets beside the file. `read_archives` then reads single
records by the index and checks their digests.

Files go below the shared folder through the file system its address names. A task writes under
names no other attempt uses, and only files that a finished task reports are read, so lost
executors and repeated tasks leave no half-written archive behind.

Defined results: a null html is an empty payload. Of records with equal payloads of at least
`min_bytes`, those with the smallest page_id are responses and the others revisit it; smaller
payloads and rows without an id are responses and are never referred to. Rows that repeat the
smallest id are responses too. Null and odd urls are allowed. Other columns are not looked at.
Empty tables write no archive and give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import scratch_path, staged

MIN_BYTES = 0
#: Bytes before compression after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "archive string, offset long, length long")


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; addresses without a scheme are local."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", address))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record; line breaks in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, name: str) -> bytes:
    """A response with the payload, or a revisit with the response's HTTP headers only."""
    revisit = first is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    return record([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(f"page:{page_id}" if page_id is not None else name)),
        ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(f"page:{first}") if revisit else None),
        ("Page-Id", page_id), ("Refers-To-Page-Id", first),
        ("Content-Type", "application/http; msgtype=response"),
    ], http if revisit else http + payload)


def headers_of(raw: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record, names in lower case, and where its block begins."""
    end = raw.index(b"\r\n\r\n") + 4
    first, *lines = raw[:end - 4].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    pairs = (line.split(":", 1) for line in lines)
    return {k.strip().lower(): v.strip() for k, v in pairs}, end


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of every record of a gzip stream, of one member or several; a record at a time."""
    inflate, held, need = zlib.decompressobj(31), bytearray(), 0
    headers = None
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk, 16 * CHUNK)
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
            while True:
                if headers is None:
                    end = held.find(b"\r\n\r\n", max(0, need - 3))
                    if end < 0:
                        need = len(held)
                        break
                    headers, start = headers_of(bytes(held[:end + 4]))
                    need = start + int(headers["content-length"]) + 4
                if len(held) < need:
                    break
                yield headers, bytes(held[:need])
                del held[:need]
                headers, need = None, 0
    if held:
        raise ValueError(f"archive ends within a record, {len(held)} bytes from its start")


def pages_writer(root: str, archive_bytes: int):
    """Write rows (page_id, url, html, first) to archives of one gzip stream each; yields their paths."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(root)
        out, paths = None, []

        def close():
            out.write(squeeze.flush())
            out.close()
        for batch in batches:
            for page_id, url, html, first in zip(*[batch.column(i) for i in range(4)]):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(squeeze.compress(record([
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n")))
                    paths.append(name)
                n += 1
                raw = page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py(), f"{name}:{n}")
                out.write(squeeze.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["archive"])
    return of


def write_archives(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) below `root`; archive: the names of the files."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    # only digests meet here; the pages move once, if there are too many repeated ones to broadcast
    repeated = staged(rows.where(f"page_id IS NOT NULL AND size >= {int(min_bytes)}").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated")
    first = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "html", first.alias("first"))
    return staged(rows.mapInArrow(pages_writer(root, archive_bytes), "archive string"), "archives")


def spread(archives: DataFrame) -> DataFrame:
    """About an archive for each task; whole files go through a task one at a time."""
    return archives.repartition(max(1, min(archives.count(), 20_000)), "archive")


def normaliser(source: str, target: str, level: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, folder), (to, place) = opened(source), opened(target)
        for batch in batches:
            done = []
            for name in batch.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}-{name}"
                to.create_dir(place, recursive=True)
                at = 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as file, \
                        to.open_output_stream(f"{place}/{new}", compression=None) as out, \
                        to.open_output_stream(f"{place}/{new}.index", compression=None) as index:
                    for headers, raw in records_in(iter(lambda: file.read(CHUNK), b"")):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        index.write(json.dumps({"id": headers.get("warc-record-id"), "type": headers.get("warc-type"),
                                                "offset": at, "length": len(member)}).encode() + b"\n")
                        at += len(member)
                done.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])
    return of


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite `archives` (names in `source`) below `target`, a gzip member per record and an index beside each file."""
    return staged(spread(archives).mapInArrow(normaliser(source, target, level), "archive string"), "normalised")


def page_of(headers: dict[str, str], raw: bytes, start: int) -> tuple:
    """What a page's record says; a payload that does not match its digest or length is an error."""
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    http, _, payload = raw[start:-4].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload in record {headers.get('warc-record-id')}")
    page, first = headers.get("page-id"), headers.get("refers-to-page-id")
    return page and int(page), size, digest, kind, first and int(first)


def pages_reader(root: str, schema: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{name}.index", compression=None) as index:
                    entries = [json.loads(line) for line in index.read().splitlines()]
                rows = []
                with system.open_input_file(f"{folder}/{name}") as file:
                    for entry in entries:
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        raw = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
                        headers, start = headers_of(raw)
                        rows.append((*page_of(headers, raw, start), name, entry["offset"], entry["length"]))
                columns = zip(*rows) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return of


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """A row per page record of normalised `archives` below `root`, with its place."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
                        ("offset", pa.int64()), ("length", pa.int64())])
    return spread(archives).mapInArrow(pages_reader(root, schema), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write `pages` as whole-stream archives, normalise them, drop the first form, read the pages back."""
    root = scratch_path(spark, "warc")
    written = write_archives(pages, f"{root}/streams", min_bytes)
    archives = normalise(written, f"{root}/streams", f"{root}/records")
    system, folder = opened(f"{root}/streams")
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        system.delete_dir(folder)
    return read_archives(archives, f"{root}/records")

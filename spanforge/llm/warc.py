"""WARC archives with an index: write first, then read selected records by coalesced byte ranges.

Each task writes its records, one gzip member each, to archives of its own and returns an
index row (file, offset, length, url, digest) for each; the index is a table in the shared
folder. To read, the selected index rows are range-sorted by file and offset, and
neighbouring ranges are joined to one read.

Records with equal payloads of at least MIN_REVISIT bytes are one response (the largest page
id) and revisits that refer to it.

Rules for odd input: null html is an empty payload; a null url is written as an empty target;
line ends in urls are percent-encoded; rows that repeat the largest id of a payload are all
responses; very long payloads are one record, held by a task at a time; a null id counts as smaller than any and is read back as null; an empty table gives an empty
result. Only page_id, url and html are read.

Lost executors: an archive's name is new for each attempt and only finished attempts commit their
index rows, so what a lost attempt wrote is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .running import same

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than GAP bytes are one read of at most READ bytes (a longer record is a read by itself).
GAP = 64 << 10
READ = 8 << 20
#: Archive bytes that a task reads back.
TASK_BYTES = 8 << 20

INDEX_SCHEMA = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: bytes) -> int | None:
    value = urn.decode().removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """The fields of a record; the payload's digest is computed again where there is a payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), fields[b"warc-type"].decode()
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
        raise ValueError(f"damaged payload in {fields[b'warc-record-id'].decode()}")
    refers = fields.get(b"warc-refers-to")
    return {"page_id": _page(fields[b"warc-record-id"]), "url": fields[b"warc-target-uri"].decode(), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers and _page(refers)}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(batches, folder: str):
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    out = name = None
    at = 0
    for batch in batches:
        rows = []
        for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
            if out is None or at >= ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            body = record(page_id, url, (html or "").encode(), digest, refers)
            out.write(body)
            rows.append((name, at, len(body), page_id, url, digest, "response" if refers is None else "revisit"))
            at += len(body)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
    if out is not None:
        out.close()


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    small = pages.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    most = small.groupBy("digest").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("digest", "__digest")
    # by page from here on: a payload in a third of all pages is no hot key of the large join
    revisits = small.join(most, small["digest"] == most["__digest"]).filter("page_id is null and most is not null or page_id < most").select(F.col("page_id").alias("__page"), "__digest", F.col("most").alias("refers_to")).distinct()
    return pages.join(revisits, same(pages, revisits, [("page_id", "__page"), ("digest", "__digest")]), "left").drop("__page", "__digest")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page under folder; returns the index, a table in the shared folder."""
    index = with_revisits(pages).mapInArrow(lambda it: _write(it, folder), INDEX_SCHEMA)
    return common.materialise(index, "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """Of (offset, length) sorted by offset: (first row, end row, start byte, end byte) of each read."""
    a, start, end = 0, *((rows[0][0], sum(rows[0])) if rows else (0, 0))
    for k in range(1, len(rows)):
        offset, length = rows[k]
        if offset > end + gap or offset + length - start > most:
            yield a, k, start, end
            a, start, end = k, offset, offset
        end = max(end, offset + length)
    if rows:
        yield a, len(rows), start, end


def _read(batches, folder: str):
    store, root = _open(folder)
    source, name = None, None
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            if rows[at][0] != name:
                if source is not None:
                    source.close()
                name = rows[at][0]
                source = store.open_input_file(f"{root}/{name}")
            part = [r[1:] for r in rows[at:end]]
            for a, b, start, stop in ranges(part):
                body = source.read_at(stop - start, start)
                found = [parse(body[o - start : o - start + n]) for o, n in part[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds)], names=names)
            at = end
    if source is not None:
        source.close()


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows (select any of them first)."""
    tasks = common.pieces(index.agg(F.sum("length")).first()[0] or 0, TASK_BYTES)  # index rows are small whatever they point to
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(lambda it: _read(it, folder), RECORD_SCHEMA)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Writes archives of pages to the shared folder and reads every record back."""
    folder = common.new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

"""WARC 1.1 archives: a writer that stores repeated payloads once, and a reader that salvages damaged files.

Archives are files of gzip members, one record each, in a folder that every executor can reach (any
file system that pyarrow opens). A task that is run again writes files of new names; only the files
that the manifest names are read.

The reader checks each member (gzip's own CRC), the version line, the lengths and the block's SHA-1.
After a failed check it searches for the next member, or in an uncompressed file for the next version line, that
passes all checks, goes on from there, and reports the bytes between as a quarantined gap.

Payloads of ``least`` bytes or more that are equal are stored once, as the response of the largest id; the
other pages become revisit records. Where that id is repeated, each of its rows is a response.

Defined results: a null payload is empty; null ids write records without an id, revisit as others do, and are
responses where their payload has no other page; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/[01]\.\d+\r?\n")


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its block digest and length."""
    told = [*headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in told)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit: the same HTTP head without the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return build_record(head, http if revisit else http + payload)


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers in lower case, block, end) of the record at a place; None if any check fails."""
    start = _START.match(data, at)
    if not start:
        return None
    end = data.find(b"\r\n\r\n", start.end() - 2)
    if end < 0:
        return None
    headers = {}
    for line in data[start.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            return None
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    block = data[end + 4 : end + 4 + int(length)]
    stop = end + 4 + int(length) + 4
    if len(block) != int(length) or data[stop - 4 : stop] != b"\r\n\r\n":
        return None
    told = headers.get("warc-block-digest", "").lower()
    if told.startswith("sha1:") and len(told) == 45 and told[5:] != hashlib.sha1(block).hexdigest():
        return None
    return headers, block, stop


def _open_member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a place; None if it is damaged or cut off."""
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(data[at:] if at else data)
    except zlib.error:
        return None
    return (out, len(data) - len(unpack.unused_data)) if unpack.eof else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record", from, to, headers, block) of each sound record and ("gap", from, to, {}, b"") of each quarantined stretch, in order."""
    data = memoryview(data).tobytes()
    packed = data[:2] == _MEMBER[:2] or (not _START.match(data) and _MEMBER in data and not _START.search(data))
    at, bad = 0, -1
    while at < len(data):
        found, end = [], -1
        if packed:
            # members are looked at in slices that grow, so that one member doesn't cost the whole file's copy
            if data.startswith(_MEMBER, at):
                size = 1 << 16
                while end < 0:
                    piece = data[at : at + size]
                    got = _open_member(piece, 0)
                    if got:
                        end = at + got[1]
                        place = 0
                        while place < len(got[0]) and (r := parse_record(got[0], place)):
                            found.append((r[0], r[1]))
                            place = r[2]
                        if place < len(got[0]) or not found:
                            found, end = [], -1
                        break
                    if at + size >= len(data) or not _may_go_on(piece):
                        break
                    size *= 4
        elif r := parse_record(data, at):
            found, end = [(r[0], r[1])], r[2]
        if found:
            if bad >= 0:
                yield "gap", bad, at, {}, b""
                bad = -1
            for headers, block in found:
                yield "record", at, end, headers, block
            at = end
            continue
        if bad < 0:
            bad = at
        if packed:
            at = data.find(_MEMBER, at + 1)
        else:
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else -1
        if at < 0:
            break
    if bad >= 0:
        yield "gap", bad, len(data), {}, b""


def _may_go_on(piece: bytes) -> bool:
    unpack = zlib.decompressobj(31)
    try:
        unpack.decompress(piece)
    except zlib.error:
        return False
    return not unpack.eof


def _folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def plan_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id") -> DataFrame:
    """``pages`` (id, url, html) with ``__payload`` and ``__refers_to`` (null for responses)."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col("url").alias("__url"), F.coalesce("html", F.lit("")).cast("binary").alias("__payload"))
    rows = rows.withColumn("__digest", F.when(F.octet_length("__payload") >= least, F.sha1("__payload")))
    groups = rows.filter(F.col("__digest").isNotNull()).groupBy("__digest").agg(F.max("__id").alias("__first"), F.count("*").alias("__n"))
    again = groups.filter("__n > 1 and __first is not null").select("__digest", "__first")
    joined = rows.filter(F.col("__digest").isNotNull()).join(again, "__digest", "left")  # one row a digest on the right: a hot digest's pages can be split
    refers = F.when(F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first"))
    digested = joined.select("__id", "__url", "__payload", refers.alias("__refers_to"))
    short = rows.filter(F.col("__digest").isNull()).select("__id", "__url", "__payload", F.lit(None).cast(rows.schema["__id"].dataType).alias("__refers_to"))
    return digested.unionByName(short)  # short pages stay where they are


def write_archives(planned: DataFrame, folder: str, rotate: int = 64 << 20) -> DataFrame:
    """Writes the planned records; the manifest (``path``, ``records``, ``bytes``), a row a file, cut off from its lineage."""
    columns = planned.select(F.col("__id").cast("string"), "__url", "__payload", F.col("__refers_to").cast("string"))

    def run(batches):
        fs, root = _folder(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                packed = member(page_record(page, url, payload, refers, refers is not None))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= rotate:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return materialise(columns.mapInArrow(run, "path string, records long, bytes long"))


_READ = "path string, kind string, start long, stop long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the manifest's files: ``kind`` is "record" or "gap", with the bytes from ``start`` to ``stop``.

    A response's payload is checked against its digest; a record that fails is a gap.
    """

    def urn(x: str | None) -> str | None:
        return x[10:-1] if x and x.startswith("<urn:page:") and len(x) > 11 else None

    def row(path: str, kind: str, a: int, b: int, h: dict, block: bytes) -> tuple:
        if kind == "gap":
            return (path, kind, a, b, *[None] * 7)
        head, _, payload = block.partition(b"\r\n\r\n")
        told = h.get("warc-payload-digest", "").partition(":")[2].lower()
        if h.get("warc-type") == "revisit":
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            return path, kind, a, b, "revisit", urn(h.get("warc-record-id")), h.get("warc-target-uri"), urn(h.get("warc-refers-to")), told, int(size[1]) if size else None, None
        digest = hashlib.sha1(payload).hexdigest()
        if told and told != digest:
            return (path, "gap", a, b, *[None] * 7)
        return path, kind, a, b, h.get("warc-type"), urn(h.get("warc-record-id")), h.get("warc-target-uri"), None, digest, len(payload), payload if payloads else None

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches):
        fs, _ = _folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out, held = [], 0
                for found in salvage(data):
                    out.append(row(path, *found))
                    held += len(found[4]) if payloads else 0
                    if len(out) >= 5000 or held > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return manifest.select("path").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000, id_col: str = "page_id") -> DataFrame:
    """One row per record read back: id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages, least, id_col), folder)
    got = read_archives(manifest, folder, payloads=False).filter("kind = 'record'")
    kind = pages.schema[id_col].dataType
    return got.select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

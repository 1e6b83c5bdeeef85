"""WARC archives: a writer with revisit records and a reader that salvages what damage has left.

Archives are ordinary .warc.gz files below a shared folder, one gzip member per record. A task writes files of names of
its own and returns them; only files named in the returned table count, so a task that runs twice does no harm.

The reader checks every member (gzip's checksum) and record (version line, header, length, digests). After a failed
check it searches for the next gzip member or version line from which a record can be read, goes on there, and logs the
bytes between as a quarantined gap.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, scratch_path

#: A new archive is begun past so many bytes.
ROLL = 256 << 20
READ = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def plain_uri(uri: str) -> str:
    """``uri`` by the name that Arrow's file systems know: Hadoop has names of its own for some stores."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return uri
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme == "dbfs":
        # Mounted below /dbfs on every node.
        return "file:///dbfs/" + rest.lstrip("/")
    if scheme == "file" and not rest.startswith("//"):
        return f"file://{rest}"
    return uri


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(plain_uri(uri))


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record; ``refers_to`` names the response's page for a revisit, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    own = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{own}{':revisit' * revisit}>",
             f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        part = TaskContext.get().partitionId()
        written, out, path, count = [], None, None, 0
        for batch in batches:
            for page_id, url, html, size, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{top}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, count = store.open_output_stream(path, compression=None), 0
                payload = b"" if revisit else (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(page_id, url, payload, size, digest, ("" if refers_to is None else str(refers_to)) if revisit else None)
                out.write(packer.compress(data) + packer.flush())
                count += 1
                if out.tell() >= ROLL:
                    written.append((path, out.tell(), count))
                    out.close()
                    out = None
        if out is not None:
            written.append((path, out.tell(), count))
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[0] for w in written], pa.string()), pa.array([w[1] for w in written], pa.int64()),
             pa.array([w[2] for w in written], pa.int64())], names=["path", "bytes", "records"])

    return run


#: Copies of one row that are listed at a time.
COPIES = 10_000


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, size, digest, refers_to, revisit): of rows with equal payloads that with the smallest page_id is
    the response (a null page_id comes last; of rows alike in page_id that with the smallest url, a null one first), others
    are revisits to it.

    A payload goes through one exchange, merged before it; revisits are made of ids alone.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("digest"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    responses = rows.groupBy("digest").agg(F.first("html").alias("html"), F.first("size").alias("size"), least.alias("first")).select(
        F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "html", "size", "digest",
        F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    ids = rows.groupBy("digest", "page_id", "url", "size").agg(F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy("digest").agg(F.sum("n").alias("rows"), least.alias("first")).filter("rows > 1").select("digest", "first")
    others = ids.join(firsts, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    others = others.withColumn("n", F.col("n") - is_first.cast("long")).filter("n > 0")
    others = others.withColumn("begun", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    others = others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("begun"), F.lit(COPIES)))))
    revisits = others.select(
        "page_id", "url", F.lit("").alias("html"), "size", "digest", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    return responses.union(revisits)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the archives: (path, bytes, records).

    ``folder`` is a URI that every executor can write; by default one below the session's shared folder. A null html is
    an empty payload; null page_id and url are left out of the record; payloads may have any size; other columns are
    ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    store, top = _store(folder)
    store.create_dir(top)
    prefix = folder[: len(folder) - len(top)] if folder.endswith(top) else ""
    written = with_roles(pages).mapInArrow(_writer(folder), "path string, bytes long, records long")
    return cut(written.withColumn("path", F.concat(F.lit(prefix), "path")), "archives-written")


class _File:
    """Bytes of a file by position, a window at a time."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, start: int, count: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(min(count, max(0, self.size - start)))


def _member(file: _File, start: int) -> tuple[bytes, int] | None:
    """The data and end of the gzip member at ``start``, if its checksum holds."""
    unpack, out, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        data = file.at(at, READ)
        if not data:
            return None
        try:
            out.append(unpack.decompress(data))
        except zlib.error:
            return None
        at += len(data)
    return b"".join(out), at - len(unpack.unused_data)


def _parse(data: bytes, start: int) -> tuple[dict, int] | str:
    """The record at ``start`` and its end, or what is wrong with it."""
    version = _VERSION.match(data, start)
    if not version:
        return "no version line"
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        return "header without end"
    head = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        return "no length"
    body, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "length does not lead to the record's end"
    block = data[body:end]
    if head.get("warc-block-digest", "sha1:").startswith("sha1:") and head.get("warc-block-digest", f"sha1:{_sha1(block)}") != f"sha1:{_sha1(block)}":
        return "block digest differs"
    http, blank, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type", "")
    if kind == "response" and not blank:
        return "no payload"
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and said and said != _sha1(payload):
        return "payload digest differs"
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    return {
        "record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"), "payload_digest": said or _sha1(payload),
        "payload_bytes": len(payload) if kind != "revisit" else int(length[1]) if length else None, "payload": payload}, end + 4


def _in_data(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or fault) of a run of records."""
    at, lost, why = 0, None, ""
    while at < len(data):
        found = _parse(data, at)
        if isinstance(found, str):
            if lost is None:
                lost, why = at, found
            following = _VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        yield at, found[1], found[0]
        at = found[1]
    if lost is not None:
        yield lost, len(data), why


def _plain_record(file: _File, start: int) -> tuple[dict, int] | str:
    """The uncompressed record at ``start``, read as far as its header says."""
    size = READ
    while True:
        data = file.at(start, size)
        found = _parse(data, 0)
        if not isinstance(found, str) or len(data) < size:
            return found
        stop = data.find(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", data[: stop + 2]) if stop >= 0 else None
        need = stop + 8 + int(length[1]) if length else 0
        if need <= size:
            return found
        size = need


def salvage(file: _File) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or fault) over a whole archive, compressed by member or not at all; positions are in the file."""
    at, lost, why = 0, None, ""
    while at < file.size:
        found: list[tuple[int, int, dict | str]] = []
        fault = "no member or version line"
        sign = file.at(at, 10)
        if sign.startswith(b"\x1f\x8b\x08"):
            member = _member(file, at)
            fault = "member fails its checksum"
            if member is not None:
                inner = list(_in_data(member[0]))
                if any(isinstance(x, dict) for _, _, x in inner):
                    found = [(at, member[1], x) for _, _, x in inner]
                else:
                    fault = inner[0][2] if inner else "empty member"
        elif _VERSION.match(sign):
            parsed = _plain_record(file, at)
            if isinstance(parsed, str):
                fault = parsed
            else:
                found = [(at, at + parsed[1], parsed[0])]
        if found:
            if lost is not None:
                yield lost, at, why
                lost = None
            yield from found
            at = found[-1][1]
            continue
        if lost is None:
            lost, why = at, fault
        at = _next_start(file, at + 1)
    if lost is not None:
        yield lost, file.size, why


def _next_start(file: _File, at: int) -> int:
    while at < file.size:
        data = file.at(at, READ)
        sign = _START.search(data)
        if sign:
            return at + sign.start()
        at += max(1, len(data) - 9) if at + len(data) < file.size else len(data)
    return file.size


_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * 5, pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["path", "start_at", "end_at", "fault", *_COLUMNS])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = _store(path)
                rows, held = [], 0
                with store.open_input_file(inside) as handle:
                    for start, end, found in salvage(_File(handle, handle.size())):
                        if isinstance(found, str):
                            rows.append((path, start, end, found, *[None] * len(_COLUMNS)))
                        else:
                            found = found if payloads else {**found, "payload": None}
                            held += len(found["payload"] or b"")
                            rows.append((path, start, end, None, *(found[c] for c in _COLUMNS)))
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of all archives named in ``archives`` (path): records, and quarantined gaps where ``fault`` says why.

    Columns: path, start_at, end_at (bytes in the file), fault, record_type, record_id, target_uri, refers_to,
    payload_digest, payload_bytes (of the full payload, for a revisit as its response's header says), payload (null
    unless ``payloads``). An empty archive gives no rows; no archives, none either.
    """
    files = archives.select("path")
    schema = ("path string, start_at long, end_at long, fault string, record_type string, record_id string, target_uri string,"
              " refers_to string, payload_digest string, payload_bytes long, payload binary")
    return files.repartition(max(1, files.count())).mapInArrow(_reader(payloads), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, one row per record."""
    records = read_archives(write_archives(pages), payloads=False).filter("fault IS NULL")

    def page(column: str) -> F.Column:
        number = F.regexp_extract(column, r"^<urn:page:(-?\d*)", 1)
        return F.when(number != "", number.cast("long"))

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"))

"""Web archives: ARC files of both versions, their conversion to WARC, and reading WARC files back.

All files are written and read by Spark.  Records are rows of the text writer: a row's own last line feed is the
writer's, so the files are plain archives.  A row holds records up to about ``CHUNK`` characters (one record, if
that is longer), and the writer begins a new file after ``ROWS`` rows; so files are bounded by their size, however
large pages are.  Every file opens with its description record.

``convert`` parses ARC header lines by the version that the file declares, takes the declared number of bytes,
and makes up what WARC wants and ARC lacks: record ids from the place of a record in its archive, ISO dates,
record types and digests.  Of records with equal payloads of ``REVISIT_BYTES`` and more the one with the smallest
page id stays a response, the others become revisits of it.  Only (digest, id, date) rows are grouped for that;
payloads never leave the task that reads them when the repeated digests fit a checked broadcast, else they are
joined by shuffle.

Defined cases: null html is an empty payload; a null page id has no id header and comes after all ids; a null url
is "about:blank", and white space and control characters in urls are percent-encoded; rows repeated with the same
id and payload are a response and its revisits; empty tables give empty tables; other columns are ignored.  A
payload that isn't UTF-8 is kept as base64 with a header that says so, and read back as it was.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolens.session import work_path

ROWS = 16  # of a file: about 64 MB unpacked
REVISIT_BYTES = 100
BROADCAST_ROWS = 500_000
CHUNK = 4 << 20

_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_START = datetime(2001, 1, 1, tzinfo=timezone.utc)
#: Schemes whose records hold no HTTP response.
_OTHER = {"dns", "ftp", "whois", "gopher", "nntp", "mailto", "metadata"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank") or "about:blank"


def _text_batches(rows: Iterator[str], name: str = "value") -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size > CHUNK:
            yield pa.record_batch([pa.array(held, pa.string())], [name])
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(held, pa.string())], [name])


def _rows(items: Iterable, opening: Callable[[int], str], record: Callable[[object, int], str], rows: int, chunk: int) -> Iterator[str]:
    """Records of ``items`` joined to rows of about ``chunk`` characters; each ``rows``-th row opens a file."""
    row, held, size = 0, [], 0
    for item in items:
        if not held and row % rows == 0:
            held.append(opening(row // rows))
        held.append(record(item, row // rows))
        size += len(held[-1])
        if size > chunk:
            yield "\n".join(held)
            row, held, size = row + 1, [], 0
    if held:
        yield "\n".join(held)


def _write(rows: DataFrame, path: str) -> str:
    rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", ROWS).text(path)
    return path


# ---- ARC ------------------------------------------------------------------------


def arc_rows(pages: DataFrame, agent: str = "pages", address: str = "0.0.0.0") -> DataFrame:
    """Rows of ARC files, each file with its description; tasks take turns with versions 1 and 2."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def tail(file: int) -> str:
            return "" if version == 1 else f" 200 - - 0 part-{part}-{file}.arc"

        def opening(file: int) -> str:
            about = f"{version} 0 {agent}\n{_V1 if version == 1 else _V2}\n"
            line = f"filedesc://part-{part}-{file}.arc {address} {_START:%Y%m%d%H%M%S} text/plain{tail(file)}"
            return f"{line} {len(about)}\n{about}"

        def record(page: tuple, file: int) -> str:
            page_id, url, html = page
            body = html or ""
            size = len(body.encode())
            who = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{who}Content-Length: {size}\r\n\r\n"
            when = _START + timedelta(seconds=(page_id or 0) % 10**9)
            return f"{_uri(url)} {address} {when:%Y%m%d%H%M%S} text/html{tail(file)} {len(doc) + size}\n{doc}{body}"

        items = (
            page
            for batch in batches
            for start in range(0, batch.num_rows, 200)
            for page in zip(*(c.to_pylist() for c in batch.slice(start, 200).columns))
        )
        return _text_batches(_rows(items, opening, record, ROWS, CHUNK))

    return pages.select("page_id", "url", "html").mapInArrow(emit, "value string")


def write_arc(pages: DataFrame, path: str) -> str:
    return _write(arc_rows(pages), path)


def _open(content: bytes) -> io.BufferedReader:
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else io.BufferedReader(plain)


def _arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, body) of each record after the file description."""
    f, at, names = _open(content), 0, _V1.split()
    while line := f.readline():
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        said = line.decode("utf-8", "replace").rstrip("\r\n")
        if said.startswith("filedesc://"):
            body = f.read(int(said.rpartition(" ")[2]))
            at += len(body)
            version, names = body.split(b" ", 1)[0], body.decode().splitlines()[1].split()
            if names != (_V1 if version == b"1" else _V2).split():
                raise ValueError(f"ARC version {version!r} with fields {names}")
            continue
        fields = dict(zip(names, said.rsplit(" ", len(names) - 1)))
        if len(fields) != len(names):
            raise ValueError(f"not an ARC header line at {begin}: {said[:100]!r}")
        size = int(fields["Archive-length"])
        body = f.read(size)
        if len(body) != size:
            raise ValueError(f"the archive ends within the record at {begin}")
        at += size
        yield begin, fields, body


def _http(body: bytes) -> tuple[bytes, bytes]:
    """Head and payload; a body that doesn't begin as HTTP does is all payload."""
    head, gap, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
    return (head + gap, payload) if gap else (b"", body)


def _full_date(said: str) -> str:
    """Fourteen digits; what a short date leaves out is the first of its kind."""
    return said[:14] + "00000101000000"[len(said) :]


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"^X-Page-Id: (-?\d+)\r?$", head, re.M)
    return int(m[1]) if m else None


_PARSED = "record_id string, page_id long, uri string, date string, kind string, digest string, bytes long"


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """What WARC needs to know of each ARC record, with head and payload if asked for."""
    schema = _PARSED + ", head binary, payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * (2 * payloads)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py().rpartition("/")[2]
                for begin, fields, body in _arc_records(batch.column(1)[k].as_py()):
                    web = fields["URL"].lower().partition(":")[0] not in _OTHER
                    head, payload = _http(body) if web else (b"", body)
                    when = datetime.strptime(_full_date(fields["Archive-date"]), "%Y%m%d%H%M%S")
                    row = (f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{begin}')}>", _page_id(head), fields["URL"], f"{when:%Y-%m-%dT%H:%M:%SZ}")
                    row += ("response" if web else "resource", hashlib.sha256(payload).hexdigest(), len(payload))
                    held.append(row + ((head, payload) if payloads else ()))
                    size += len(body) if payloads else 300
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, schema)


# ---- WARC -----------------------------------------------------------------------


def originals(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, first): of each repeated payload, the record that the others revisit."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "date"))
    groups = records.filter(F.col("bytes") >= least).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").select("digest", "first")


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    said = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{said}\r\n{block.decode()}\r\n\r"  # and the writer's line feed


def warc_rows(records: DataFrame) -> DataFrame:
    """Rows of WARC files from parsed records with a column ``first`` (null for those that nothing repeats)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def opening(file: int) -> str:
            headers = [("WARC-Type", "warcinfo"), ("WARC-Date", f"{_START:%Y-%m-%dT%H:%M:%SZ}"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")]
            headers += [("WARC-Filename", f"part-{part}-{file}.warc"), ("Content-Type", "application/warc-fields")]
            return _record(headers, b"format: WARC File Format 1.1\r\n")

        def record(r: dict, _: int) -> str:
            head, payload = r["head"], r["payload"]
            web = r["kind"] == "response"
            headers = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"])]
            headers += [("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http; msgtype=response" if web else "application/octet-stream")]
            first = r["first"]
            if first is not None and first["record_id"] != r["record_id"]:
                headers = [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"]), *headers]
                block = head
            else:
                headers.insert(0, ("WARC-Type", r["kind"]))
                try:
                    payload.decode()
                except UnicodeDecodeError:
                    payload = base64.b64encode(payload)
                    headers.append(("X-Payload-Encoding", "base64"))
                block = head + payload
            headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
            return _record(headers, block)

        items = (r for batch in batches for start in range(0, batch.num_rows, 100) for r in batch.slice(start, 100).to_pylist())
        return _text_batches(_rows(items, opening, record, ROWS, CHUNK))

    columns = ["record_id", "uri", "date", "kind", "digest", "head", "payload", F.struct("first.record_id", "first.uri", "first.date").alias("f"), F.col("first").isNull().alias("none")]
    plain = records.select(*columns).withColumn("first", F.when(~F.col("none"), F.col("f"))).drop("f", "none")
    return plain.mapInArrow(emit, "value string")


def convert(spark: SparkSession, arc: str, warc: str, least: int = REVISIT_BYTES) -> str:
    """Write the WARC files of a folder of ARC files."""
    repeated = originals(read_arc(spark, arc, payloads=False), least).persist()
    try:
        small = repeated.count() <= BROADCAST_ROWS
        records = read_arc(spark, arc)
        records = records.join(F.broadcast(repeated) if small else repeated, "digest", "left")
        return _write(warc_rows(records), warc)
    finally:
        repeated.unpersist()


def _warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    f = _open(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size or hashlib.sha256(block).hexdigest() != headers.get("warc-block-digest", "").removeprefix("sha256:") and "warc-block-digest" in headers:
            raise ValueError(f"damaged record {headers.get('warc-record-id')}")
        yield headers, block


_READ = "record_id string, page_id long, uri string, date string, record_type string, refers_to_id string, payload_digest string, payload_bytes long"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record but warcinfo; a response's payload is held against its digest."""
    schema = _READ + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.binary()] * payloads]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for h, block in _warc_records(content.as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, payload = _http(block) if h["content-type"].startswith("application/http") else (b"", block)
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "revisit":
                        declared = re.search(rb"^Content-Length: (\d+)\r?$", head, re.M)
                        length, payload = int(declared[1]) if declared else None, None
                    else:
                        if h.get("x-payload-encoding") == "base64":
                            payload = base64.b64decode(payload)
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
                    row = (h["warc-record-id"], _page_id(head), h["warc-target-uri"], h["warc-date"], h["warc-type"], h.get("warc-refers-to"), digest, length)
                    held.append(row + ((payload,) if payloads else ()))
                    size += 300 + len(block) * payloads
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, schema)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits resolved to the page they name."""
    targets = records.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    arc = write_arc(pages, work_path(spark, "arc"))
    return page_records(read_warc(spark, convert(spark, arc, work_path(spark, "warc"))))

"""Legacy archives converted to WARC: ARC records parsed by their declared lengths.

An ARC file starts with a version block that names its version and the fields of
its header lines: five in version 1, ten in version 2.  A record is such
a line, then as many bytes as its last field declares.  The converter turns every record into
a WARC record:

* identifier: ``urn:uuid`` of a hash of archive name and offset, so that reruns agree;
* date: the 14-digit date (shorter ones are filled up) in ISO form; one that is no date becomes the epoch;
* type: the version block becomes ``warcinfo``, an HTTP message ``response``, anything else ``resource``;
* digests: sha256 of the payload (the HTTP body) and of the block.

Of responses with equal payloads of at least :data:`LEAST_BYTES` bytes the first
stays and the others become ``revisit`` records that hold the HTTP head and refer to it.
First is the one with the least page key (an HTTP header; none comes last), then by date, archive and offset.

Archives are written by Spark's text writer with the record separator of the format, so
that lost tasks are written anew, one archive of about :data:`ARCHIVE_BYTES` bytes in a row and in a file
(gzip).  Archives are read whole by Spark's binary reader, one at a time in a task.  Payloads
stay in the archives: the search for equal payloads shuffles a few columns of each record, and the
decisions of an archive travel back to it as one list, bounded by its size.

Null html is an empty payload, a null URL ``unknown:``, a null key no header.  Characters that
a header line cannot hold are percent-encoded.  Payloads of any length are whole; one
above the archive size is alone in its archive.  Equal rows are records of their own.  A record that
declares more bytes than there are is cut there and marked ``WARC-Truncated``; bytes after a line that is no header
line are passed over up to the next that is.  Empty tables give archives without records, or none.  Other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .tables import join_on_hot_key, quoted, removed

#: Bytes of an archive, about, before compression.
ARCHIVE_BYTES = 32 << 20
#: Payloads below this are never revisits.
LEAST_BYTES = 100
#: Bytes of decisions that are broadcast; more of them are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of records that a task hands on at once.
_BATCH_BYTES = 4 << 20
KEY_HEADER = "X-Page-Id"

#: Header line fields of the two ARC versions (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Characters that stay as they are in the URL of a header line, beside letters and digits (fixed values).
_URL_SAFE = "%/:=&?~#+!$,;'@()*[]|-._"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


class ArcRecord(NamedTuple):
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    truncated: bool


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


# ---- ARC -------------------------------------------------------------------------------------

def arc_url(url: str | None) -> str:
    """The URL as a header line can hold it."""
    return quote(url, safe=_URL_SAFE) if url else "unknown:"


def http_message(body: bytes, key: int | None, mime: str = "text/html; charset=utf-8") -> bytes:
    """A minimal HTTP response."""
    own = b"" if key is None else f"{KEY_HEADER}: {key}\r\n".encode()
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(body)}\r\n".encode() + own + b"\r\n" + body


class ArcWriter:
    """Collects the records of one ARC file."""

    def __init__(self, name: str, version: int, date: str):
        about = f"{version} 0 quarry\n{ARC_FIELDS[version]}\n\n".encode()
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain"
        if version == 2:
            head += f" 200 - - 0 {name}"
        self._name, self._version = name, version
        self._parts = [f"{head} {len(about)}\n".encode(), about]
        self.size = sum(map(len, self._parts))

    def add(self, url: str, ip: str, date: str, mime: str, block: bytes) -> None:
        line = f"{url} {ip} {date} {mime}"
        if self._version == 2:
            line += f" 200 {hashlib.md5(block).hexdigest()} - {self.size} {self._name}"
        self._parts += [f"{line} {len(block)}\n".encode(), block, b"\n"]
        self.size += sum(map(len, self._parts[-3:]))

    def content(self) -> bytes:
        """The file without its last line end, which the text writer sets."""
        return b"".join(self._parts)[:-1]


def _header_line(data: bytes, at: int, width: int) -> tuple[list[str], int] | None:
    """Fields of the header line at ``at`` and the place after it; None if it is no header line."""
    end = data.find(b"\n", at)
    if end < 0:
        return None
    fields = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
    if len(fields) < width or not fields[-1].isascii() or not fields[-1].isdigit():
        return None
    # an unescaped blank can only be in the URL
    return [" ".join(fields[:len(fields) - width + 1]), *fields[len(fields) - width + 1:]], end + 1


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, the version block first."""
    at, width = 0, 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        if width:
            found = _header_line(data, at, width)
        else:  # the version block has the header line of its own version
            end = data.find(b"\n", at)
            version = data[end + 1:end + 2]
            width = len(ARC_FIELDS[2 if version == b"2" else 1].split())
            found = _header_line(data, at, width)
        if found is None:
            after = data.find(b"\n", at)
            if after < 0:
                return
            at = after + 1
            continue
        fields, start = found
        length = int(fields[-1])
        yield ArcRecord(at, fields[0], fields[1], fields[2], fields[3], data[start:start + length], start + length > len(data))
        at = start + length


# ---- WARC ------------------------------------------------------------------------------------

def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive}:{offset}'.encode()).digest()[:16], version=5)}>"


def iso_date(date: str) -> str:
    """``20200131235959`` -> ``2020-01-31T23:59:59Z``; shorter dates are filled up."""
    if not re.fullmatch(r"[0-9]{8}([0-9]{2}){0,3}", date):
        return _EPOCH
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and body of an HTTP message."""
    found = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if found is None else (block[:found.end()], block[found.end():])


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*([^\r\n]*)", head)
    return found.group(1).decode("latin-1").strip() if found else None


def _key_of(head: bytes) -> int | None:
    value = http_header(head, KEY_HEADER)
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it, which are the separator of the file."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def converted(record: ArcRecord, archive: str, refers: tuple[str, str, str] | None = None) -> bytes:
    """An ARC record as a WARC record; ``refers`` (identifier, URL, date of the first) makes it a revisit."""
    about = [("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", iso_date(record.date))]
    if record.url.startswith("filedesc:"):
        name = record.url.removeprefix("filedesc://")
        info = f"software: quarry\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
        return warc_bytes([("WARC-Type", "warcinfo"), *about, ("WARC-Filename", archive),
                           ("Content-Type", "application/warc-fields")], info)
    about.append(("WARC-Target-URI", record.url))
    if record.ip not in ("0.0.0.0", "-", ""):
        about.append(("WARC-IP-Address", record.ip))
    if record.truncated:
        about.append(("WARC-Truncated", "length"))
    if not record.block.startswith(b"HTTP/"):
        digest = f"sha256:{sha256_of(record.block)}"
        return warc_bytes([("WARC-Type", "resource"), *about, ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", digest),
                           ("Content-Type", record.mime)], record.block)
    head, body = http_parts(record.block)
    about.append(("WARC-Payload-Digest", f"sha256:{sha256_of(body)}"))
    kind, block = ("response", record.block) if refers is None else ("revisit", head)
    if refers is not None:
        about += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", refers[0]),
                  ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2])]
    about += [("WARC-Block-Digest", f"sha256:{sha256_of(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return warc_bytes([("WARC-Type", kind), *about], block)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file; header names in lower case."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = (line.partition(":") for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
        start = end + 4
        length = int(headers.get("content-length", "0"))
        yield WarcRecord(headers, data[start:start + length])
        at = data.find(b"WARC/", start + length)


# ---- Spark -----------------------------------------------------------------------------------

def write_archives(archives: DataFrame, folder: str, separator: str) -> None:
    """``value`` (the bytes of an archive without the last separator) as a gzip file each."""
    (archives.select(F.col("value").cast("string")).write.option("lineSep", separator).option("maxRecordsPerFile", 1)
     .option("compression", "gzip").text(folder))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of every archive of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), date: str = "20200101000000",
              key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages as ARC files; the archives of a task take the versions in turn."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        archive, made = None, 0
        for batch in batches:
            for i in range(len(batch)):
                of, where, body = (column[i].as_py() for column in batch.columns)
                if archive is None:
                    archive = ArcWriter(f"part-{part}-{made}.arc", versions[(part + made) % len(versions)], date)
                archive.add(arc_url(where), "0.0.0.0", date, "text/html", http_message(body or b"", of))
                if archive.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive.content()], pa.binary())], ["value"])
                    archive, made = None, made + 1
        if archive is not None:
            yield pa.RecordBatch.from_arrays([pa.array([archive.content()], pa.binary())], ["value"])

    rows = pages.select(quoted(key).cast("long").alias("key"), quoted(url).cast("string").alias("url"),
                        quoted(html).cast("string").cast("binary").alias("html"))
    write_archives(rows.mapInArrow(pack, "value binary"), folder, "\n")


ARC_SUMMARY = "path string, offset long, id string, uri string, date string, key long, size long, digest string"


def arc_responses(archives: DataFrame) -> DataFrame:
    """A narrow row for each HTTP response of ARC archives: what its WARC record will be called, and its payload's digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ARC_SUMMARY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                archive = _name(path.as_py())
                for r in parse_arc(_opened(content.as_py())):
                    if r.block.startswith(b"HTTP/"):
                        head, body = http_parts(r.block)
                        rows.append((path.as_py(), r.offset, record_id(archive, r.offset), r.url, iso_date(r.date), _key_of(head),
                                     len(body), sha256_of(body)))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return archives.mapInArrow(read, ARC_SUMMARY)


def revisits(responses: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``path, offset, id, refers`` (identifier, URL, date of the first) of responses whose payload another has first."""
    large = responses.where(F.col("size") >= least)
    order = F.struct(F.col("key").isNull(), F.col("key"), "date", "path", "offset")
    first = (large.groupBy("digest").agg(F.min_by(F.struct("id", "uri", "date"), order).alias("refers"), F.count("*").alias("__n"))
             .where("__n > 1").drop("__n"))
    return (join_on_hot_key(large.select("path", "offset", "id", "digest"), first, "digest")
            .where(F.col("id") != F.col("refers.id")).drop("digest"))


def convert(archives: DataFrame, folder: str, least: int = LEAST_BYTES) -> None:
    """ARC archives (``path, content``) as WARC archives in ``folder``, one for one."""
    found = cut_lineage(revisits(cut_lineage(arc_responses(archives)), least))
    size = found.agg(F.coalesce(F.sum(F.length("path") + F.length("refers.uri") + 120), F.lit(0))).first()[0]
    decided = found.groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("refer"))
    joined = archives.join(F.broadcast(decided) if size <= BROADCAST_BYTES else decided, "path", "left")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, refer in zip(*(batch.column(c) for c in ("path", "content", "refer")), strict=True):
                archive = _name(path.as_py())
                of = {x["offset"]: tuple(x["refers"].values()) for x in refer.as_py() or []}
                whole = b"\r\n\r\n".join(converted(r, archive, of.get(r.offset)) for r in parse_arc(_opened(content.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["value"])

    write_archives(joined.select("path", "content", "refer").mapInArrow(turn, "value binary"), folder, "\r\n\r\n")


WARC_SUMMARY = ("type string, id string, date string, uri string, key long, payload_bytes long, payload_digest string, "
                "refers string, intact boolean")


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of WARC archives, ``warcinfo`` left out.

    ``payload_digest`` and ``payload_bytes`` are of the payload as read; a revisit, which
    has none, has the digest of its header and null bytes.  ``intact`` says whether header and payload agree.
    ``payload`` (binary) is added on request.
    """
    names = [x.split()[0] for x in WARC_SUMMARY.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for r in parse_warc(_opened(content.as_py())):
                    h = r.headers
                    kind = h.get("warc-type", "")
                    if kind == "warcinfo":
                        continue
                    http = h.get("content-type", "").startswith("application/http")
                    head, payload = http_parts(r.block) if http else (b"", r.block)
                    told = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    own = told if kind == "revisit" else sha256_of(payload)
                    row = (kind, h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), _key_of(head),
                           None if kind == "revisit" else len(payload), own, h.get("warc-refers-to"), own == told)
                    rows.append((*row, payload) if with_payload else row)
                    held += 300 + len(payload) * with_payload
                    if held >= _BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return archives.mapInArrow(read, WARC_SUMMARY + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to``: revisits have the bytes and key of the record they refer to."""
    whole = records.where(F.col("type") != "revisit")
    again = records.where(F.col("type") == "revisit").select("key", "payload_digest", "refers")
    target = whole.select(F.col("id").alias("refers"), F.col("key").alias("refers_to"), "payload_bytes")
    later = join_on_hot_key(again, target, "refers").withColumn("record_type", F.lit("revisit"))
    first = whole.withColumn("record_type", F.col("type")).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(columns).unionByName(later.select(columns))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Pages through legacy archives into WARC archives and back: a row per page, see :func:`resolved`, with the key named ``key``.

    The WARC archives stay in ``folder`` if one is given.
    """
    spark = pages.sparkSession
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    with removed(spark, scratch):
        write_arc(pages, f"{scratch}/arc", key=key, url=url, html=html)
        target = folder or f"{scratch}/warc"
        convert(read_archives(spark, f"{scratch}/arc"), target, least)
        records = cut_lineage(read_warc(read_archives(spark, target)))
    return resolved(records).withColumnRenamed("key", key)

"""Legacy ARC archives to WARC, with revisit records for repeated payloads."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grievaline.llm.common import travels
from grievaline.sources.workdir import new_dir

travels(__name__)

LEAST_REVISIT = 100
# The URL-record fields that each version of the ARC format declares.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)

MEMBER_BYTES = 15 << 20
LEVEL = 4

THIN = (
    "file string, number long, record_id string, page_id long, url string, captured string, payload_bytes long, "
    "payload_digest string, is_http boolean"
)
CAPTURES = THIN + ", ip string, mime string, version string, truncated boolean, head binary, payload binary"
RECORDS = (
    "page_id long, record_id string, record_type string, url string, captured string, "
    "payload_bytes long, payload_digest string, refers_to long, refers_to_record string"
)
WHOLE_RECORDS = RECORDS + ", head binary, payload binary"


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of ``pages (page_id, url, html)``, one per task, of both versions in turn.

    A file begins with its version block; a record is the header line of its version,
    the declared number of bytes and a line break. The HTTP response carries the page's
    id. A null html is an empty payload, a null url a fixed URN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        version = "12"[task % 2]
        name = f"pages-{task:06d}.arc"
        offset = 0

        def record(url: str, ip: str, date: str, mime: str, body: bytes) -> bytes:
            nonlocal offset
            middle = f" 200 - - {offset} {name}" if version == "2" else ""
            line = f"{url} {ip} {date} {mime}{middle} {len(body)}\n".encode() + body
            offset += len(line) + 1
            return line

        about = f"{version} 0 grievaline\n{ARC_FIELDS[version]}\n".encode()
        out = [record(f"filedesc://{name}", "0.0.0.0", EPOCH.strftime("%Y%m%d%H%M%S"), "text/plain", about)]
        for batch in batches:
            html = batch.column(2).cast(pa.binary())
            for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html):
                payload = body.as_py() or b""
                date = EPOCH + timedelta(seconds=(page or 0) % (1 << 28))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n"
                where = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:none"
                out.append(record(where, "0.0.0.0", date.strftime("%Y%m%d%H%M%S"), "text/html", head.encode() + payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (
        pages.select("page_id", "url", "html")
        .mapInArrow(run, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\n")
        .option("compression", "gzip")
        .text(path)
    )


def arc_records(stream, whole: bool = True) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``version, header fields, body`` of an ARC stream, its version block left out.

    The block's second line names the fields of every header line. A URL may hold
    blanks, so fields are cut from the right. Bodies have exactly the declared length; a
    stream that ends before is an error, or, if it need not be ``whole``, its last body
    is what is there.
    """
    first = stream.readline()
    if not first:  # an empty task leaves an empty file
        return
    about = stream.read(int(first.split()[-1])).decode("utf-8", "replace").splitlines()
    version, names = about[0].split()[0], about[1].split()
    if ARC_FIELDS.get(version, "").split() != names:
        raise ValueError(f"ARC version {version!r} does not declare {names}")
    while line := stream.readline():
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if not whole and (len(fields) != len(names) or not line.endswith(b"\n")):
            return  # the stream ends inside a header line
        if len(fields) != len(names):
            raise ValueError(f"ARC header line has {len(fields)} fields, not {len(names)}")
        header = dict(zip(names, fields))
        length = int(header["Archive-length"])
        body = stream.read(length)
        if len(body) != length and whole:
            raise ValueError(f"ARC record ends after {len(body)} of {length} bytes")
        yield version, header, body


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line behind it, and payload; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [block.find(e) + len(e) for e in (b"\r\n\r\n", b"\n\n") if e in block]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def http_field(head: bytes, name: str) -> str:
    for line in head.splitlines()[1:]:
        key, _, value = line.decode("latin-1").partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return ""


def record_id(file: str, number: int) -> str:
    """A WARC record identifier that the place of a capture in its file fixes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{file}:{number}')}>"


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Captures of all ARC files below ``path``; a file is read record by record.

    Without ``payloads`` a row has what decides on revisits, and is short.
    """
    kind = CAPTURES if payloads else THIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _files(batches):
            for rows in _chunks(_captures(name, content, payloads)):
                yield _batch(rows, kind)

    return _archives(spark, path).mapInArrow(run, kind)


def _captures(file: str, stream, payloads: bool) -> Iterator[tuple]:
    for number, (version, header, body) in enumerate(arc_records(stream, whole=False)):
        head, payload = http_parts(body)
        date = datetime.strptime(header["Archive-date"], "%Y%m%d%H%M%S")
        page = http_field(head, "x-page-id")
        thin = (
            file,
            number,
            record_id(file, number),
            int(page) if page.isdigit() or page[:1] == "-" and page[1:].isdigit() else None,
            header["URL"],
            date.strftime("%Y-%m-%dT%H:%M:%SZ"),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            bool(head),
        )
        short = len(body) < int(header["Archive-length"])
        yield (*thin, header["IP-address"], header["Content-type"], version, short, head, payload) if payloads else thin


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Path and content of each file; a compressed one that breaks off ends there."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_buffer()
            stream = io.BytesIO(raw)
            packed = bytes(raw[:2]) == b"\x1f\x8b"
            yield path, io.BufferedReader(Unpacked(stream)) if packed else stream


class Unpacked(io.RawIOBase):
    """The bytes of gzip members behind one another, up to where the file breaks off."""

    def __init__(self, packed: io.BytesIO):
        self.source = gzip.GzipFile(fileobj=packed)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        try:
            data = self.source.read1(len(into))
        except EOFError:
            return 0
        into[: len(data)] = data
        return len(data)


def _chunks(rows: Iterator[tuple], most: int = 512, size: int = 16 << 20) -> Iterator[list[tuple]]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most or total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])


def revisits(thin: DataFrame) -> DataFrame:
    """``file, number, first``: which captures revisit, and the capture that they refer to.

    Of equal payloads of at least 100 bytes the one with the smallest page id is the
    response and the others are revisits; shorter ones and captures without an HTTP head
    are all kept whole. Captures that share that smallest id are all responses; a null id
    is never the smallest, and payloads with null ids only are responses.
    """
    long = thin.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("is_http"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "captured"))
    repeated = (
        long.groupBy("payload_digest")
        .agg(F.min(known).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("payload_digest", "first")
    )
    return (
        long.join(repeated, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select("file", "number", "first")
    )


def warc_record(row: dict, first: dict | None) -> bytes:
    """One WARC record as a gzip member, so that a reader can begin at it.

    A capture with an HTTP head keeps it as it was, status line and fields; without one
    it is a resource record of the capture's own type.
    """
    kind = "revisit" if first else "response" if row["is_http"] else "resource"
    block = row["head"] + (b"" if first else row["payload"])
    page = "" if row["page_id"] is None else str(row["page_id"])
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["captured"]),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Truncated", "disconnect" if row["truncated"] else None),
        ("X-Payload-Length", str(row["payload_bytes"])),
        ("X-Page-Id", page),
        ("WARC-Profile", PROFILE if first else None),
        ("WARC-Refers-To", first and first["record_id"]),
        ("WARC-Refers-To-Target-URI", first and first["url"]),
        ("WARC-Refers-To-Date", first and first["captured"]),
        ("X-Refers-To-Page-Id", first and str(first["page_id"])),
        ("Content-Type", "application/http; msgtype=response" if row["is_http"] else row["mime"]),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None)
    return packed(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n")


def packed(record: bytes) -> bytes:
    """Gzip members of a record, one unless it is very long.

    A member ends with the length of its content, little-endian, so below 16 MiB its last
    byte is zero.
    """
    pieces = [record[i : i + MEMBER_BYTES] for i in range(0, len(record), MEMBER_BYTES)]
    return b"".join(gzip.compress(p, LEVEL, mtime=0) for p in pieces)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files to WARC files of gzip members.

    What revisits what is decided on short rows. A file, packed as it is, meets the
    decisions on its own captures and is converted record by record; payloads are not
    shuffled, and one that very many captures share is no hot key. The text writer ends
    every row with the last byte of its member, a zero.
    """
    decided = (
        revisits(read_arc(spark, arc_path, payloads=False))
        .groupBy("file")
        .agg(F.collect_list(F.struct("number", "first")).alias("revisits"))  # no more than its records
    )
    files = _archives(spark, arc_path).withColumnRenamed("path", "file").join(decided, "file", "left")
    names = [f.split()[0] for f in CAPTURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, content) in enumerate(_files([batch.select(["file", "content"])])):
                first = {r["number"]: r["first"] for r in batch.column("revisits")[i].as_py() or []}
                out, size = [], 0
                for row in _captures(name, content, True):
                    out.append(warc_record(dict(zip(names, row)), first.get(row[1]))[:-1])
                    size += len(out[-1])
                    if size >= MEMBER_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (
        files.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\0")
        .text(warc_path)
    )


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``headers, block`` of a WARC stream; blocks have exactly the declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"WARC record ends after {len(block)} of {length} bytes")
        yield headers, block


def _records(stream, payloads: bool) -> Iterator[tuple]:
    for headers, block in warc_records(stream):
        kind = headers["warc-type"]
        head, payload = http_parts(block) if headers["content-type"].startswith("application/http") else (b"", block)
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        whole = kind != "revisit"
        if whole and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
        page, refers = headers.get("x-page-id", ""), headers.get("x-refers-to-page-id", "")
        row = (
            int(page) if page else None,
            headers["warc-record-id"],
            kind,
            headers["warc-target-uri"],
            headers["warc-date"],
            len(payload) if whole else int(headers["x-payload-length"]),
            digest,
            int(refers) if refers else None,
            headers.get("warc-refers-to"),
        )
        yield (*row, head, payload if whole else None) if payloads else row


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all WARC files below ``path``; payloads are checked against their digest.

    Without ``payloads`` they are checked all the same, but do not leave the task.
    """
    kind = WHOLE_RECORDS if payloads else RECORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, content in _files(batches):
            for rows in _chunks(_records(content, payloads)):
                yield _batch(rows, kind)

    return _archives(spark, path).mapInArrow(run, kind)


def archive(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold, with or without ``payloads``.

    Null html is an empty payload, repeated rows are records of their own, an empty
    table gives no rows, other columns are left out.
    """
    spark = pages.sparkSession
    arc, warc = new_dir(spark, "arc"), new_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc, payloads)

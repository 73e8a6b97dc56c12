"""WARC archives: writing with revisit records, and a reader that salvages what it can.

Writing: a payload that several pages share is stored once, with the largest page_id; the others become revisits that
refer to it. Digests meet by value, combined on the map side. Each task fills archives of about ARCHIVE bytes, one
gzip member a record, under names of its own attempt, and reports them; the table of reports says which archives count.

Reading: every record is checked (gzip CRC, version line, lengths, payload digest). After a failed check the reader
looks for the next place at which a member or a version line begins that starts a valid record, goes on there and logs
the bytes between as a gap.

Defined cases: NULL html is an empty payload; a NULL url has no target; a NULL page_id is written without an id, is
never a revisit and reads back as NULL; rows that repeat the largest page_id of a payload are all responses; an empty
table makes no archive; extra columns are dropped; payloads may have any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percussa.llm.common import file_system, scratch, stored, write_file

ARCHIVE = 8 << 20
READ = 1 << 18
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("archive string, offset long, length long, problem string, page_id long, record_type string, refers_to long, "
           "url string, payload_digest string, payload_bytes long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, a response or a revisit of page `refers_to`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [VERSION.decode() + "1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
                   compress: bool = True) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives in the shared folder; returns archive, records, bytes."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    named = pages.withColumn("digest", F.sha1("html"))
    shared = (named.where((F.length("html") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder"))
    told = named.join(shared, "digest", "left").select("page_id", "url", "html", F.when(
        (F.col("page_id") != F.col("holder")) & (F.length("html") >= least_bytes), F.col("holder")).alias("refers_to"))

    def write(batches):
        held, size, count = [], 0, 0

        def flush():
            name = write_file(folder, "part", b"".join(held))
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})
            held.clear()
            return row

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                made = record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), date)
                held.append(member(made) if compress else made)
                size += len(held[-1])
                count += 1
                if size >= ARCHIVE:
                    yield flush()
                    size = count = 0
        if held:
            yield flush()

    return stored(told.mapInArrow(write, "archive string, records long, bytes long"), "archives")


class Source:
    """Bytes of a file at any place, read in pieces."""

    def __init__(self, handle):
        self.handle, self.size = handle, handle.size()
        self.begin, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not (self.begin <= offset and offset + n <= self.begin + len(self.held)):
            self.handle.seek(offset)
            self.begin, self.held = offset, self.handle.read(max(n, READ))
        return self.held[offset - self.begin:offset - self.begin + n]

    def find(self, needles: tuple[bytes, ...], offset: int) -> int:
        """The next place of any needle from `offset` on, or the end."""
        reach = max(map(len, needles)) - 1
        while offset < self.size:
            part = self.at(offset, min(READ, self.size - offset))
            hits = [k for k in (part.find(x) for x in needles) if k >= 0]
            if hits:
                return offset + min(hits)
            offset += max(1, len(part) - reach)
        return self.size


def _member_at(source: Source, offset: int) -> tuple[bytes, int]:
    """The content of the gzip member at `offset` and where it ends; ValueError if it is damaged."""
    unpack, out, at = zlib.decompressobj(31), [], offset
    while not unpack.eof:
        part = source.at(at, min(READ, source.size - at))
        if not part:
            raise ValueError("member is cut off")
        try:
            out.append(unpack.decompress(part))
        except zlib.error as e:
            raise ValueError("damaged member") from e
        if not b"".join(out[:1]).startswith(VERSION[:len(out[0])]):
            raise ValueError("member holds no record")
        at += len(part) - len(unpack.unused_data)
    return b"".join(out), at


def _plain_at(source: Source, offset: int) -> tuple[bytes, int]:
    """An uncompressed record at `offset` and where it ends."""
    end = source.find((b"\r\n\r\n",), offset)
    head = source.at(offset, min(end + 4, source.size) - offset)
    size = re.search(rb"\r\nContent-Length: *(\d+)\r\n", head)
    if not head.startswith(VERSION) or size is None:
        raise ValueError("no record")
    last = offset + len(head) + int(size[1]) + 4
    if last > source.size:
        raise ValueError("record is cut off")
    return source.at(offset, last - offset), last


def parse(data: bytes) -> dict:
    """Fields of one whole record; ValueError says which check failed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("damaged header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("length differs")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    told = re.search(rb"\r\nContent-Length: *(\d+)", http)
    if kind == "response" and digest != base32_sha1(payload):
        raise ValueError("payload digest differs")

    def number(field: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(field, ""))
        return int(m[1]) if m else None

    return {"page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"),
            "url": fields.get("warc-target-uri"), "payload_digest": digest,
            "payload_bytes": len(payload) if kind == "response" else int(told[1]) if told else None,
            "payload": payload if kind == "response" else None}


def salvage(handle):
    """Yields (offset, length, problem, fields) of every valid record and of every gap (fields None) of an archive."""
    source = Source(handle)
    offset, bad, why = 0, None, ""
    while offset < source.size:
        try:
            data, end = (_member_at if source.at(offset, 3) == MEMBER else _plain_at)(source, offset)
            found = parse(data)
        except ValueError as e:
            if bad is None:
                bad, why = offset, str(e)
            offset = source.find((MEMBER, VERSION), offset + 1)
            continue
        if bad is not None:
            yield bad, offset - bad, why, None
            bad = None
        yield offset, end - offset, None, found
        offset = end
    if bad is not None:
        yield bad, source.size - bad, why, None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives (column `archive`), and a row with `problem` for each gap of quarantined bytes."""
    schema = ["archive", "offset", "length", "problem", "page_id", "record_type", "refers_to", "url", "payload_digest",
              "payload_bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.string(), pa.int64(), pa.binary()]
    form = pa.schema(list(zip(schema, types)))

    def read(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                where, path = file_system(name)
                rows, size = [], 0
                with where.open_input_file(path) as handle:
                    for offset, length, problem, found in salvage(handle):
                        row = {"archive": name, "offset": offset, "length": length, "problem": problem, **(found or {})}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += length
                        if size >= ARCHIVE:
                            yield pa.RecordBatch.from_pylist(rows, form)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, form)

    # The reports lie in few files; each archive is one row, dealt out so that all tasks get some.
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(read, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, scratch(spark, "warc"), least_bytes), payloads)

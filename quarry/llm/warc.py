"""Web archives: legacy ARC files and their conversion to WARC.

An ARC file opens with a version block that names the fields of all header lines in it; each record is one such line and
as many bytes as it declares. The converter reads the lines of either version and gives equivalent WARC records: a type
from the URL and the content, an ISO timestamp from the 14 digits, an identifier and digests from the bytes. Records
whose payload was archived before become revisits. Spark's own writers and readers move the archives, so they may lie in
any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._base import checkpoint_dir, slices, written

#: Field names of header lines, by the version number in the version block (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SPACED = {ord(c): f"%{ord(c):02X}" for c in map(chr, [*range(33), 127])}
#: Bytes that are unpacked at once.
PIECE = 1 << 20
#: (bytes of a payload at most, records of one archive file): a file holds about 64 MB at most, or one record.
ROLLS = [(1 << 15, 2000), (1 << 20, 64), (1 << 62, 1)]


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    code: str = "-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n"
    return line.encode() + body


def arc_record(version: int, record: ArcRecord, name: str = "-") -> bytes:
    more = "" if version == 1 else f"{record.code} {hashlib.md5(record.block).hexdigest()} - 0 {name} "
    url = record.url.translate(SPACED) or "unknown:"
    return f"{url} {record.ip} {record.date} {record.content_type} {more}{len(record.block)}\n".encode() + record.block


class Stream:
    """Bytes of a gzip file of any number of members, one piece at a time; bytes that are not gzip are taken as they are."""

    def __init__(self, content: bytes):
        self.rest, self.inflate, self.held, self.at = memoryview(content), None, bytearray(), 0
        self.plain = content[:2] != b"\x1f\x8b"

    def more(self) -> bool:
        """Take in another piece; False at the end. ValueError for a member that is cut short."""
        if self.plain and not self.inflate:
            self.held += self.rest[:PIECE]
            got, self.rest = len(self.rest) > 0, self.rest[PIECE:]
            return got
        while True:
            if self.inflate is None:
                while len(self.rest) and self.rest[0] == 0:
                    self.rest = self.rest[1:]
                if not len(self.rest):
                    return False
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.decompress(self.inflate.unconsumed_tail or self._take(), PIECE)
            if self.inflate.eof:
                self.rest = memoryview(bytes(self.inflate.unused_data) + bytes(self.rest)) if self.inflate.unused_data else self.rest
                self.inflate = None
            elif not piece and not len(self.rest) and not self.inflate.unconsumed_tail:
                raise ValueError("a gzip member is cut short")
            if piece:
                self.held += piece
                return True

    def _take(self) -> bytes:
        piece, self.rest = bytes(self.rest[:PIECE]), self.rest[PIECE:]
        return piece

    def need(self, n: int) -> bool:
        """Hold at least n bytes from the current place on; False if there are fewer."""
        if self.at > PIECE:
            del self.held[: self.at]
            self.at = 0
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes up to a mark, which is passed over, or up to the end."""
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            start = max(self.at, len(self.held) - len(mark) + 1)
            if not self.more():
                out, self.at = bytes(self.held[self.at :]), len(self.held)
                return out
        out, self.at = bytes(self.held[self.at : end]), end + len(mark)
        return out

    def take(self, n: int) -> bytes | None:
        if not self.need(n):
            return None
        out, self.at = bytes(self.held[self.at : self.at + n]), self.at + n
        return out


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, plain or gzip (a member for each record, or any other cut), by their declared lengths.

    The version block is no record. Blank lines between records are passed over; an empty file has no records. A header
    line with too few fields, or with a length that runs past the end, raises ValueError. One record is held at a time.
    """
    stream, version = Stream(data), 1
    while stream.need(1):
        line = stream.until(b"\n").decode("utf-8", "replace").strip()
        if not line:
            continue
        filedesc = line.startswith("filedesc:")
        if filedesc and stream.need(1):
            version = int(stream.held[stream.at : stream.at + 1])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        names = FIELDS[version].lower().split()
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"ARC header line {line[:200]!r}")
        field = dict(zip(names, parts, strict=True))
        block = stream.take(int(field["archive-length"]))
        if block is None:
            raise ValueError("an ARC record is cut short")
        if not filedesc:
            yield ArcRecord(field["url"], field["ip-address"], field["archive-date"], field["content-type"], block, field.get("result-code", "-"))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block that is no HTTP message is all payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.strip().lower() == name.lower():
            return v.strip()
    return None


def warc_headers(record: ArcRecord) -> dict[str, str]:
    """WARC headers equivalent to an ARC record's."""
    head, payload = split_http(record.block)
    d = record.date.ljust(14, "0")
    kind = "response" if head else "resource"
    digest, block_digest = sha1_base32(payload), sha1_base32(record.block)
    return {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {record.date} {block_digest}')}>",
        "WARC-Target-URI": record.url,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{block_digest}",
        "Content-Type": "application/http; msgtype=response" if head else record.content_type,
        "Content-Length": str(len(record.block)),
    }


def warc_bytes(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that follow it."""
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzip (see parse_arc), by the declared lengths; ValueError where they don't fit."""
    stream = Stream(data)
    while stream.need(1):
        if stream.need(2) and stream.held[stream.at : stream.at + 2] == b"\r\n":
            stream.at += 2
            continue
        lines = stream.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:200]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = stream.take(int(headers["Content-Length"]))
        if block is None:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """`path` and `content` of every archive file below path whose name fits the pattern, except those that Spark counts as hidden (`_`, `.`).

    A file is one value, so archives of 2 GB and more have to be split at their members before.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def rolls(longest: int) -> Iterator[tuple[int, int, int]]:
    """(more than, at most) payload bytes and records of a file, for the classes of records that occur."""
    low = -1
    for high, n in ROLLS:
        if longest > low:
            yield low, high, n
        low = high


def write_records(records: DataFrame, path: str, end: str, n: int) -> None:
    """One binary column, written by Spark's text writer as gzip files of at most n records, each record followed by `end`."""
    (records.toDF("b").select(F.col("b").cast("string")).write.option("lineSep", end).option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", n).text(f"{path}/files-of-{n}"))


def write_arc(df: DataFrame, path: str, version: int = 1, url: str = "url", html: str = "html", key: str = "page_id", date: str = "20240101000000") -> None:
    """Archive pages as gzip ARC files of one version.

    A null url is written as `unknown:`, a null html as an empty payload; the key (left out if null) and the payload's
    length stand in the HTTP head. Each record carries the version's line, and a version block precedes it, so that a file
    can open with any record. Pages of any length are fine, as files are rolled by bytes. Repeated rows are written each.
    Extra columns are left out; an empty table gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = arc_version_block(version, "pages.arc", date) + b"\n"
        for batch in slices(batches, 2, 4_000_000):
            out = []
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = h.encode("utf-8", "replace")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {k}\r\n" if k is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                out.append(opening + arc_record(version, ArcRecord(u, "0.0.0.0", date, "text/html", head.encode() + body, "200"), "pages.arc"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["b"])

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(url), F.lit("")).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    size = F.octet_length("h")
    for low, high, n in rolls(rows.agg(F.max(size)).first()[0] or 0):
        write_records(rows.where((size > low) & (size <= high)).mapInArrow(run, "b binary"), path, "\n", n)


def page_of(head: bytes) -> int | None:
    page = http_field(head, "X-Page-Id")
    return int(page) if page else None


def convert_arc(arcs: DataFrame) -> DataFrame:
    """One row for each record of ARC files (`path`, `content`): path, place, page_id, payload_bytes, payload_digest, record_id, uri, date.

    place numbers the records of a file; page_id is null for records that have none. Either version, told by each file's
    version block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for place, r in enumerate(parse_arc(content.as_py())):
                    head, payload = split_http(r.block)
                    h = warc_headers(r)
                    rows.append((path.as_py(), place, page_of(head), len(payload), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Record-ID"], r.url, h["WARC-Date"]))
                    if len(rows) == 2000:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "place", "page_id", "payload_bytes", "payload_digest", "record_id", "uri", "date"])

    return arcs.mapInArrow(run, "path string, place int, page_id long, payload_bytes long, payload_digest string, record_id string, uri string, date string")


def warc_record(record: ArcRecord, again: dict | None) -> bytes:
    """The WARC record of an ARC record; a revisit without payload if `again` names the record that it repeats."""
    h = warc_headers(record)
    block = record.block
    if again:
        block = split_http(record.block)[0]
        h |= {
            "WARC-Type": "revisit",
            "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            "WARC-Refers-To": again["record_id"],
            "WARC-Refers-To-Target-URI": again["uri"],
            "WARC-Refers-To-Date": again["date"],
            "X-Refers-To-Page": str(again["page_id"]),
            "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
            "Content-Length": str(len(block)),
        }
    return warc_bytes(h.items(), block)


def write_warc(spark: SparkSession, arc_path: str, path: str, least_bytes: int = 0) -> None:
    """Convert ARC files to gzip WARC files with revisits.

    Of records whose payloads of at least least_bytes are equal (by SHA-1 and length), the one with the smallest page_id is
    written in full; the others are revisits without payload that name it. Shorter ones are all written in full. Records
    without page_id are never referred to. Only narrow rows of keys are joined; their answers come to the archive files, so
    payloads are not shuffled, and a hot payload weighs no more than another.
    """
    arcs = files(spark, arc_path)
    keys = written(convert_arc(arcs), "arc-records")
    known = keys.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = known.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("page_id", "record_id", "uri", "date")).alias("f"), F.count("*").alias("n"))
    again = keys.join(first.where("n > 1"), ["payload_digest", "payload_bytes"]).where(F.coalesce(F.col("page_id") > F.col("f.page_id"), F.lit(True)))
    of_file = again.groupBy("path").agg(F.collect_list(F.struct("place", "f.*")).alias("again"))
    whole = arcs.join(of_file, "path", "left").select("content", "again")

    def run(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column(0), batch.column(1), strict=True):
                known = {a["place"]: a for a in found.as_py() or []}
                out, held = [], 0
                for place, r in enumerate(parse_arc(content.as_py())):
                    if low < len(split_http(r.block)[1]) <= high:
                        out.append(warc_record(r, known.get(place)))
                        held += len(out[-1])
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["b"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["b"])

    for low, high, n in rolls(keys.agg(F.max("payload_bytes")).first()[0] or 0):
        write_records(whole.mapInArrow(lambda batches, low=low, high=high: run(batches, low, high), "b binary"), path, "\r\n\r\n", n)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (gzip or plain): page_id, payload_bytes, payload_digest, record_type, refers_to, uri, record_id.

    payload_bytes is the declared HTTP length, so revisits have that of the full payload. A response whose payload does not
    have the digest and the length of its headers raises ValueError. Records are unpacked one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "record_id"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    head, payload = split_http(block)
                    size, refers = http_field(head, "Content-Length"), h.get("X-Refers-To-Page")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(size) if size else len(payload)
                    if h["WARC-Type"] != "revisit" and (n != len(payload) or sha1_base32(payload) != digest):
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload is not the one that was written")
                    rows.append((page_of(head), n, digest, h["WARC-Type"], int(refers) if refers else None, h["WARC-Target-URI"], h["WARC-Record-ID"]))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files(spark, path).select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, record_id string")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All pages archived as ARC, converted to WARC with revisits, and read back."""
    where = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{where}/arc")
    write_warc(spark, f"{where}/arc", f"{where}/warc")
    return read_warc(spark, f"{where}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Web archives in ZIP packages.

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` with one gzip member per record, and
``indexes/index.cdxj`` with the place of every record. The reader parses the
central directory (with ZIP64 where it is used), finds those members and reads
records by their byte ranges; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import partitions
from tidelex.llm.files import Written, opened, read_at, size_of
from tidelex.llm.graph import stored
from tidelex.llm.ship import shipped
from tidelex.session import scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that one range read may take in for neighbouring records.
READ = 4 << 20


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None, payload_digest: str) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:sha1:{payload_digest}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: the response, or for a revisit its HTTP head only."""
    known = digest(payload)
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page, known)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{known}"))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to, known))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind, told = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != told:
        raise ValueError(f"record {fields['warc-record-id']}: the payload does not have its digest")
    page = re.fullmatch(r"<urn:page:(-?\d+)>", fields["warc-record-id"])
    target = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {"page_id": int(page[1]) if page else None, "url": fields.get("warc-target-uri"),
            "payload_bytes": len(payload) if kind == "response" else int(found[1]), "payload_digest": told,
            "record_type": kind, "refers_to": int(target[1]) if target else None,
            "payload": payload if kind == "response" else None}


class PackageWriter:
    """Writes a package as a stream; the index follows the archive."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = press.compress(record(page, url, payload, refers_to)) + press.flush()
        self.archive.write(data)
        place = {"url": url, "digest": f"sha1:{digest(payload)}", "offset": self.at, "length": len(data), "filename": "data.warc.gz"}
        self.index.append(f"{re.sub(r'\s', '%20', url or '-')} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(place)}\n")
        self.at += len(data)

    def close(self) -> None:
        self.archive.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as member:
            for line in sorted(self.index):
                member.write(line.encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [
            {"name": p.rsplit("/", 1)[1], "path": p} for p in (ARCHIVE, INDEX)]}))
        self.zip.close()


@dataclass
class Member:
    name: str
    method: int
    header: int
    size: int


def directory(source, size: int) -> list[Member]:
    """Members of a ZIP file from its central directory; sizes and places beyond 32 bits come from ZIP64 fields."""
    tail_at = max(0, size - 65557)
    tail = read_at(source, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    place = tail_at + end
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        mark, _, at, _ = struct.unpack("<4sIQI", read_at(source, place - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        wide = read_at(source, at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 directory end is missing")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    data, at, members = read_at(source, start, length), 0, []
    for _ in range(count):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", data[at + 10:at + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[at + 20:at + 34])
        header, = struct.unpack("<I", data[at + 42:at + 46])
        name = data[at + 46:at + 46 + n_name].decode("utf-8")
        extra, e = data[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[e:e + 4])
            if tag == 1:
                values = iter(struct.unpack(f"<{n // 8}Q", extra[e + 4:e + 4 + n // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            e += 4 + n
        members.append(Member(name, method, header, packed))
        at += 46 + n_name + n_extra + n_note
    return members


def data_start(source, member: Member) -> int:
    """First byte of a stored member's data."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the package and cannot be read by ranges")
    head = read_at(source, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: no local header at its place")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n_name + n_extra


def _gzip_members(source, start: int, size: int):
    """Records of an archive without an index, one gzip member after another."""
    at, press, parts = 0, zlib.decompressobj(31), []
    rest = b""
    while at < size or rest:
        if not rest:
            rest = read_at(source, start + at, min(READ, size - at))
            at += len(rest)
        parts.append(press.decompress(rest))
        rest = press.unused_data
        if press.eof:
            yield b"".join(parts)
            press, parts = zlib.decompressobj(31), []


def records(uri: str):
    """All records of a package, in the order of the archive."""
    source = opened(uri)
    members = directory(source, size_of(uri))
    indexes = [m for m in members if re.fullmatch(r"indexes/.*\.cdxj?", m.name)]
    archives = {m.name.rsplit("/", 1)[1]: data_start(source, m) for m in members if re.fullmatch(r"archive/.*\.warc\.gz", m.name)}
    if not indexes:
        for m in members:
            if m.name.startswith("archive/"):
                yield from _gzip_members(source, data_start(source, m), m.size)
        source.close()
        return
    places = []
    for m in indexes:
        lines = io.TextIOWrapper(io.BytesIO(read_at(source, data_start(source, m), m.size)), "utf-8")
        for line in lines:
            place = json.loads(line[line.index("{"):])
            places.append((archives[place["filename"]] + int(place["offset"]), int(place["length"])))
    places.sort()
    i = 0
    while i < len(places):
        j = i + 1
        while j < len(places) and places[j][0] == places[j - 1][0] + places[j - 1][1] and places[j][0] + places[j][1] - places[i][0] <= READ:
            j += 1
        data = memoryview(read_at(source, places[i][0], places[j - 1][0] + places[j - 1][1] - places[i][0]))
        for at, length in places[i:j]:
            yield zlib.decompress(data[at - places[i][0]:at - places[i][0] + length], 31)
        i = j
    source.close()


def _write(batches, folder: str):
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    uri, out, package, n = f"{folder}/part-{part:06d}.wacz", None, None, 0
    try:
        for batch in batches:
            pages, urls, htmls, targets = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for i in range(batch.num_rows):
                if package is None:
                    out = Written(uri)
                    package = PackageWriter(_Stream(out))
                payload = htmls[i].as_buffer().to_pybytes() if htmls[i].is_valid else b""
                package.add(pages[i].as_py(), urls[i].as_py(), payload, targets[i].as_py())
                n += 1
        if package is not None:
            package.close()
    except BaseException as error:
        if out is not None:
            out.__exit__(type(error), error, None)
        raise
    if out is not None:
        out.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n], pa.int64())],
                                         ["part", "uri", "n_records"])


class _Stream:
    """The part of a file object that the ZIP writer needs; it cannot be moved back."""

    def __init__(self, out: Written):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


_PAGE = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _read(batches, with_payload: bool):
    names = [f.split()[0] for f in _PAGE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows, held = [], 0
            for data in records(uri):
                rows.append(parse_record(data))
                if not with_payload:
                    rows[-1]["payload"] = None
                held += len(rows[-1]["payload"] or b"") + 200
                if held > READ:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def write_packages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every page as a WARC record into ZIP packages, one per partition; returns part, uri, n_records.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one
    with the largest id is the response, and the others are revisits that refer to it.

    Defined cases: a null payload is empty; a page without an id revisits the
    largest one with its payload, and is a response where no page with that payload
    has an id; rows that repeat the response's id and payload are responses too;
    a null url is left out; other columns are ignored; no rows give no packages.
    ``folder`` must be one that all executors reach; by default it is a new one
    below ``spark.checkpoint.dir``.
    """
    shipped(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "packages")
    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                          pages[payload_col].cast("string").cast("binary").alias("html"))
    payload = F.coalesce("html", F.lit(b""))
    keyed = narrow.withColumns({"key": F.sha2(payload, 256), "size": F.octet_length(payload)})
    # The choice is made on narrow rows; payloads move once, by page.
    ids = keyed.where(F.col("size") >= min_revisit_bytes).select("page_id", "key").distinct()
    heads = ids.where("page_id IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("head"))
    revisits = (ids.join(heads, "key").where(~F.col("page_id").eqNullSafe(F.col("head")))
                .select(F.col("page_id").alias("_page"), F.col("key").alias("_key"), F.col("head").alias("refers_to")))
    placed = (keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("key") == F.col("_key")), "left")
              .select("page_id", "url", "html", "refers_to"))
    return stored(placed.mapInArrow(lambda b: _write(b, folder), "part int, uri string, n_records long"), "packages-list")


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of packages (column uri): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a revisit is null; its size and digest are those of the full
    payload. A damaged package or payload is an error.
    """
    shipped(packages.sparkSession)
    return (packages.select("uri").repartition(partitions(packages), "uri")
            .mapInArrow(lambda b: _read(b, with_payload), _PAGE))

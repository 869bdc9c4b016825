"""Web archives in ZIP packages."""

import base64
import hashlib
import zipfile

import pytest

from tidelex.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record_type string, part int")


ROWS = [(1, "http://a/1", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (4, None, "<p>same</p>"), (2, "http://b/ two\n", "é" * 5000),
        (3, "http://c", ""), (7, "http://d", None), (5, "http://e", "only"), (5, "http://e", "only"), (5, "http://e", "other"),
        (None, "http://f", "<p>same</p>"), (None, "http://g", "nobody else"), (-3, "http://h", "\r\n\r\nWARC/1.1\r\n\x00")]


@pytest.mark.parametrize("least", [0, 1, 6])
def test_round_trip(spark, least):
    got = warc.read_packages(warc.write_packages(pages(spark, ROWS).repartition(4), min_revisit_bytes=least)).collect()
    heads = {}
    for i, _, h in ROWS:
        if i is not None:
            heads[h or ""] = max(i, heads.get(h or "", i))
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        revisit = len(raw) >= least and (h or "") in heads and heads[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
                     heads[h or ""] if revisit else None, None if revisit else raw))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert {r["url"] for r in got if r["page_id"] == 2} == {"http://b/%20two%0A"}


def test_no_pages(spark):
    assert warc.read_packages(warc.write_packages(pages(spark, []))).count() == 0


def test_package_is_a_zip_with_stored_members(spark):
    listed = warc.write_packages(pages(spark, ROWS)).collect()
    assert sum(r["n_records"] for r in listed) == len(ROWS)
    for r in listed:
        with zipfile.ZipFile(r["uri"].removeprefix("file:")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert {warc.ARCHIVE, warc.INDEX, "datapackage.json"} == set(z.namelist())


def test_zip64_directory(tmp_path):
    """More members than 16 bits count: the reader follows the ZIP64 locator and record."""
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr("archive/x.warc.gz", b"data")
    source = warc.opened(str(path))
    members = warc.directory(source, path.stat().st_size)
    assert len(members) == 66_001 and members[-1].name == "archive/x.warc.gz"
    assert warc.read_at(source, warc.data_start(source, members[-1]), members[-1].size) == b"data"


def test_zip64_sizes_and_places():
    """Sizes and places of 0xFFFFFFFF are taken from the extra field, in the order of the format."""
    import io
    import struct
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    tail = b"PK\x06\x07" + struct.pack("<IQI", 0, len(entry), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = entry + end64 + tail
    member, = warc.directory(io.BytesIO(data), len(data))
    assert (member.size, member.header) == (6 << 32, 7 << 32)


def test_archive_without_index(tmp_path):
    import gzip
    path = tmp_path / "bare.wacz"
    records = [warc.record(i, "http://x", b"p" * i, None) for i in range(5)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(gzip.compress(r) for r in records))
    assert list(warc.records(str(path))) == records
    assert warc.parse_record(records[3])["payload"] == b"ppp"


def test_damage_is_an_error(tmp_path):
    with pytest.raises(ValueError):
        warc.parse_record(warc.record(1, "http://x", b"abc", None).replace(b"abc", b"abd"))
    path = tmp_path / "packed.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 100)
    with pytest.raises(ValueError):
        list(warc.records(str(path)))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        list(warc.records(str(tmp_path / "no.zip")))

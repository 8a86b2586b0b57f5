"""Archives: round trip, other readers, and faults that must be found."""

import hashlib

import pytest
import zstandard

from floeline.llm import warc

LONG = "<p>" + "long é " * 300


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/b c\r\nx", LONG, 0), (2, None, LONG, 0), (7, "u", LONG, 0), (3, "u", "", 0), (4, "u", None, 0)]
    rows += [(5, "u", "short", 0), (6, "u", "short", 0), (None, "u", LONG, 0), (8, "u", LONG + "!", 0), (8, "u", LONG + "!", 0)]
    rows += [(i, "u", f"{i} " * (i % 700), 0) for i in range(100, 2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)
    warc.write(pages, str(tmp_path / "out"))
    found = warc.read(spark, str(tmp_path / "out")).collect()
    assert len(found) == len(rows)
    by = {}
    for row in found:
        by.setdefault(row.page_id, []).append(row)
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        for row in by[page_id]:
            assert row.payload_bytes == len(payload)
            assert row.payload_digest == hashlib.sha1(payload).hexdigest()
            revisit = html == LONG and page_id != 7
            assert (row.record_type, row.refers_to) == (("revisit", 7) if revisit else ("response", None))
            assert row.payload == (None if revisit else payload)
    assert by[1][0].url == "http://a/b%20c%0D%0Ax"


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def archive(*texts):
    return b"".join(warc.archive_frames([warc._record(i, "u", t.encode(), None) for i, t in enumerate(texts)]))


def test_frames_stand_alone():
    data = archive("one", "two" * 50, "")
    dictionary, at = warc._load_dictionary(memoryview(data), "x")
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[at:])
    assert warc.parse(first)["payload"] == b"one"
    assert [warc.parse(r)["payload"] for r in warc.records(data)] == [b"one", b"two" * 50, b""]


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/0.9"), "version"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Dat"), "warc-date"),
        (lambda r: r[:-1], "block"),
        (lambda r: r.replace(b"body", b"bodY"), "digest"),
        (lambda r: r.replace(b"response\r\nWARC-R", b"metadata\r\nWARC-R"), "type"),
        (lambda r: r.replace(b"Content-Length: ", b"Content-Length: x"), "Content-Length"),
    ],
)
def test_faults(change, message):
    record = warc._record(1, "u", b"body", None)
    assert warc.parse(record)["payload"] == b"body"
    with pytest.raises(ValueError, match=message):
        warc.parse(change(record))


def test_cut_archives():
    data = archive("one", "two" * 500)
    for bad in (data[:-3], data[8:], b"WARC" + data):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records(bad))

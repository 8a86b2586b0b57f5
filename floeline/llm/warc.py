"""WARC archives in Zstandard: one frame per record, the dictionary in a skippable frame in front.

Writing: each output file is an archive of at most RECORDS records. Its first frame is skippable and
holds a dictionary trained on the records of that archive (compressed itself, as the format allows).
The archives are written by Spark's text writer, so that they reach any file system Spark can write
and survive lost tasks; the "line separator" is an empty skippable frame, which every reader passes
over. Files end in .txt for that reason, their bytes are those of a .warc.zst.

Reading: files are taken whole, each record is decompressed alone and its version, headers, block
length, payload length and payload digest are checked. A fault raises an error that names the file.

Payloads of at least SHARED bytes that are equal are stored once, with the record of the largest
page_id; the others are revisit records that refer to it.

Defined results: a null html is an empty payload, a null url leaves its header out; an empty table
gives no archive and no rows. Null page_ids count as smaller than all others and are read back as
null. Rows that repeat the largest page_id of a payload are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.sources import scratch

# fixed values of the formats
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"

#: Payloads of fewer bytes are always stored.
SHARED = 1000
#: Rows of a file: the dictionary and the records. A file also ends after BYTES of payload.
RECORDS = 1000
BYTES = 32_000_000
DICTIONARY_BYTES = 32_768
#: Bytes of records that a dictionary is trained on at most.
TRAINED_BYTES = 1_000_000
NAME = "urn:floeline:page:"


def _record(page_id, url, payload: bytes, target) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if target is None else b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if target is not None:
        lines += [f"WARC-Refers-To: <{NAME}{target}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples, size = [], 0
    for record in records:
        if size < TRAINED_BYTES:
            samples.append(record[: TRAINED_BYTES - size])
            size += len(samples[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples to train on
        return zstandard.ZstdCompressionDict(samples[0][:DICTIONARY_BYTES] + b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records: list[bytes], level: int = 3) -> list[bytes]:
    """The dictionary frame and a frame for each record."""
    trained = _dictionary(records)
    packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    return [head, *(press.compress(r) for r in records)]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def flush(more: bool) -> pa.RecordBatch:
        frames = archive_frames(held)
        if more:  # the next file begins after RECORDS rows
            frames += [b""] * (RECORDS - len(frames))
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["value"])

    for batch in batches:
        for row in batch.to_pylist():
            if len(held) == RECORDS - 1 or size >= BYTES:
                yield flush(True)
                held, size = [], 0
            held.append(_record(row["page_id"], row["url"], row["_payload"], row["_target"]))
            size += len(row["_payload"])
    if held:
        yield flush(False)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, _payload and, for a revisit, _target: the page whose record holds the payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("_payload")).withColumn("_n", F.octet_length("_payload"))
    shared = rows.where(F.col("_n") >= SHARED).withColumn("_digest", F.sha1("_payload"))
    targets = (
        shared.groupBy("_digest", "_n")
        .agg(F.max("page_id").alias("_target"), F.count("*").alias("_copies"))
        .where("_copies > 1 and _target is not null")
        .select("_digest", "_n", "_target")
    )
    revisits: Column = F.when(~F.col("page_id").eqNullSafe(F.col("_target")), F.col("_target"))
    large = shared.join(targets, ["_digest", "_n"], "left").withColumn("_target", revisits)
    small = rows.where(F.col("_n") < SHARED).withColumn("_target", F.lit(None).cast("long"))
    columns = ["page_id", "url", "_payload", "_target"]
    return large.select(*columns).unionByName(small.select(*columns))


def write(pages: DataFrame, path: str) -> None:
    """Writes the archives of `pages` (page_id, url, html) into the folder `path`."""
    bounded(pages.sparkSession)
    frames = planned(pages).mapInArrow(_write, "value binary")
    # a string column may hold any bytes; the text writer puts them out as they are
    text = frames.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", RECORDS).text(path)


def _load_dictionary(data: memoryview, name: str) -> tuple[zstandard.ZstdCompressionDict, int]:
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME or len(data) < 8 + size:
        raise ValueError(f"{name}: no dictionary frame in front")
    raw = bytes(data[8 : 8 + size])
    if struct.unpack_from("<I", raw)[0] == ZSTD_FRAME:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def records(data: bytes, name: str = "archive") -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    view, step = memoryview(data), 1 << 15
    dictionary, at = _load_dictionary(view, name)
    inflate = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{name}: cut off at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        if magic != ZSTD_FRAME:
            raise ValueError(f"{name}: no frame at byte {at}")
        frame, parts = inflate.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError(f"{name}: the last frame is cut off")
            parts.append(frame.decompress(view[at : at + step]))
            at = min(at + step, len(view)) - len(frame.unused_data)
        yield b"".join(parts)


def _headers(block: bytes, name: str) -> tuple[bytes, dict[str, str], bytes]:
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError(f"{name}: headers without an end")
    first, *lines = head.split(b"\r\n")
    fields = {}
    for line in lines:
        key, colon, value = line.decode().partition(":")
        if not colon or not key.strip():
            raise ValueError(f"{name}: a header without a name")
        fields[key.strip().lower()] = value.strip()
    return first, fields, rest


def _number(fields: dict[str, str], name: str) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"{name}: no valid Content-Length")
    return int(value)


def _page(reference: str, name: str):
    inner = reference.removeprefix("<").removesuffix(">")
    if not inner.startswith(NAME):
        raise ValueError(f"{name}: unknown record {reference}")
    return int(inner.removeprefix(NAME)) if inner != NAME else None


def parse(record: bytes, name: str = "record") -> dict:
    """Fields of a record, after checks of version, headers, lengths and digest."""
    first, fields, rest = _headers(record, name)
    if first != VERSION:
        raise ValueError(f"{name}: version {first[:20]!r}")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if needed not in fields:
            raise ValueError(f"{name}: no {needed}")
    length = _number(fields, name)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{name}: the block has not its {length} bytes")
    _, http, payload = _headers(rest[:length], name)
    full, kind = _number(http, name), fields["warc-type"]
    algorithm, _, digest = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1":
        raise ValueError(f"{name}: digest by {algorithm}")
    digest = base64.b32decode(digest).hex()
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{name}: the payload has not its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError(f"{name}: a revisit with a payload or without a reference")
    if kind not in ("response", "revisit"):
        raise ValueError(f"{name}: type {kind}")
    return {
        "page_id": _page(fields["warc-record-id"], name),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"], name) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}
_SQL_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _read(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c for c in batch.columns), strict=True):
                data, rows, size = content.as_py(), [], 0
                if not data:
                    continue
                for record in records(data, path.as_py()):
                    found = parse(record, path.as_py())
                    rows.append(found)
                    size += len(record) if "payload" in names else 0
                    if size >= BYTES:
                        yield _rows(rows, names)
                        rows, size = [], 0
                yield _rows(rows, names)

    return run


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], FIELDS[n]) for n in names], names=names)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in `path`; the payload of a revisit is null."""
    bounded(spark)
    names = [n for n in FIELDS if payloads or n != "payload"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(names), ", ".join(f"{n} {_SQL_KINDS[FIELDS[n]]}" for n in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    path = scratch.folder(pages.sparkSession, "archives")
    write(pages, path)
    return read(pages.sparkSession, path, payloads=False).drop("url")

"""Byte-pair encoding of long unsplit texts by concatenation of halves, and decoding.

A long text is halved until its parts are short; the parts are encoded in parallel, each as a text of
its own. Going up the tree, two encoded halves are joined: a window around the join is split into
pieces again and grows until it starts and ends where both sides have a piece boundary that the other
half cannot move. Only the pieces between are encoded anew. If one of them is itself long (text
without blanks), its ids are joined in the same way one level deeper: the window of ids grows until
the first id of the re-encoded window is the first of the left side's and the last is the last of the
right side's. Neighbouring ids that encode to themselves in pairs are the encoding of the whole, so
the result is exact.

Defined results: a null text counts as an empty one, with no ids; an empty table gives no rows; equal
rows, null ids and clashing column names are kept, as each row gets the ids of its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm import vocabulary
from floeline.llm.batches import bounded
from floeline.llm.vocabulary import Vocabulary

#: Code points of a part that is encoded at once.
LEAF = 65_536
#: First size of a window, in code points and in ids; it doubles until both sides agree.
WINDOW = 64
#: A piece of more code points than this is joined by ids and not encoded anew.
LONG_PIECE = 512


@dataclass
class Encoded:
    """A text with its ids; `firsts` are the indexes of ids that start a piece, `places` their code points."""

    text: str
    ids: np.ndarray
    firsts: np.ndarray
    places: np.ndarray


def encode_leaf(known: Vocabulary, text: str) -> Encoded:
    ids, starts, first = known.placed(text)
    firsts = np.flatnonzero(first)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    points = np.cumsum((raw & 0xC0) != 0x80) - 1
    return Encoded(text, ids, firsts, points[starts[firsts]] if len(firsts) else firsts)


def halves(text: str, leaf: int) -> list[tuple[int, int]]:
    """Bounds of the leaves of the halving tree, in order."""

    def split(start: int, stop: int) -> list[tuple[int, int]]:
        if stop - start <= leaf:
            return [(start, stop)]
        middle = (start + stop) // 2
        return split(start, middle) + split(middle, stop)

    return split(0, len(text))


def join_ids(known: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of one piece from those of its two halves."""
    letters = vocabulary.letters_of_bytes()
    reach = WINDOW
    while True:
        a, b = left[-reach:], right[:reach]
        raw = b"".join(known.bytes_of[i] for i in [*a.tolist(), *b.tolist()])
        window = np.array(known.merge("".join(map(letters.__getitem__, raw))), dtype=np.int64)
        left_ok = len(a) == len(left) or window[0] == a[0]
        right_ok = len(b) == len(right) or window[-1] == b[-1]
        if left_ok and right_ok:
            return np.concatenate([left[: len(left) - len(a)], window, right[len(b) :]])
        reach *= 2


def join(known: Vocabulary, left: Encoded, right: Encoded, window: int = WINDOW) -> Encoded:
    """The encoding of left.text + right.text."""
    text, at = left.text + right.text, len(left.text)
    if not left.text or not right.text:
        return right if not left.text else left
    safe = vocabulary.stable_end(left.text)
    k = int(np.searchsorted(left.places, safe, side="right")) - 1 if safe >= 0 else -1
    since = int(left.places[k]) if k >= 0 else 0
    k = max(k, 0)
    reach = window
    while True:
        stop = min(len(text), at + reach)
        pieces = known.pieces(text[since:stop])
        limit = len(text) if stop == len(text) else since + vocabulary.stable_end(text[since:stop])
        starts = np.array([since + s for _, s, _ in pieces], dtype=np.int64)
        common = np.intersect1d(starts[(starts >= at) & (starts <= limit)], right.places + at)
        if len(common) or stop == len(text):
            break
        reach *= 2
    until = int(common[0]) if len(common) else len(text)
    new_ids, new_firsts, new_places, count = [], [], [], 0
    for letters, start, end in pieces:
        start, end = since + start, since + end
        if start >= until:
            break
        part = _piece_ids(known, left, right, letters, text[start:end], start, end, at)
        new_firsts.append(count)
        new_places.append(start)
        new_ids.append(part)
        count += len(part)
    k_ids = int(left.firsts[k]) if len(left.firsts) else 0
    m = int(np.searchsorted(right.places, until - at)) if len(common) else len(right.firsts)
    m_ids = int(right.firsts[m]) if m < len(right.firsts) else len(right.ids)
    ids = np.concatenate([left.ids[:k_ids], *new_ids, right.ids[m_ids:]]).astype(np.int64)
    firsts = np.concatenate([left.firsts[:k], np.array(new_firsts, dtype=np.int64) + k_ids, right.firsts[m:] - m_ids + k_ids + count])
    places = np.concatenate([left.places[:k], np.array(new_places, dtype=np.int64), right.places[m:] + at])
    return Encoded(text, ids, firsts.astype(np.int64), places.astype(np.int64))


def _piece_ids(known, left: Encoded, right: Encoded, letters: str, piece: str, start: int, end: int, at: int) -> np.ndarray:
    if not letters:
        return np.array([known.special[piece]], dtype=np.int64)
    if len(piece) > LONG_PIECE and start < at < end:
        k = int(np.searchsorted(left.places, start))
        ends = right.places[1] if len(right.places) > 1 else len(right.text)
        # both halves of the piece must be one piece on their own side
        if k == len(left.places) - 1 and left.places[k] == start and ends == end - at:
            stop = right.firsts[1] if len(right.firsts) > 1 else len(right.ids)
            return join_ids(known, left.ids[left.firsts[k] :], right.ids[:stop])
    return np.array(known.merge(letters), dtype=np.int64)


def tree(known: Vocabulary, leaves: list[Encoded]) -> np.ndarray:
    """Joins neighbours level by level."""
    level = leaves
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [join(known, *p) if len(p) == 2 else p[0] for p in pairs]
    return level[0].ids


def _digest(known: Vocabulary, ids) -> tuple[int, str, str]:
    packed = np.asarray(ids, dtype="<u4").tobytes()
    decoded = known.decode(ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            *rest, texts = batch.columns
            found = [_digest(known, known.ids(t)) for t in texts.to_pylist()]
            yield _with(batch, rest, found)

    return run


def _with(batch: pa.RecordBatch, rest: list, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    counts, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
    columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
    names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
    return pa.RecordBatch.from_arrays([*rest, *columns], names=names)


def _cut(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, (start, stop) in enumerate(halves(text, leaf)):
                    row = [key], [at], [text[start:stop]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["_key", "_at", "_part"])

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            for row in batch.to_pylist():
                found = encode_leaf(known, row["_part"])
                blobs = [np.asarray(v, dtype="<u4").tobytes() for v in (found.ids, found.firsts, found.places)]
                values = [[row["_key"]], [row["_at"]], [row["_part"]], *([b] for b in blobs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in values], names=["_key", "_at", "_part", "_ids", "_firsts", "_places"]
                )

    return run


def _join_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            for row in batch.to_pylist():
                leaves = [
                    Encoded(x["_part"], *(np.frombuffer(x[n], dtype="<u4").astype(np.int64) for n in ("_ids", "_firsts", "_places")))
                    for x in row["_leaves"]
                ]
                packed = np.asarray(tree(known, leaves), dtype="<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["_key"]]), pa.array([packed])], names=["_key", "_ids"])

    return run


def long_ids(texts: DataFrame, path: str, leaf: int) -> DataFrame:
    """(_key, _ids) of distinct long texts (_key, _body): leaves spread over the cluster, joined per text."""
    leaves = (
        texts.mapInArrow(_cut(leaf), "_key string, _at long, _part string")
        .repartition("_key", "_at")
        .mapInArrow(_encode_leaves(path), "_key string, _at long, _part string, _ids binary, _firsts binary, _places binary")
    )
    parts = F.struct("_at", "_part", "_ids", "_firsts", "_places")
    gathered = leaves.groupBy("_key").agg(F.sort_array(F.collect_list(parts)).alias("_leaves"))
    return gathered.mapInArrow(_join_leaves(path), "_key string, _ids binary")


def _digest_packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            *rest, packed = batch.columns
            found = [_digest(known, np.frombuffer(p, dtype="<u4").tolist()) for p in packed.to_pylist()]
            yield _with(batch, rest, found)

    return run


def _split_rows(docs: DataFrame, keep: list[str], text: str, leaf: int):
    body = F.coalesce(F.col(text), F.lit("")).alias("_body")
    rows = docs.select(*keep, body)
    is_long = F.length("_body") > leaf
    huge = rows.where(is_long).withColumn("_key", F.sha2("_body", 256))
    texts = huge.groupBy("_key").agg(F.any_value("_body").alias("_body"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body")
    return rows.where(~is_long), huge.drop("_body"), texts, kinds


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The columns `keep` of each row and `ids`, an array of int, of its whole text."""
    bounded(docs.sparkSession)
    path = path or vocabulary.default_path()
    short, huge, texts, kinds = _split_rows(docs, keep, text, leaf)

    def run(unpack):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary.load(path)
            for batch in batches:
                *rest, last = batch.columns
                ids = pa.array([unpack(known, v) for v in last.to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest, ids], names=[*batch.schema.names[:-1], "ids"])

        return each

    whole = short.mapInArrow(run(lambda known, t: known.ids(t)), f"{kinds}, ids array<int>")
    joined = huge.join(long_ids(texts, path, leaf), "_key").select(*keep, "_ids")
    return whole.unionByName(
        joined.mapInArrow(run(lambda _, p: np.frombuffer(p, dtype="<u4").astype(np.int32)), f"{kinds}, ids array<int>")
    )


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns `keep` and `text`, decoded; null ids give a null text, bytes that are no UTF-8 the mark U+FFFD."""
    bounded(encoded.sparkSession)
    path = path or vocabulary.default_path()
    rows = encoded.select(*keep, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            *rest, last = batch.columns
            texts = pa.array([None if v is None else known.decode(v) for v in last.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*rest, texts], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")


def digests(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The columns `keep` of each row, its number of ids and SHA-256 of its ids and of the text decoded from them."""
    bounded(docs.sparkSession)
    path = path or vocabulary.default_path()
    short, huge, texts, kinds = _split_rows(docs, keep, text, leaf)
    whole = short.mapInArrow(_digests_whole(path), f"{kinds}, {_DIGESTS}")
    joined = huge.join(long_ids(texts, path, leaf), "_key").select(*keep, "_ids")
    return whole.unionByName(joined.mapInArrow(_digest_packed(path), f"{kinds}, {_DIGESTS}"))

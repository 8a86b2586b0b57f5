"""Token counts; huge documents are encoded in overlapping chunks that are spliced where they agree.

A chunk is encoded as a text of its own, with byte offsets. In the overlap of two neighbours a
position at which a piece starts in both is a proven boundary: left of it the first chunk is exact
(it has seen all that its pieces depend on), and right of it both scan the same text from the same
state. Tokens of the first chunk behind the boundary and of the second before it are taken off the
sum. Where no common boundary exists, that document is done again with chunks and overlaps four
times as long, at last as one chunk.

Defined results: a null text counts as an empty one, with 0 tokens; an empty table gives no rows;
equal rows, null ids and clashing column names are kept as they are, as each row gets the count of
its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm import vocabulary
from floeline.llm.batches import bounded
from floeline.sources import scratch

CHUNK = 32_768
OVERLAP = 1_024
WIDEN = 4

_CUTS = "_key string, _at long, _last long, _byte long, _body string"
_ENDS = "_key string, _joint long, _total long, _left boolean, _places array<long>, _tokens array<long>"


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            *rest, texts = batch.columns
            counts = pa.array([len(known.ids(t)) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, counts], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                byte = 0
                for at in range(last + 1):
                    start = at * chunk
                    stop = len(text) if at == last else start + chunk + overlap
                    row = [key], [at], [last], [byte], [text[start:stop]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in row], names=["_key", "_at", "_last", "_byte", "_body"]
                    )
                    byte += len(text[start : start + chunk].encode())

    return run


def _ends(path: str, overlap: int):
    """For each chunk its count, and for each overlap the places where a piece starts, with the tokens to take off there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.load(path)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, at, byte = row["_body"], row["_at"], row["_byte"]
                ids, starts, first = known.placed(text)
                rows.append((row["_key"], -1, len(ids), None, None, None))
                index = np.flatnonzero(first)
                if at > 0:
                    upto = len(text[:overlap].encode())
                    mine = index[starts[index] < upto]
                    rows.append((row["_key"], at - 1, 0, False, (starts[mine] + byte).tolist(), mine.tolist()))
                if at < row["_last"]:
                    since = len(text[: len(text) - overlap].encode())
                    safe = vocabulary.stable_end(text)
                    until = len(text[: safe + 1].encode()) if safe >= 0 else -1
                    mine = index[(starts[index] >= since) & (starts[index] < until)]
                    rows.append(
                        (row["_key"], at, 0, True, (starts[mine] + byte).tolist(), (len(ids) - mine).tolist())
                    )
            kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["_key", "_joint", "_total", "_left", "_places", "_tokens"],
            )

    return run


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(_key, _n): tokens of each distinct long text; _n is null where two chunks have no common boundary."""
    chunks = texts.mapInArrow(_cut(chunk, overlap), _CUTS).repartition("_key", "_at")
    ends = scratch.stage(chunks.mapInArrow(_ends(path, overlap), _ENDS), "chunks")
    left = ends.where("_left").select("_key", "_joint", F.col("_places").alias("_a"), F.col("_tokens").alias("_more"))
    right = ends.where("not _left").select(
        "_key", "_joint", F.col("_places").alias("_b"), F.col("_tokens").alias("_less")
    )
    at = F.array_min(F.array_intersect("_a", "_b"))
    joints = left.join(right, ["_key", "_joint"]).withColumn("_place", at)
    lost = F.get("_more", F.array_position("_a", F.col("_place")).cast("int") - 1) + F.get(
        "_less", F.array_position("_b", F.col("_place")).cast("int") - 1
    )
    taken = joints.select("_key", (-lost).alias("_n"), F.col("_place").isNull().alias("_open"))
    totals = ends.where("_joint = -1").select("_key", F.col("_total").alias("_n"), F.lit(False).alias("_open"))
    summed = totals.unionByName(taken).groupBy("_key").agg(F.sum("_n").alias("_n"), F.max("_open").alias("_open"))
    return summed.select("_key", F.when(~F.col("_open"), F.col("_n")).alias("_n"))


def long_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(_key, n_tokens) for distinct (_key, text); ends, as each round has longer chunks than the one before."""
    done, open_ = None, texts
    while True:
        found = scratch.stage(_spliced(open_, path, chunk, overlap), "spliced")
        whole = found.where("_n is not null").select("_key", F.col("_n").alias("n_tokens"))
        done = whole if done is None else done.unionByName(whole)
        failed = found.where("_n is null").select("_key")
        if failed.isEmpty():
            return done
        open_ = open_.join(failed, "_key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    path: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The columns `keep` of each row, n_bytes (UTF-8) and n_tokens of its whole text."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap must be shorter than a chunk")
    bounded(docs.sparkSession)
    path = path or vocabulary.default_path()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_body"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "_body"}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", n_tokens long"
    is_long = F.length("_body") > chunk
    short = rows.where(~is_long).mapInArrow(_count_whole(path), schema)
    huge = rows.where(is_long).withColumn("_key", F.sha2("_body", 256))
    texts = huge.groupBy("_key").agg(F.any_value("_body").alias("_body"))
    counted = huge.drop("_body").join(long_counts(texts, path, chunk, overlap), "_key").drop("_key")
    return short.unionByName(counted.select(*short.columns))

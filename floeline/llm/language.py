"""Languages of texts, by the nearest of several centroids per language.

1. Vector: a text becomes its words in small letters (runs of letters, a blank on both sides); sequences of one to
   three characters of a word are hashed into BUCKETS entries. An entry weighs 1 + ln(count), times its inverse
   document frequency over all training rows; the vector has length 1.
2. Centroids: at most SAMPLE training rows of each language, those of the smallest hashes of their ids, are
   clustered by cosine into CENTROIDS groups (k-means on the sphere, farthest-first start), each language in a task
   of its own. A language's reach is the distance within which all but a share TAIL of the
   sample rows that were kept apart have a centroid.
3. Scoring: the language of the centroid with the greatest cosine. A text farther from it than the reach is marked
   as rejected: none of the known languages is near. Centroids are broadcast for AT_ONCE languages at a time.

Training rows have an id, a language that is not null, and crc32(id as text) mod 5 other than 0. Only the text is an
input of a prediction.

Defined results: null texts and texts without a letter get `und`, score 0, and are rejected, as are all rows if there
are no training rows. Training rows without a letter count nowhere. Equally near languages: the smallest name.
Repeated rows and null ids are kept (null ids count as not held out). An empty table gives no rows. Texts are read
whole, in bounded pieces (a word of over PIECE letters is cut). Only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.sources import scratch

BITS = 14
BUCKETS = 2**BITS
LONGEST = 3  # characters of a sequence
#: Rows per language that the centroids are fitted on at most.
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 12
#: One in so many of the sample rows measures the reach and fits no centroid.
MEASURED = 5
TAIL = 0.005
#: Languages whose centroids are broadcast together: 256 x 4 x 16384 numbers of 4 bytes are 64 MB.
AT_ONCE = 256
#: Characters of a text that are turned into sequences at once.
PIECE = 1_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _words(text: str) -> np.ndarray:
    """Code points of the words in small letters, with one blank (0) in front of, between and behind them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    codes = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]])
    # a blank is dropped if another follows it
    keep = np.ones(len(codes), dtype=bool)
    keep[:-1] = (codes[:-1] != 0) | (codes[1:] != 0)
    return codes[keep]


def _pieces(text: str) -> Iterator[str]:
    """Parts of at most about PIECE characters that end at the end of a word; only a longer word is cut."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and stop < at + 2 * PIECE and text[stop - 1].isalpha():
            stop += 1
        yield text[at:stop]
        at = stop


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed sequences in the words of a text; null without a letter.

    A sequence may begin or end with the blank beside a word, and has none inside.
    """
    total = None
    for piece in _pieces(text or ""):
        codes = _words(piece)
        if len(codes) < 3:
            continue
        value = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            count = len(codes) - n + 1
            value = value[:count] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            inside = codes[1 : count + 1] != 0 if n == LONGEST else codes != 0 if n == 1 else slice(None)
            fresh = value[inside]
            mixed = (fresh ^ (fresh >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found = np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
            total = found if total is None else total + found
    return total


def _vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.zeros(BUCKETS, dtype=np.float32)
    there = np.flatnonzero(found)
    weights[there] = (1 + np.log(found[there])) * idf[there]
    length = np.sqrt(np.dot(weights, weights))
    return weights / length if length else weights


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training(docs: DataFrame, text: str = "text") -> DataFrame:
    """id, lang and text of the rows that may be learned from."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("doc_id"))
    return docs.where(usable).select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each sequence, and (bucket -1) texts with a letter."""
    holding, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found = counts(text.as_py())
            if found is not None:
                holding += found > 0
                rows += 1
    there = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(there, -1)), pa.array(np.append(holding[there], rows))], names=["bucket", "n"]
    )


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 over all training rows; BUCKETS numbers reach the driver."""
    table = rows.select("text").mapInArrow(_holding, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    number = dict(zip(table["bucket"], table["n"], strict=True))
    df = np.array([number.get(b, 0) for b in range(BUCKETS)], dtype=np.float64)
    return (np.log((1 + number.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)


def clustered(rows: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows, and the centroid of each row."""
    middle = rows.sum(axis=0)
    chosen = [int((rows @ middle).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        nxt = int(near.argmin())
        if near[nxt] > 1 - 1e-6:  # only copies are left
            break
        chosen.append(nxt)
        near = np.maximum(near, rows @ rows[nxt])
    centroids = rows[chosen]
    owner = (rows @ centroids.T).argmax(axis=1)
    for _ in range(ROUNDS):
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-30), centroids)
        after = (rows @ centroids.T).argmax(axis=1)
        if (after == owner).all():
            break
        owner = after
    return centroids, owner


def _fit(shared):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = []
        for text in table.column("text"):
            found = counts(text.as_py())
            if found is not None:
                vectors.append(_vector(found, shared.value))
        out = {"lang": [], "cluster": [], "centroid": [], "reach": [], "members": []}
        if vectors:
            rows = np.stack(vectors)
            # what fitted the centroids is nearer to them than other texts are
            measured = np.arange(len(rows)) % MEASURED == 0 if len(rows) >= 2 * MEASURED else np.zeros(len(rows), dtype=bool)
            centroids, owner = clustered(rows[~measured])
            spare = rows[measured] if measured.any() else rows
            reach = float(np.quantile(1 - (spare @ centroids.T).max(axis=1), 1 - TAIL))
            for c, members in enumerate(np.bincount(owner, minlength=len(centroids)).tolist()):
                out["lang"].append(key[0].as_py())
                out["cluster"].append(c)
                out["centroid"].append(centroids[c])
                out["reach"].append(reach)
                out["members"].append(members)
        return pa.Table.from_pydict(
            out,
            schema=pa.schema(
                [("lang", pa.string()), ("cluster", pa.int32()), ("centroid", pa.list_(pa.float32())), ("reach", pa.float64()), ("members", pa.int64())]
            ),
        )

    return run


def centroids(rows: DataFrame, idf: np.ndarray, sample: int = SAMPLE) -> DataFrame:
    """lang, cluster, centroid, reach and members, staged."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    # twice the sample by expectation: texts of few rows only are shuffled, however many rows and tasks there are
    sizes = scratch.stage(rows.groupBy("lang").count(), "languages").select(F.col("lang").alias("_lang"), "count")
    share = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    likely = rows.join(sizes, F.col("lang") == F.col("_lang")).where(share * F.col("count") <= 2 * sample)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    chosen = likely.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("lang", "text")
    fitted = chosen.groupBy("lang").applyInArrow(
        _fit(shared), "lang string, cluster int, centroid array<float>, reach double, members long"
    )
    return scratch.stage(fitted, "centroids")


def _nearest(shared):
    """Best of the centroids of one block and of the best that came with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, names, matrix, reach = shared.value
        for batch in batches:
            texts = batch.column("text")
            best = list(zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), batch.column("reach").to_pylist(), strict=True))
            for at in range(0, len(texts), 128):
                vectors, places = [], []
                for i in range(at, min(at + 128, len(texts))):
                    found = counts(texts[i].as_py())
                    if found is not None:
                        vectors.append(_vector(found, idf))
                        places.append(i)
                if not vectors:
                    continue
                near = np.stack(vectors) @ matrix.T
                # centroids come sorted by language: the first of equal ones has the smallest name
                top = near.argmax(axis=1)
                for i, c, cosine in zip(places, top, near[np.arange(len(top)), top], strict=True):
                    cosine = min(1.0, max(0.0, float(cosine)))
                    if best[i][0] == UNKNOWN or cosine > best[i][1]:
                        best[i] = names[c], cosine, reach[c]
            columns = [batch.column("doc_id"), texts, *(list(c) for c in zip(*best, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [*columns[:2], pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64())],
                names=["doc_id", "text", "lang_pred", "score", "reach"],
            )

    return run


def predicted(docs: DataFrame, text: str = "text", sample: int = SAMPLE, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), distance and rejected of each row."""
    spark = docs.sparkSession
    bounded(spark)
    rows = training(docs, text)
    idf = inverse_frequencies(rows)
    fitted = centroids(rows, idf, sample)
    names = [r["lang"] for r in fitted.select("lang").distinct().orderBy("lang").collect()]
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(0.0).alias("score"),
        F.lit(-1.0).alias("reach"),
    )
    for first in range(0, len(names), at_once):
        block = fitted.where(F.col("lang").isin(names[first : first + at_once])).orderBy("lang", "cluster").toPandas()
        shared = spark.sparkContext.broadcast(
            (idf, block["lang"].tolist(), np.stack(block["centroid"].to_list()).astype(np.float32), block["reach"].tolist())
        )
        found = found.mapInArrow(_nearest(shared), "doc_id long, text string, lang_pred string, score double, reach double")
    distance = 1 - F.col("score")
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        distance.alias("distance"),
        (distance > F.col("reach")).alias("rejected"),
    )

"""Ranked lexical search with posting lists in blocks of similar documents.

A document's score for an item is the sum over the item's terms (repeats included) of
w * ((10^9 tf) div (1000 tf + 12 m)), in whole numbers; w falls with the documents that hold the term, m grows with
the length of the document.

1. Terms: every whole text is counted once; the counts of the items' terms and the length of each document are
   staged. Document frequencies and the largest impact of each term come from them.
2. A share SEEDS of the documents, chosen by hash, is scored in full; an item's k-th best score there is a
   threshold that its k-th best document can't be below. It only saves work.
3. Index: each task takes SHARD documents at a time. A term's posting list is clustered: evenly spread documents
   of it are representatives, every document joins the most similar one (cosine of vectors projected at random).
   A cluster, cut into BLOCK documents, is a block; its summary is the largest impact in the block for every term that
   any search visiting the list still has to come to.
4. Search: an item visits its terms' lists from the largest possible contribution down, and ends where all terms that
   are left can't reach its threshold together. A block is skipped only if its summary, summed over the item's terms
   from this list on, is below the threshold: documents with earlier terms were met in earlier lists. All documents of
   other blocks are scored exactly. The best of all tasks are ranked by Spark.

Summaries hold the terms of the items, not all: whole ones would take the square of a document's terms for each
document. Items are dealt into sets of at most QUERY_BYTES of text (one longer item is a set of its own); only such a
set is broadcast, and each set searches all documents. Document frequencies, lengths and N, L cover all documents.

Defined results: null and empty texts, and texts without a term, are no documents and get no rank; an item without
terms, or whose terms no document holds, has no rows. Items that repeat in id and text are ranked once; items of one
id and different texts are ranked separately, null ids too. Each row of `docs` is a document of its own, also with a
repeated or null id; equal scores are ranked by id, null last. Empty tables give no rows. Only the columns named are
read, so further columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.sources import scratch

# fixed values of the score
BEST = 20
UNIT, SLOPE, PER_LENGTH, FLAT = 1_000_000_000, 1000, 12, 25
QUERY_BYTES = 8 * 2**20
SEEDS = 8
SHARD = 4096
#: Postings at which a shard is full before it has SHARD documents.
SHARD_POSTINGS = 2_000_000
BLOCK = 16
DIRECTIONS = 32
#: Items that a shard searches at once.
AT_ONCE = 2048
PIECE = 4_000_000

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def term_counts(raw: bytes | None) -> Counter:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all that is not ASCII, with A-Z in small letters."""
    found: Counter = Counter()
    plain = (raw or b"").translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        stop = plain.find(b" ", at + PIECE)
        stop = len(plain) if stop < 0 else stop
        found.update(plain[at:stop].split())
        at = stop
    return found


@dataclass
class Items:
    """One set of items: ids, and for each item its terms (numbers in `known`) and how often it has them."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    known: dict[bytes, int] = field(repr=False)


def compiled(rows: list[tuple]) -> Items:
    """`rows` of (id, UTF-8 text)."""
    known: dict[bytes, int] = {}
    ids, terms, times = [], [], []
    for key, raw in rows:
        found = term_counts(raw)
        ids.append(key)
        terms.append(np.array([known.setdefault(t, len(known)) for t in found], dtype=np.int64))
        times.append(np.array(list(found.values()), dtype=np.int64))
    return Items(ids, terms, times, known)


def item_sets(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The distinct items in sets of at most `limit` bytes of text, or one item."""
    distinct = items.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("raw")).where(F.length("raw") > 0).distinct()
    staged = scratch.stage(distinct.withColumn("at", F.pmod(F.xxhash64("id", "raw"), F.lit(2**40))), "items")
    total = staged.agg(F.sum(F.length("raw"))).first()[0] or 0
    sets = 1 if total <= limit else -(-2 * total // limit)
    while True:
        sizes = staged.groupBy((F.col("at") % sets).alias("set")).agg(F.sum(F.length("raw")).alias("size"), F.count("*").alias("n"))
        if not sizes.where((F.col("size") > limit) & (F.col("n") > 1)).count():
            break
        sets *= 2
    for number in range(sets):
        rows = staged.where(F.col("at") % sets == number).select("id", "raw").collect()
        if rows:
            yield [(r["id"], bytes(r["raw"])) for r in rows]


def _counted(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, terms, times = [], [], []
            for raw in batch.column(1):
                found = term_counts(raw.as_py())
                lengths.append(found.total())
                mine = [(known[t], n) for t, n in found.items() if t in known]
                terms.append([t for t, _ in mine])
                times.append([n for _, n in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "times"],
            )

    return run


def counted(docs: DataFrame, known: dict[bytes, int], text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), and of the known terms their numbers and counts; documents with a term only, staged."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    found = rows.mapInArrow(_counted(shared), "doc_id long, n long, terms array<int>, times array<int>").where("n > 0")
    return scratch.stage(found, "term-counts")


def with_impacts(vectors: DataFrame, documents: int, length: int) -> DataFrame:
    """`vectors` with the impact of each term in place of its count, for N = documents and L = length."""
    m = F.expr(f"{100 - FLAT} + ({FLAT} * n * {documents}L) div {length}L")

    def impact(times: Column) -> Column:
        return F.transform(times, lambda tf: F.call_function("div", tf.cast("long") * UNIT, tf.cast("long") * SLOPE + PER_LENGTH * F.col("m")))

    return vectors.withColumn("m", m).select("doc_id", "terms", impact(F.col("times")).alias("impacts"))


def weights(holding: np.ndarray, documents: int) -> np.ndarray:
    """w of each term from the documents that hold it; 0 for terms that none holds."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in holding], dtype=np.int64)


@dataclass
class Plan:
    """What a task needs to search: per item its terms from the largest possible contribution down.

    `gains` are times * w; `left[i]` is the most that terms i and later can give together. `needed` holds for
    each list that some item may visit the terms of its summaries, and `visits` (item, place of the list's term).
    """

    ids: list
    terms: list[np.ndarray]
    gains: list[np.ndarray]
    left: list[np.ndarray]
    floors: np.ndarray
    needed: dict[int, np.ndarray]
    visits: dict[int, list[tuple[int, int]]]
    size: int
    best: int


def planned(items: Items, weight: np.ndarray, largest: np.ndarray, floors: np.ndarray, best: int) -> Plan:
    terms, gains, left = [], [], []
    suffixes: dict[int, list[np.ndarray]] = {}
    visits: dict[int, list[tuple[int, int]]] = {}
    for item, (mine, times) in enumerate(zip(items.terms, items.times, strict=True)):
        gain = times * weight[mine]
        most = gain * largest[mine]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        rest = most[order][::-1].cumsum()[::-1]
        terms.append(mine[order])
        gains.append(gain[order])
        left.append(rest)
        for place in range(int((rest >= max(1, floors[item])).sum())):
            term = int(mine[order][place])
            suffixes.setdefault(term, []).append(mine[order][place:])
            visits.setdefault(term, []).append((item, place))
    needed = {term: np.unique(np.concatenate(parts)) for term, parts in suffixes.items()}
    return Plan(items.ids, terms, gains, left, floors, needed, visits, len(items.known), best)


class Shard:
    """Documents of a task by row and by posting list."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.ids, self.sizes, self.terms, self.impacts = ids, sizes, terms, impacts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.size = size
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.listed = row[order]
        self.bounds = np.searchsorted(terms[order], np.arange(size + 1))
        self._local = np.full(size, -1, dtype=np.int64)
        self._gain = np.zeros(size, dtype=np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.listed[self.bounds[term] : self.bounds[term + 1]]

    def directions(self, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Unit vectors of the documents, projected at random."""
        value = (self.impacts * weight[self.terms]).astype(np.float32)[:, None]
        out = np.zeros((len(self.ids), table.shape[1]), dtype=np.float32)
        for at in range(0, len(self.ids), 256):
            low, high = self.starts[at], self.starts[min(at + 256, len(self.ids))]
            out[at : at + 256] = np.add.reduceat(table[self.terms[low:high]] * value[low:high], self.starts[at : at + 256][: len(out[at : at + 256])] - low, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of `rows`, one row after the other, and where each row starts among them."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return at, ends - sizes

    def dense(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Impacts of `rows` for the wanted terms (sorted)."""
        at, _ = self.entries(rows)
        self._local[wanted] = np.arange(len(wanted))
        column = self._local[self.terms[at]]
        self._local[wanted] = -1
        there = column >= 0
        out = np.zeros((len(rows), len(wanted)), dtype=np.int64)
        out[np.repeat(np.arange(len(rows)), self.sizes[rows])[there], column[there]] = self.impacts[at[there]]
        return out

    def scores(self, rows: np.ndarray, terms: np.ndarray, gains: np.ndarray) -> np.ndarray:
        at, starts = self.entries(rows)
        self._gain[terms] = gains
        found = np.add.reduceat(self._gain[self.terms[at]] * self.impacts[at], starts)
        self._gain[terms] = 0
        return found


def blocks(rows: np.ndarray, directions: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a posting list by cluster, and the starts of its blocks."""
    if len(rows) <= size:
        return rows, np.zeros(1, dtype=np.int64)
    number = -(-len(rows) // size)
    heads = rows[np.arange(number) * len(rows) // number]
    owner = (directions[rows] @ directions[heads].T).argmax(axis=1)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return rows[order], np.flatnonzero(inside % size == 0)


class Best:
    """The best documents of each item so far."""

    def __init__(self, plan: Plan):
        self.k = plan.best
        self.scores: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in plan.ids]
        self.docs: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in plan.ids]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, least: int) -> None:
        keep = scores >= least
        if keep.any():
            scores = np.concatenate([self.scores[item], scores[keep]])
            docs = np.concatenate([self.docs[item], docs[keep]])
            order = np.lexsort((docs, -scores))[: self.k]
            self.scores[item], self.docs[item] = scores[order], docs[order]

    def least(self, item: int, floor: int) -> int:
        """The score below which a document can't be among the best."""
        mine = self.scores[item]
        return max(1, int(floor), int(mine[-1]) if len(mine) == self.k else 0)


#: Stands for a null id in a task: sorts behind every id.
_NO_ID = np.iinfo(np.int64).max


def shards(batches: Iterator[pa.RecordBatch], size: int, documents: int) -> Iterator[Shard]:
    """Full shards of the rows of a task; documents without a term of any item are left out, as their scores are 0."""
    parts: list[tuple] = []
    rows = postings = 0

    def full() -> Shard:
        ids, sizes, terms, impacts = (np.concatenate(p) for p in zip(*parts, strict=True))
        return Shard(ids, sizes, terms, impacts, size)

    for batch in batches:
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not sizes.sum():
            continue
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        impacts = batch.column("impacts").flatten().to_numpy(zero_copy_only=False)
        parts.append((ids[sizes > 0], sizes[sizes > 0], terms, impacts))
        rows += int((sizes > 0).sum())
        postings += len(terms)
        if rows >= documents or postings >= SHARD_POSTINGS:
            yield full()
            parts, rows, postings = [], 0, 0
    if parts:
        yield full()


def search_shard(shard: Shard, plan: Plan, weight: np.ndarray, table: np.ndarray, best: Best, first: int, last: int) -> int:
    """Adds the shard's documents to the best of items first to last - 1; gives the number of exact scores."""
    least = np.array([best.least(i, plan.floors[i]) for i in range(first, last)])
    visited = np.zeros((last - first, len(shard.ids)), dtype=bool)
    directions = shard.directions(table, weight)
    for term, wanted in plan.needed.items():
        rows = shard.postings(term)
        visits = [(i - first, i, place) for i, place in plan.visits[term] if first <= i < last and plan.left[i][place] >= least[i - first]]
        if not len(rows) or not visits:
            continue
        rows, starts = blocks(rows, directions)
        summaries = np.maximum.reduceat(shard.dense(rows, wanted), starts, axis=0)
        ends = np.append(starts[1:], len(rows))
        gains = np.zeros((len(visits), len(wanted)), dtype=np.int64)
        for v, (_, i, place) in enumerate(visits):
            gains[v, np.searchsorted(wanted, plan.terms[i][place:])] = plan.gains[i][place:]
        reach = gains @ summaries.T
        for v, (slot, _, _) in enumerate(visits):
            open_ = reach[v] >= least[slot]
            if open_.any():
                visited[slot, rows[np.repeat(open_, ends - starts)]] = True
    scored = 0
    for slot in range(last - first):
        rows = np.flatnonzero(visited[slot])
        if len(rows):
            i = first + slot
            best.add(i, shard.scores(rows, plan.terms[i], plan.gains[i]), shard.ids[rows], int(least[slot]))
            scored += len(rows)
    return scored


def _search(shared: Broadcast, kind: pa.DataType, documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        table = np.random.default_rng(1).normal(size=(plan.size, DIRECTIONS)).astype(np.float32)
        best = Best(plan)
        for shard in shards(batches, plan.size, documents):
            for first in range(0, len(plan.ids), AT_ONCE):
                search_shard(shard, plan, weight, table, best, first, min(first + AT_ONCE, len(plan.ids)))
        item = np.repeat(np.arange(len(plan.ids)), [len(s) for s in best.scores])
        docs = np.concatenate([*best.docs, np.zeros(0, dtype=np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item),
                pa.array([plan.ids[i] for i in item], kind),
                pa.array(docs, mask=docs == _NO_ID),
                pa.array(np.concatenate([*best.scores, np.zeros(0, dtype=np.int64)])),
            ],
            names=["item", "item_id", "doc_id", "score"],
        )

    return run


def _plain(shared: Broadcast):
    """The best scores of each item over all rows of a task, each scored in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = Best(plan)
        for shard in shards(batches, plan.size, SHARD):
            every = np.arange(len(shard.ids))
            for i in range(len(plan.ids)):
                best.add(i, shard.scores(every, plan.terms[i], plan.gains[i]), shard.ids, 1)
        item = np.repeat(np.arange(len(plan.ids)), [len(s) for s in best.scores])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(np.concatenate([*best.scores, np.zeros(0, dtype=np.int64)]))], names=["item", "score"]
        )

    return run


def _first(rows: DataFrame, best: int, *order: Column) -> DataFrame:
    """The first `best` rows of each item; Spark keeps as many in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def thresholds(sample: DataFrame, plan: Plan, best: int) -> np.ndarray:
    """The k-th best score of each item among the sampled documents, 0 if fewer have a score."""
    shared = sample.sparkSession.sparkContext.broadcast(plan)
    found = sample.mapInArrow(_plain(shared), "item long, score long")
    rows = _first(found, best, F.desc("score")).where(F.col("rank") == best).select("item", "score").collect()
    floors = np.zeros(len(plan.ids), dtype=np.int64)
    for r in rows:
        floors[r["item"]] = r["score"]
    return floors


def ranked(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "item_id",
    best: int = BEST,
    query_bytes: int = QUERY_BYTES,
    shard: int = SHARD,
) -> DataFrame:
    """`key`, rank, doc_id and score of the `best` documents of each item."""
    spark = docs.sparkSession
    bounded(spark)
    kind = items.schema[key].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    typed = items.withColumn(key, F.col(key).cast("string")) if pa.types.is_string(arrow) else items
    columns = f"item long, item_id {typed.schema[key].dataType.simpleString()}, doc_id long, score long"
    out = spark.createDataFrame([], f"{columns}, rank int")
    for rows in item_sets(typed, key, text, query_bytes):
        queries = compiled(rows)
        vectors = counted(docs, queries.known, text)
        documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        impacts = with_impacts(vectors, documents, length)
        pairs = impacts.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("p.terms", "p.impacts")
        held = pairs.groupBy("terms").agg(F.count("*").alias("df"), F.max("impacts").alias("most")).collect()
        holding, largest = np.zeros(len(queries.known), dtype=np.int64), np.zeros(len(queries.known), dtype=np.int64)
        for r in held:
            holding[r["terms"]], largest[r["terms"]] = r["df"], r["most"]
        weight = weights(holding, documents)
        none = np.zeros(len(queries.ids), dtype=np.int64)
        sample = impacts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEEDS)) == 0)
        floors = thresholds(sample, planned(queries, weight, largest, none, best), best)
        shared = spark.sparkContext.broadcast((planned(queries, weight, largest, floors, best), weight))
        found = impacts.mapInArrow(_search(shared, arrow, shard), columns)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        out = out.unionByName(_first(found, best, *order))
    return out.select(F.col("item_id").cast(kind).alias(key), "rank", "doc_id", "score")

"""Near-duplicate join: five-word shingles, a MinHash LSH forest, exact Jaccard similarity.

1. Documents with equal shingle sets are one node; all further work is on nodes, weighted by copies.
2. Each node gets TREES labels, each a string of minhashes. Read as prefix tries, two nodes that share
   a prefix of length d in one tree are candidates. Matched prefixes are shortened from DEPTH on until
   a pair at the threshold is met with the target probability (TREES 16, threshold 0.8: length 4, 0.9998);
   above the threshold the probability is higher.
3. A trie node whose members all share a prefix in an earlier tree brings no new pair and is left out.
4. Shingle sets of the members left are compared exactly, all against all in blocks of at most BLOCK,
   as products of 0/1 matrices. Nothing is emitted per pair: only the number of links of each node, and
   one edge to the smallest node it is tied to. A pair that meets in several trees counts in the first.
5. Classes are the connected components.

Counting all links of a group of g different near copies takes g^2 comparisons, spread over
(g / BLOCK)^2 tasks; the rows sent grow with g^2 / BLOCK.

Defined results: a text of one to four words has one shingle of all its words; a text without a word
(null, empty, only punctuation) is similar to nothing and is a class of its own. Equal rows are
copies. Null ids are kept; a class whose ids are all null has a null class_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm import words
from floeline.llm.batches import bounded
from floeline.llm.components import components
from floeline.llm.decontamination import bit_field
from floeline.sources import scratch

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 10
RECALL = 0.999
#: Nodes that are compared all against all in one task.
BLOCK = 1500
_COLUMNS = 4096


def prefix_length(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is met with the target probability."""
    length = DEPTH
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    tokens = words.hashes(text)
    size = min(SHINGLE, len(tokens))
    return np.unique(words.combined(tokens, tuple(range(size)), size)) if size else tokens


@cache
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20_25)
    odd = made.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], made.integers(0, 2**63, count, dtype=np.uint64)[:, None]


def labels(found: np.ndarray, trees: int, length: int) -> np.ndarray:
    """For each tree a hash of the prefix of minhashes."""
    factor, term = _factors(trees * length)
    least = np.full(trees * length, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 8192):
        np.minimum(least, (found[None, at : at + 8192] * factor + term).min(axis=1), out=least)
    total = np.arange(1, trees + 1, dtype=np.uint64)
    for column in least.reshape(trees, length).T:
        total = words.mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total


_SETS = "_row long, doc_id long, _node string, _size int, _labels array<long>"


def _sets(trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc, text = batch.columns
            nodes, sizes, lists = [], [], []
            for t in text.to_pylist():
                found = shingles(t)
                nodes.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                sizes.append(len(found))
                lists.append(labels(found, trees, length).view(np.int64).tolist() if len(found) else None)
            columns = [row, doc, pa.array(nodes, pa.string()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "_node", "_size", "_labels"])

    return run


def _wanted(field, bits: int):
    """Shingle sets of the rows that the bit field lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(field.value, dtype=np.uint64)
        mask = np.uint64(bits - 1)
        for batch in batches:
            row, text = batch.columns
            key = np.asarray(row).view(np.uint64)
            passed = np.ones(len(key), dtype=bool)
            for slot in (key & mask, (key >> np.uint64(32)) & mask):
                passed &= (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            index = np.flatnonzero(passed)
            sets = [shingles(t).tobytes() for t in text.take(pa.array(index)).to_pylist()]
            columns = [row.take(pa.array(index)), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_set"])

    return run


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(member, shingle) of all shingles that two members or more have, sorted by shingle, and the number of those."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, member = flat[order], member[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    member, column = member[shared], column[shared]
    first = np.ones(len(column), dtype=bool)
    first[1:] = column[1:] != column[:-1]
    return member, np.cumsum(first) - 1, int(first.sum())


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of each pair."""
    member, column, width = _incidence(sets)
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    bounds = np.searchsorted(column, np.arange(0, width + _COLUMNS, _COLUMNS))
    for at, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = np.zeros((len(sets), min(_COLUMNS, width - at * _COLUMNS)), dtype=np.float32)
        part[member[a:b], column[a:b] - at * _COLUMNS] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = common(sets)
    found = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(found, False)
    return found


def roots(found: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(found), -1)
    for start in range(len(found)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(found[front].any(axis=0) & (root < 0))
            root[reached] = start
            front = reached
    return root


def _compare(threshold: float):
    """Rows of one group (tree, label, blocks) follow each other; gives links and an edge for each member."""

    def group(rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r["_node"])
        tree, one, two = rows[0]["_tree"], rows[0]["_one"], rows[0]["_two"]
        found = linked([np.frombuffer(r["_set"], dtype=np.uint64) for r in rows], threshold)
        if one != two:  # pairs within a block have a task of their own
            side = np.array([r["_block"] for r in rows])
            found &= side[:, None] != side[None, :]
        marks = np.array([r["_labels"] for r in rows])
        for earlier in range(tree):
            found &= marks[:, None, earlier] != marks[None, :, earlier]
        counts = found @ np.array([r["_copies"] for r in rows], dtype=np.int64)
        for row, root, count in zip(rows, roots(found).tolist(), counts.tolist(), strict=True):
            if count:
                yield row["_node"], rows[root]["_node"], count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = row["_tree"], row["_label"], row["_one"], row["_two"]
                if now != key and held:
                    out += group(held)
                    held = []
                key = now
                held.append(row)
            yield _edges(out)
        yield _edges(list(group(held)) if held else [])

    return run


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = pa.string(), pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["u", "v", "n"])


def _open_members(nodes: DataFrame, trees: int) -> DataFrame:
    """Members of the trie nodes that may hold a pair that no earlier tree has, dealt over blocks."""
    slim = nodes.select("_node", F.posexplode("_labels").alias("_tree", "_label"))
    shared = slim.groupBy("_tree", "_label").agg(F.count("*").alias("_members")).where("_members > 1")
    members = slim.join(shared, ["_tree", "_label"]).join(nodes, "_node")
    marks = [F.get("_labels", F.lit(i)) for i in range(trees)]
    same = [(F.lit(i) < F.col("_tree")) & (F.min(m) == F.max(m)) for i, m in enumerate(marks)]
    settled = F.lit(False)
    for test in same:
        settled = settled | test
    open_ = members.groupBy("_tree", "_label", "_members").agg(settled.alias("_settled")).where("not _settled")
    members = members.join(open_.select("_tree", "_label"), ["_tree", "_label"])
    blocks = F.ceil(F.col("_members") / BLOCK).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_block", F.expr("cast(pmod(xxhash64(_node), _blocks) as int)"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least("_block", other).alias("_one"), F.greatest("_block", other).alias("_two")),
    )
    return dealt.withColumn("_pair", F.explode(pair)).select("_node", "_row", "_copies", "_labels", "_tree", "_label", "_block", "_pair.*")


def _solve(docs: DataFrame, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Per row its node, and per node its copies, links and root."""
    spark = docs.sparkSession
    bounded(spark)
    length = prefix_length(threshold)
    rows = docs.select(F.xxhash64("doc_id", F.col(text)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text))
    sets = scratch.stage(rows.mapInArrow(_sets(TREES, length), _SETS), "sets")
    nodes = scratch.stage(
        sets.where("_node is not null")
        .groupBy("_node")
        .agg(F.count("*").alias("_copies"), F.min("_row").alias("_row"), F.any_value("_labels").alias("_labels")),
        "nodes",
    )
    members = scratch.stage(_open_members(nodes, TREES), "members")
    field, bits = bit_field(members.select("_row"), "_row")
    found = rows.select("_row", F.col(text)).mapInArrow(_wanted(spark.sparkContext.broadcast(field), bits), "_row long, _set binary")
    by_row = found.groupBy("_row").agg(F.any_value("_set").alias("_set"))
    keys = ["_tree", "_label", "_one", "_two"]
    sides = members.join(by_row, "_row").repartition(*keys).sortWithinPartitions(*keys)
    links = scratch.stage(sides.drop("_row").mapInArrow(_compare(threshold), "u string, v string, n long"), "links")
    tied = components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("_node")).agg(F.sum("n").alias("_links"))
    solved = (
        nodes.select("_node", "_copies")
        .join(counts, "_node", "left")
        .join(tied.select(F.col("u").alias("_node"), F.col("v").alias("_root")), "_node", "left")
        .select(
            "_node",
            F.coalesce("_root", "_node").alias("_root"),
            (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
        )
    )
    return sets, solved


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the class) and n_links (other rows at the threshold or above) of each row."""
    sets, solved = _solve(docs, text, threshold)
    rows = sets.select("doc_id", "_node").join(solved, "_node", "left")
    least = rows.where("_root is not null").groupBy("_root").agg(F.min("doc_id").alias("class_id"))
    alone = F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.join(least, "_root", "left").select("doc_id", alone.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest id, with the columns of the input; rows without a word all stay."""
    sets, solved = _solve(docs, text, threshold)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    least = sets.join(solved, "_node").groupBy("_root").agg(F.min(order).alias("_first")).select("_first._row")
    own = docs.withColumn("_row", F.xxhash64("doc_id", F.col(text)))
    kept = own.join(least.distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    bare = sets.where("_node is null").select("_row").distinct()
    return kept.unionByName(own.join(bare, "_row", "left_semi")).select(*docs.columns)

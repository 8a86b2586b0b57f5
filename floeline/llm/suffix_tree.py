"""Scores of texts by a probabilistic suffix tree, beside a unigram baseline.

The tree is over bytes. A text is its words in small letters (A-Z only), each followed by a blank, and
an end sign; a context is what stands before a byte, ORDER bytes at most. A context becomes a state if

* it is met LEAST times at least in the training texts, and
* the divergence of its next bytes from those of the context one byte shorter, times its count, is more
  than BITS for each different next byte.

All suffixes of a state are states. The distribution of a state is smoothed by that of the next
shorter state: P(a|s) = (n(s,a) + K P(a|shorter)) / (C + K). A byte is scored by the longest suffix
state of what stands before it. The chance of a token under the tree is then
smoothed by its share among the training tokens; the weight is the one of WEIGHTS under which the
tokens of the tuning rows are likeliest: one in TUNED of the training rows, whose bytes the tree has not
counted, and each of whose tokens is left out of its own share.

Everything is counted over all documents: texts are cut into blocks of words with numbers of their
own; the counts of words and of byte sequences are summed over the blocks. The sequences are dealt by the
last three bytes of their contexts, so that all contexts from there on meet in one task, at most 2^24 sequences to
a group; contexts of two bytes and less (2^24 sequences at most) are counted for all and sent to every task.
A task gives each sequence its chance as a linear function of the chance under two bytes of context, which is known
only when all tasks have said which short contexts their states end in. The chances go back to the blocks.

Defined results: a null text counts as an empty one, which has its end as only token; a null id is a
training row; equal rows are scored each; an empty table gives no rows; other columns are ignored.
Without training rows the tree is its root with equal chances, without tuning rows it is not smoothed by shares.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.operators.ordering import width
from floeline.sources import scratch

ORDER = 5
LEAST = 2
BITS = 3.0
WEIGHTS = (0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 0.97)
K = 8.0
TUNED = 16
#: Tokens of a block at most (one text may exceed it alone).
BLOCK = 5_000_000
END = b"\n"
#: Tokens whose byte sequences are sorted together.
COUNTED = 200_000
_TAG = 56

_PARTS = "kind int, block long, at long, word binary, n long, ids binary, doc_id long, held_out boolean, tuned boolean"
_NAMES = ["kind", "block", "at", "word", "n", "ids", "doc_id", "held_out", "tuned"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
DOC, WORD, WINDOW = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7))
    return F.coalesce(remainder == 2, F.lit(False))


def tuning(doc_id: Column) -> Column:
    """One in TUNED of the training rows."""
    return ~held_out(doc_id) & doc_id.isNotNull() & (F.pmod(F.xxhash64(doc_id), F.lit(TUNED)) == 0)


def _batch(count: int, kind: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(count, kind, dtype=np.int32)
    made = [pa.array(columns[n], k) if n in columns else pa.nulls(count, k) for n, k in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=_NAMES)


def windows(stream: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number; the first ORDER bytes have none."""
    one = stream.astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-2] << np.uint64(16)) | two[4:]  # ORDER + 1 bytes


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other, each after ORDER end signs, and which bytes are scored."""
    lead = END * ORDER
    parts = [lead + b" ".join([*words, END]) for words in texts]
    stream = np.frombuffer(b"".join(parts), dtype=np.uint8)
    scored = np.ones(len(stream), dtype=bool)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    scored[(begin[:, None] + np.arange(ORDER)[None, :]).ravel()] = False
    return stream, scored


def count_windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts with their counts, sorted; a piece at a time, so that a sort stays in the cache."""
    found, held, size = NONE, [], 0
    for i, words in enumerate(texts):
        held.append(words)
        size += len(words)
        if size >= COUNTED or i == len(texts) - 1:
            stream, scored = laid_out(held)
            found = merged(found, _run_lengths(windows(stream)[scored[ORDER:]]))
            held, size = [], 0
    return found


def _run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


NONE = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


class _Block:
    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.docs, self.held, self.tuned, self.ids, self.tokens = [], [], [], [], 0
        #: of texts that the tree counts and of others: those not counted yet, their tokens, and counts of windows
        self.waiting, self.size, self.counts = ([], []), [0, 0], [NONE, NONE]

    def add(self, doc, held: bool, tuned: bool, words: list[bytes]) -> None:
        words.append(END)
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        words.pop()
        self.docs.append(doc)
        self.held.append(held)
        self.tuned.append(tuned)
        self.tokens += len(words) + 1
        unseen = held or tuned
        self.waiting[unseen].append(words)
        self.size[unseen] += len(words)
        if self.size[unseen] >= COUNTED:
            self.count(unseen)

    def count(self, unseen: bool) -> None:
        self.counts[unseen] = merged(self.counts[unseen], count_windows(self.waiting[unseen]))
        self.waiting[unseen].clear()
        self.size[unseen] = 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows of all texts, with their counts in the texts that the tree counts."""
        for unseen in (False, True):
            self.count(unseen)
        others = self.counts[True][0]
        return merged(self.counts[False], (others, np.zeros(len(others), dtype=np.int64)))

    def rows(self, name: int) -> Iterator[pa.RecordBatch]:
        train = [i for h, i in zip(self.held, self.ids, strict=True) if not h]
        counts = np.bincount(np.concatenate([*train, np.zeros(0, dtype=np.int32)]), minlength=len(self.numbers))
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(i.tobytes()) for i in self.ids]
        yield _batch(len(blobs), DOC, block=[name] * len(blobs), ids=blobs, doc_id=self.docs, held_out=self.held, tuned=self.tuned)
        at = np.arange(len(counts))
        yield _batch(len(counts), WORD, block=[name] * len(counts), at=at, word=list(self.numbers), n=counts)
        keys, n = self.windows()
        yield _batch(len(keys), WINDOW, block=[name] * len(keys), at=keys.view(np.int64), n=n)


def merged(a, b):
    """Sum of two count tables with sorted keys."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
    keys, counts = keys[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of numbered words, and of windows with their counts in the texts that the tree counts."""
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        for doc, held, tuned, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block.add(doc, held, tuned, (text or "").encode().lower().split())
            if block.tokens >= BLOCK:
                yield from block.rows(name)
                block, name = _Block(), name + 1
    if block.docs:
        yield from block.rows(name)


@dataclass
class Tree:
    """A small tree in memory, beside which `chances` is tested: states and pairs as sorted numbers
    (length, bytes), with log10 of g (the weight of the shorter state) and of P."""

    states: np.ndarray
    fallback: np.ndarray
    pairs: np.ndarray
    chances: np.ndarray

    def __post_init__(self):
        self.recent = np.full(1 << 20, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.answers = np.zeros(1 << 20)

    def __getstate__(self):
        return self.states, self.fallback, self.pairs, self.chances

    def __setstate__(self, state):
        self.states, self.fallback, self.pairs, self.chances = state
        self.__post_init__()

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def log10(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 P(last byte | longest suffix state of at most `order` bytes before it) of each window."""
        total, rest = np.full(len(keys), 0.0), np.arange(len(keys))
        for length in range(order, -1, -1):
            own = keys[rest]
            at, is_state = self._find(self.states, tagged(own >> np.uint64(8), length))
            place, known = self._find(self.pairs, tagged(own, length, 1))
            known &= is_state
            total[rest[known]] += self.chances[place[known]]
            passed = is_state & ~known
            total[rest[passed]] += self.fallback[at[passed]]
            rest = rest[~known]
        total[rest] -= np.log10(256)
        return total

    def remembered(self, keys: np.ndarray) -> np.ndarray:
        """The same for all states, by way of a table of windows met before."""
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        found = self.answers[slot]
        miss = np.flatnonzero(self.recent[slot] != keys)
        if len(miss):
            new, where = np.unique(keys[miss], return_inverse=True)
            value = self.log10(new)
            found[miss] = value[where]
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            self.recent[slot], self.answers[slot] = new, value
        return found


def tagged(keys: np.ndarray, length: int, more: int = 0) -> np.ndarray:
    """The last length + more bytes, with the length in front."""
    mask = np.uint64((1 << (8 * (length + more))) - 1)
    return (keys & mask) | np.uint64(length << _TAG)


def _mask(length: Column) -> Column:
    return F.element_at(F.array(*[F.lit((1 << (8 * d)) - 1) for d in range(ORDER + 2)]), length + 1)


def _bytes_mask(count: int) -> np.uint64:
    return np.uint64((1 << (8 * count)) - 1)


@dataclass
class Level:
    """Sequences of one length: sorted pairs (context and next byte) with counts, sorted contexts with totals."""

    pairs: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    owner: np.ndarray  # of each pair its context
    total: np.ndarray
    different: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, n: np.ndarray) -> Level:
        contexts, owner = np.unique(pairs >> np.uint64(8), return_inverse=True)
        total = np.bincount(owner, weights=n, minlength=len(contexts))
        return cls(pairs, n.astype(np.float64), contexts, owner, total, np.bincount(owner, weights=n > 0, minlength=len(contexts)))

    def cut(self, length: int) -> tuple[Level, np.ndarray]:
        """The level of contexts of `length` bytes, one less, and of each pair its place there."""
        pairs, place = np.unique(self.pairs & _bytes_mask(length + 1), return_inverse=True)
        return Level.of(pairs, np.bincount(place, weights=self.n, minlength=len(pairs))), place

    def diverging(self, shorter: Level, place: np.ndarray) -> np.ndarray:
        """Which contexts differ enough from those one byte shorter."""
        met = np.flatnonzero(self.n > 0)
        n, inner = self.n[met], place[met]
        gain = n * np.log2(n * shorter.total[shorter.owner[inner]] / (self.total[self.owner[met]] * shorter.n[inner]))
        sums = np.bincount(self.owner[met], weights=gain, minlength=len(self.contexts))
        return (self.total >= LEAST) & (sums > BITS * self.different)


def _with_suffixes(state: np.ndarray, longer: Level, longer_state: np.ndarray, own: Level, length: int) -> np.ndarray:
    """States of a level and the suffixes of longer ones."""
    out = state.copy()
    out[np.searchsorted(own.contexts, longer.contexts[longer_state] & _bytes_mask(length))] = True
    return out


class Short:
    """Contexts of two bytes and less over all training texts."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        order = np.argsort(pairs)
        two = Level.of(pairs[order], n[order])
        one, self.to_one = two.cut(1)
        root, self.to_root = one.cut(0)
        self.two, self.one, self.root = two, one, root

    def chances(self, ends: np.ndarray) -> np.ndarray:
        """P(byte | longest state of at most two bytes) of each pair of the second level; `ends` of longer states are states."""
        two, one, root = self.two, self.one, self.root
        second = two.diverging(one, self.to_one)
        second[np.searchsorted(two.contexts, ends)] = True
        first = _with_suffixes(one.diverging(root, self.to_root), two, second, one, 1)
        found = (root.n + K / 256) / (root.total[root.owner] + K)
        for level, state, place in ((one, first, self.to_root), (two, second, self.to_one)):
            below = found[place]
            own = (level.n + K * below) / (level.total[level.owner] + K)
            found = np.where(state[level.owner], own, below)
        return found


def linear_chances(grams: np.ndarray, n: np.ndarray, short: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups of sorted windows: offset and slope of their chances over those under two bytes of context,
    and the last two bytes of the states."""
    levels, places = {ORDER: Level.of(grams, n)}, {}
    for d in range(ORDER - 1, 2, -1):
        levels[d], places[d + 1] = levels[d + 1].cut(d)
    places[3] = np.searchsorted(short.pairs, levels[3].pairs & _bytes_mask(3))
    state, longer = {}, None
    for d in range(ORDER, 2, -1):
        state[d] = levels[d].diverging(levels[d - 1] if d > 3 else short, places[d])
        if longer is not None:
            state[d] = _with_suffixes(state[d], longer, state[d + 1], levels[d], d)
        longer = levels[d]
    offset, slope = np.zeros(len(levels[3].pairs)), np.ones(len(levels[3].pairs))
    for d in range(3, ORDER + 1):
        level = levels[d]
        if d > 3:
            offset, slope = offset[places[d]], slope[places[d]]
        kept = np.where(state[d][level.owner], K / (level.total[level.owner] + K), 1.0)
        own = np.where(state[d][level.owner], level.n / (level.total[level.owner] + K), 0.0)
        offset, slope = own + kept * offset, kept * slope
    return offset, slope, np.unique(levels[3].contexts[state[3]] & _bytes_mask(2))


#: Windows of whole groups that are worked on together (a group has 2^24 at most).
TOGETHER = 500_000


def _linear(shared):
    """(gram, offset, slope) of windows that come in order of the last three bytes of their contexts, and rows of `ends`."""

    def made(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        offset, slope, ends = linear_chances(grams, n, shared.value)
        none = np.zeros(len(ends))
        columns = [
            pa.array(np.concatenate([grams.view(np.int64), np.zeros(len(ends), dtype=np.int64)])),
            pa.array(np.concatenate([offset, none])),
            pa.array(np.concatenate([slope, none])),
            pa.concat_arrays([pa.nulls(len(grams), pa.int64()), pa.array(ends.astype(np.int64))]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "offset", "slope", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            grams = np.concatenate([grams, batch.column(0).to_numpy().view(np.uint64)])
            n = np.concatenate([n, batch.column(1).to_numpy()])
            if len(grams) >= TOGETHER:
                group = (grams >> np.uint64(8)) & _bytes_mask(3)
                whole = int((group != group[-1]).sum())  # the last group may go on
                if whole:
                    yield made(grams[:whole], n[:whole])
                    grams, n = grams[whole:], n[whole:]
        if len(grams):
            yield made(grams, n)

    return run


def _logs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chance = shared.value
        for batch in batches:
            grams, offset, slope = (c.to_numpy() for c in batch.columns[:3])
            below = chance[np.searchsorted(pairs, grams.view(np.uint64) & _bytes_mask(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(offset + slope * below))], names=["gram", "log"])

    return run


def priced(grams: DataFrame) -> DataFrame:
    """(gram, log): log10 P(last byte | longest suffix state before it) of all windows (gram, n)."""
    spark = grams.sparkSession
    grams = scratch.stage(grams, "windows")
    short = grams.groupBy(F.col("gram").bitwiseAND((1 << 24) - 1).alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    known = Short(short["pair"].to_numpy(dtype=np.int64).view(np.uint64), short["n"].to_numpy(dtype=np.int64))
    level = spark.sparkContext.broadcast(known.two)
    group = F.shiftright("gram", 8).bitwiseAND((1 << 24) - 1)
    dealt = grams.withColumn("_group", group).repartition("_group").sortWithinPartitions("_group").select("gram", "n")
    found = scratch.stage(dealt.mapInArrow(_linear(level), "gram long, offset double, slope double, ends long"), "linear")
    # two bytes: 65,536 rows at most
    ends = np.array([r["ends"] for r in found.where(F.col("ends").isNotNull()).select("ends").distinct().collect()], dtype=np.uint64)
    shared = spark.sparkContext.broadcast((known.two.pairs, known.chances(ends)))
    return found.where(F.col("ends").isNull()).mapInArrow(_logs(shared), "gram long, log double")


def grow(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states: length, context, total), (pairs of states: length, context, pair, n) from (gram, n)."""
    states, table = _grown(grams)
    return states, table.join(states, ["length", "context"]).where("n > 0")


def _grown(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states), (all pairs: length, context, pair, n); those of n = 0 are in no training text."""
    lengths = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("length")
    cut = grams.select("gram", "n", lengths).select("length", F.col("gram").bitwiseAND(_mask(F.col("length") + 1)).alias("pair"), "n")
    table = cut.groupBy("length", "pair").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("pair", 8))
    table = scratch.stage(table, "pairs")
    totals = scratch.stage(table.groupBy("length", "context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("different")), "totals")
    frequent = totals.where((F.col("length") > 0) & (F.col("total") >= LEAST))
    shorter = table.select((F.col("length") + 1).alias("length"), F.col("pair").alias("inner"), F.col("n").alias("inner_n"))
    inner = totals.select((F.col("length") + 1).alias("length"), F.col("context").alias("outer"), F.col("total").alias("outer_total"))
    compared = (
        table.where("n > 0")
        .join(frequent, ["length", "context"])
        .withColumn("inner", F.col("pair").bitwiseAND(_mask(F.col("length"))))
        .withColumn("outer", F.shiftright("inner", 8))
        .join(shorter, ["length", "inner"])
        .join(inner, ["length", "outer"])
    )
    gain = F.col("n") * F.log2(F.col("n") * F.col("outer_total") / (F.col("total") * F.col("inner_n")))
    tested = compared.groupBy("length", "context", "different").agg(F.sum(gain).alias("gain"))
    passed = tested.where(F.col("gain") > BITS * F.col("different")).select(
        F.explode(F.sequence(F.lit(0), F.col("length"))).alias("length"), "context"
    )
    closed = passed.select("length", F.col("context").bitwiseAND(_mask(F.col("length"))).alias("context"))
    root = totals.where("length = 0").select("length", "context")
    states = totals.join(closed.unionByName(root).distinct(), ["length", "context"]).select("length", "context", "total")
    return scratch.stage(states, "states"), table


def chances(states: DataFrame, table: DataFrame) -> DataFrame:
    """(gram, log): log10 P(last byte | longest suffix state before it) of all windows, a join for each length."""
    known = None
    for length in range(ORDER + 1):
        own = table.where(F.col("length") == length).select("context", "pair", "n")
        if known is None:
            own = own.withColumn("below", F.lit(1 / 256))
        else:
            own = own.withColumn("inner", F.col("pair").bitwiseAND(_mask(F.lit(length)))).join(known, "inner")
        level = states.where(F.col("length") == length).select("context", "total")
        chance = (F.col("n") + K * F.col("below")) / (F.col("total") + K)
        found = own.join(level, "context", "left").select("pair", F.coalesce(chance, F.col("below")).alias("below"))
        known = found.withColumnRenamed("pair", "inner")
    return known.select(F.col("inner").alias("gram"), F.log10("below").alias("log"))


def compiled(states: DataFrame, pairs: DataFrame) -> Tree:
    """A small tree in arrays."""
    s = states.select("length", "context", "total").toPandas()
    p = pairs.select("length", "context", "pair", "n").toPandas()

    def keys(frame, column: str) -> np.ndarray:
        return frame[column].to_numpy(dtype=np.int64).view(np.uint64) | (frame["length"].to_numpy(dtype=np.uint64) << np.uint64(_TAG))

    names = keys(s, "context")
    order = np.argsort(names)
    names, total = names[order], s["total"].to_numpy(dtype=np.float64)[order]
    pair, n = keys(p, "pair"), p["n"].to_numpy(dtype=np.float64)
    owner = np.searchsorted(names, keys(p, "context"))
    kept = np.bincount(owner, weights=n, minlength=len(names))
    fallback = (K + total - kept) / (K + total)
    order = np.argsort(pair)
    pair, n, owner = pair[order], n[order], owner[order]
    tree = Tree(names, np.log10(fallback), pair, np.zeros(len(pair)))
    length = (pair >> np.uint64(_TAG)).astype(np.int64)
    for level in range(ORDER + 1):
        own = np.flatnonzero(length == level)
        below = tree.log10(pair[own] & np.uint64((1 << _TAG) - 1), level - 1)
        tree.chances[own] = np.log10(n[own] / (total[owner[own]] + K) + fallback[owner[own]] * 10**below)
    return tree


_SCORES = (
    "doc_id long, held_out boolean, tuned boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "_scores array<double>, _left_out array<double>"
)
#: Bytes that are scored at once.
PIECE = 500_000


def blended(tree: np.ndarray, share: np.ndarray, weight: float, chance: np.ndarray | None = None) -> np.ndarray:
    """log10 of weight * share + (1 - weight) * 10^tree; `chance` is 10^tree if it is known already."""
    chance = 10.0**tree if chance is None else chance
    total = weight * share + (1 - weight) * chance
    lost = total < 1e-300  # too small to be written as a number
    found = np.log10(np.where(lost, 1.0, total))
    found[lost] = tree[lost] + np.log10(1 - weight)
    return found


class Known:
    """Values of sorted windows, found by a table of slots, or by search where two share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(10, (2 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def spelled(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as they stand in a text, each with the blank behind it (none behind an end), then the signs in front of
    a text; where each begins, and its bytes."""
    plain = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.binary())
    _, at, data = plain.buffers()
    at = np.frombuffer(at, dtype=np.int32)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    lengths = np.diff(at).astype(np.int64)
    is_end = (lengths == 1) & (data[np.minimum(at[:-1] - at[0], max(len(data) - 1, 0))] == END[0]) if len(plain) else lengths == 1
    sizes = np.append(lengths + ~is_end, ORDER)
    begins = np.cumsum(sizes) - sizes
    letters = np.full(sizes.sum(), ord(" "), dtype=np.uint8)
    letters[begins[-1] :] = END[0]
    letters[np.repeat(begins[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(data))] = data
    return letters, begins, sizes


def _score(train_tokens: int, different: int):
    rarity = np.log10(float(train_tokens + different + 1))

    def run(parts: pa.Table, docs: pa.Table) -> pa.Table:
        is_word = pc.is_valid(parts.column("word"))
        words, known = parts.filter(is_word), parts.filter(pc.invert(is_word))
        keys = known.column("at").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tree = Known(keys[order], known.column("value").to_numpy()[order])
        order = np.argsort(words.column("at").to_numpy())
        count = words.column("value").to_numpy()[order].astype(np.int64)
        letters, begins, sizes = spelled(words.column("word").take(pa.array(order)))
        lead = len(sizes) - 1
        del keys, order, words, known, is_word
        logs = np.log10(count + 1.0)
        rows = [], [], [], [], []
        tuned = docs.column("tuned").to_numpy()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            ids = np.concatenate([np.concatenate([[lead], i]) for i in held])
            lengths = sizes[ids]
            ends = np.cumsum(lengths)
            stream = letters[np.repeat(begins[ids] - (ends - lengths), lengths) + np.arange(ends[-1])]
            scored = np.repeat(ids != lead, lengths)
            values = np.zeros(len(stream))
            values[scored] = tree[windows(stream)[scored[ORDER:]]]
            token = ids != lead
            chance = np.add.reduceat(values, ends - lengths)[token]
            own = count[ids[token]]
            begin = np.cumsum([0, *map(len, held[:-1])])
            total, plain = max(train_tokens, 1), 10.0**chance
            share = own / total
            mixed = [np.add.reduceat(blended(chance, share, w, plain), begin) for w in WEIGHTS]
            rows[3].extend(np.array(mixed).T.tolist())
            # of tokens that are left out of their own counts
            marks = tuned[len(rows[4]) : len(rows[4]) + len(held)]
            which = np.repeat(marks, [len(i) for i in held])
            alone = np.zeros((len(WEIGHTS), len(held)))
            if which.any():
                starts = np.cumsum([0, *(len(i) for i, t in zip(held, marks, strict=True) if t)])[:-1]
                less = np.maximum(own[which] - 1, 0) / total
                alone[:, marks] = [np.add.reduceat(blended(chance[which], less, w, plain[which]), starts) for w in WEIGHTS]
            rows[4].extend(alone.T.tolist())

        unpack = zstandard.ZstdDecompressor().decompress
        for blob in docs.column("ids").to_pylist():
            ids = np.frombuffer(unpack(blob), dtype=np.int32)
            rows[0].append(len(ids))
            rows[1].append(int((count[ids] > 0).sum()))
            rows[2].append(float(logs[ids].sum() - rarity * len(ids)))
            held.append(ids)
            size += int(sizes[ids].sum())
            if size >= PIECE:
                flush()
                held, size = [], 0
        if held:
            flush()
        found = dict(zip(("n_tokens", "n_known", "base_score", "_scores", "_left_out"), rows, strict=True))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "tuned": docs.column("tuned"),
                "n_tokens": pa.array(found["n_tokens"], pa.int64()),
                "n_known": pa.array(found["n_known"], pa.int64()),
                "train_tokens": pa.array([train_tokens] * docs.num_rows, pa.int64()),
                "base_score": pa.array(found["base_score"], pa.float64()),
                "_scores": pa.array(found["_scores"], pa.list_(pa.float64())),
                "_left_out": pa.array(found["_left_out"], pa.list_(pa.float64())),
            }
        )

    return run


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    bounded(spark)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), F.coalesce(tuning(doc), F.lit(False)).alias("tuned"), F.col(text))
    path = scratch.folder(spark, "blocks")
    rows.mapInArrow(_split, _PARTS).write.partitionBy("kind").parquet(path)
    parts = spark.read.schema(_PARTS).parquet(path)
    wide = width(docs)
    # each is dealt by its key once, for the sums as well as for the way back to the blocks
    words = parts.where(F.col("kind") == WORD).select("block", "at", "word", "n").repartition(wide, "word")
    words = scratch.stage_by(words, "words", "word", wide, "word")
    scratch.drop(spark, f"{path}/kind={WORD}")
    met = parts.where(F.col("kind") == WINDOW).select("block", F.col("at").alias("gram"), "n").repartition(wide, "gram")
    met = scratch.stage_by(met, "windows", "gram", wide, "gram")
    scratch.drop(spark, f"{path}/kind={WINDOW}")
    counts = words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    train_tokens, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = priced(met.groupBy("gram").agg(F.sum("n").alias("n")))
    nothing = F.lit(None).cast("binary").alias("word")
    own = met.join(known, "gram").select("block", F.col("gram").alias("at"), nothing, F.col("log").alias("value"))
    found = words.join(counts, "word", "left").select("block", "at", "word", F.coalesce("c", F.lit(0)).cast("double").alias("value"))
    looked_up = found.unionByName(own)
    texts = parts.where(F.col("kind") == DOC).select(F.col("block").alias("own"), "doc_id", "held_out", "tuned", "ids")
    blocks = looked_up.groupBy("block").cogroup(texts.groupBy("own"))
    scored = scratch.stage(blocks.applyInArrow(_score(train_tokens, different), _SCORES), "scores")
    sums = [F.sum(F.get("_left_out", F.lit(i))) for i in range(len(WEIGHTS))]
    likely = [-np.inf if v is None else v for v in scored.where("tuned").agg(*sums).first()]
    best = int(np.argmax(likely))
    return scored.withColumn("score", F.get("_scores", F.lit(best))).drop("_scores", "_left_out", "tuned")

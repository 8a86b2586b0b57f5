"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: words at its holes are ignored, so a hash still meets
when one of them was exchanged. Every position of the benchmark items and of the documents is hashed
under each mask, equal hashes are joined, and around each hit the two texts are laid side by side. A
document holds an item if some window of WINDOW words agrees in SHARE of them or more; an item of
fewer words must agree in all of them. The three masks meet any window with two exchanged
words, wherever they stand (tested).

Hashes of documents that no item has are dropped early by a bit field of the items' hashes. Its size
follows their number up to FIELD_BITS bits (2 MB), which is what each task gets; beyond, it lets more
pass, and the join decides in any case. Of a document only the words around a hit travel.

Defined results: null and empty texts hold nothing; items of fewer than SHORTEST words are not looked
for; repeated documents or items with the same id give one row; empty tables give no rows; null ids
are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floeline.llm import words
from floeline.llm.batches import bounded
from floeline.sources import scratch

# fixed values: the positions that each mask looks at
MASKS = ((0, 3, 4, 5, 7, 8, 9), (0, 1, 2, 4, 7, 8, 9), (0, 1, 2, 4, 5, 6, 8))
WINDOW = 13
SHARE = 0.8
SHORTEST = 5
FIELD_BITS = 1 << 24
#: Words kept on either side of a hit: a window that holds the hit reaches no further.
AROUND = WINDOW


def masks_for(short: list[int]) -> list[tuple[int, ...]]:
    """The spaced masks, and for items too short for them a mask over the whole item."""
    return [*MASKS, *(tuple(range(n)) for n in sorted(set(short)))]


def seeds(tokens: np.ndarray, masks) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their positions, under all masks."""
    parts = [words.combined(tokens, mask, salt) for salt, mask in enumerate(masks, 1)]
    return np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])


def needed(item_words: int) -> int:
    """Equal words that a window needs; a short item must agree as a whole."""
    return int(np.ceil(SHARE * WINDOW)) if item_words >= WINDOW else item_words


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the item, words, equal words) of all qualifying windows when item[i] lies on doc[i + shift]."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if last - first < width:
        return None
    same = np.zeros(last - first + 1, dtype=np.int64)
    same[1:] = np.cumsum(item[first:last] == doc[first + shift : last + shift])
    good = np.flatnonzero(same[width:] - same[:-width] >= needed(len(item)))
    if not len(good):
        return None
    start, stop = int(good[0]), int(good[-1]) + width
    return first + start, stop - start, int(same[stop] - same[start])


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, texts = batch.columns
        tokens = [_as_long(words.hashes(t)).tolist() for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([items, pa.array(tokens, pa.list_(pa.int64()))], names=["_item", "_item_words"])


def _item_seeds(masks):
    """Seeds of each item; one that is too short for the spaced masks has a single seed over all its words."""
    spaced = [(mask, salt) for salt, mask in enumerate(masks, 1) if mask in MASKS]
    whole = {len(mask): (mask, salt) for salt, mask in enumerate(masks, 1) if mask not in MASKS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.array(listed, dtype=np.int64).view(np.uint64)
                own = spaced if len(tokens) >= WINDOW else [whole[len(tokens)]]
                parts = [words.combined(tokens, mask, salt) for mask, salt in own]
                found, at = np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])
                columns = [pa.array([key] * len(found), pa.int64()), pa.array(_as_long(found)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_hash", "_at"])

    return run


_HITS = "_doc long, _from int, _words array<long>, _hits array<struct<hash:long,at:int>>"


def _slots(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return found & mask, (found >> np.uint64(32)) & mask


def _hit_rows(masks, field, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(field.value, dtype=np.uint64)

        def has(slot: np.ndarray) -> np.ndarray:
            return (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words.hashes(text)
                found, at = seeds(tokens, masks)
                one, two = _slots(found, bits)
                passed = np.flatnonzero(has(one))
                passed = passed[has(two[passed])]
                if len(passed):
                    rows += _regions(doc, tokens, found[passed], at[passed])
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_doc", "_from", "_words", "_hits"]
            )

    return run


#: Words of one region at most; a longer run of hits is dealt out over several, each with its own surroundings.
REGION = 2000


def _regions(doc, tokens: np.ndarray, found: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Hits whose surroundings touch share a region of words."""
    order = np.argsort(at, kind="stable")
    found, at = found[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] - at[:-1] > 2 * AROUND) | (at[1:] // REGION != at[:-1] // REGION)
    bounds = [*np.flatnonzero(new).tolist(), len(at)]
    rows = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        since, until = max(0, int(at[a]) - AROUND), int(at[b - 1]) + 2 * AROUND
        hits = [{"hash": h, "at": p} for h, p in zip(_as_long(found[a:b]).tolist(), at[a:b].tolist(), strict=True)]
        rows.append((doc, since, _as_long(tokens[since:until]).tolist(), hits))
    return rows


_OVERLAPS = "doc_id long, item_id long, first_word long, n_words long, n_equal long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            doc, item = np.array(row["_words"]), np.array(row["_item_words"])
            for shift in row["_shifts"]:
                hit = best_overlap(doc, item, shift - row["_from"])
                if hit:
                    rows.append((row["_doc"], row["_item"], hit[0] + shift, hit[1], hit[2]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        names = ["doc_id", "item_id", "first_word", "n_words", "n_equal"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def bit_field(hashes: DataFrame, column: str) -> tuple[bytes, int]:
    """A bit field of the hashes, 64 bits or more for each up to FIELD_BITS in all; at most 2 MB come to the driver."""
    count = hashes.select(F.approx_count_distinct(column)).first()[0]
    bits = 1 << 12
    while bits < min(FIELD_BITS, 64 * count):
        bits *= 2
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1))
    slots = hashes.select(F.explode(F.array(low, high)).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    filled = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("set"))
    field = np.zeros(bits // 64, dtype=np.int64)
    for row in filled.toLocalIterator():
        field[row["at"]] = row["set"]
    return field.tobytes(), bits


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, and of the longest overlap its first word in the document, words and equal words."""
    spark: SparkSession = docs.sparkSession
    bounded(spark)
    read = items.select(F.col("item_id").cast("long").alias("_item"), F.col(text)).mapInArrow(
        _item_words, "_item long, _item_words array<long>"
    )
    read = read.where(F.size("_item_words") >= SHORTEST).withColumn("_key", F.xxhash64("_item", "_item_words"))
    listed = scratch.stage(read.dropDuplicates(["_key"]), "items")
    size = F.size("_item_words")
    short = listed.where(size < WINDOW).select(size.alias("n")).distinct()  # WINDOW - SHORTEST rows at most
    masks = masks_for([row["n"] for row in short.collect()])
    known = scratch.stage(
        listed.select("_key", "_item_words").mapInArrow(_item_seeds(masks), "_key long, _hash long, _at int"), "seeds"
    )
    field, bits = bit_field(known, "_hash")
    shared = spark.sparkContext.broadcast(field)
    found = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col(text)).mapInArrow(_hit_rows(masks, shared, bits), _HITS)
    regions = scratch.stage(found.withColumn("_region", F.xxhash64("_doc", "_from", "_words")), "regions")
    hits = regions.select("_region", F.inline("_hits")).withColumnsRenamed({"hash": "_hash", "at": "_place"})
    shifts = (
        hits.join(known, "_hash")
        .select("_region", "_key", (F.col("_place") - F.col("_at")).alias("_shift"))
        .groupBy("_region", "_key")
        .agg(F.collect_set("_shift").alias("_shifts"))
    )
    texts = regions.select("_region", "_doc", "_from", "_words").dropDuplicates(["_region"])
    sides = shifts.join(texts, "_region").join(listed, "_key")
    checked = sides.select("_doc", "_item", "_from", "_words", "_item_words", "_shifts").mapInArrow(_verify, _OVERLAPS)
    best = F.max_by(F.struct("first_word", "n_words", "n_equal"), F.struct("n_words", "n_equal", -F.col("first_word")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns; rows without an id are judged by their own text."""
    own = F.xxhash64("doc_id", F.col(text))
    bad = overlaps(docs.select(own.alias("doc_id"), F.col(text)), items, text).select(F.col("doc_id").alias("_bad"))
    return docs.join(bad.distinct(), own == F.col("_bad"), "left_anti")

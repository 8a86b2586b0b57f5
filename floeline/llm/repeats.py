"""Repeated passages across a corpus: maximal repeats from suffix arrays over small groups of contexts.

Texts are UTF-8 bytes; a repeat has at least LENGTH bytes and never crosses documents.

1. Anchors. In every LENGTH bytes the grams of GRAM bytes with the smallest hash are anchors, so two equal
   strings of LENGTH bytes share an anchor at the same place. The context of an anchor is every byte
   that a string of LENGTH bytes around it can reach.
2. Places whose anchor and whole context are equal form a class. All of a class but its first place
   repeat the whole context, so only first places go on; a task settles its own classes before the
   shuffle, so that a passage in a third of all documents is a row per task. A class whose anchor no
   other class shares together with HALF bytes to its left or right ends here; most do, a common short
   line among them.
3. The other classes are joined with their texts, which gives their contexts; these go, by anchor, to
   one group. An enhanced suffix array (suffixes sorted, common prefixes of neighbours) of the group is
   scanned with a stack; each interval of the tree of common prefixes whose places differ in the byte to
   the left (or start a context) is a maximal repeat, given out with all its places (those of the longer
   repeats inside it by reference). A repeat that is longer than a context comes out as a chain of such
   groups, one for each anchor along it.
4. Groups of more than HOT classes (a common line between ever different neighbours) are parted by the
   bytes that lie before the anchor in a string of LENGTH bytes, 0 to BEFORE: all strings of a range of
   these share a core around the anchor, and a class goes on in a range only with the classes of the
   same core. Cores of more than HOT classes are parted again, down to single strings. Only counts of
   cores are shuffled for that; a class that shares no core ends here, and places that are equal over
   all strings of a range are settled within the task first.

Order is that of (doc_id, start). Hashes that decide have 128 bits; inside groups bytes are compared.

Defined results: null and empty texts have no repeats. A null id counts as the smallest. Rows with
the same id are one document: the same place in two of them is not earlier than itself, so equal rows
are both kept, and if their texts differ, what is cut from one is cut from the other. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.llm.decontamination import bit_field
from floeline.llm.words import mix
from floeline.sources import scratch

LENGTH = 100
GRAM = 24
#: A string of LENGTH bytes around an anchor has so many bytes on one side of it at least.
HALF = (LENGTH - GRAM) // 2
BEFORE = LENGTH - GRAM
CONTEXT = BEFORE + LENGTH
HOT = 8_000
#: Ranges into which that of a hot group is parted.
FAN = 3
#: A class has the bytes before and behind its anchor in so many bits, above them bits of a hash of its text.
REACH_BITS = 15
TEXT_BITS = 16
#: Bytes that are hashed at once, and anchors that a task holds before it settles them.
PIECE = 1_000_000
HELD = 1_000_000
#: Rows of meeting classes that are looked at together.
MEET = 300_000
#: Contexts whose suffixes are sorted together.
CHUNK = 1000
#: Stands for a null id.
NO_ID = -(2**63)

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(_BASE, exponent, 2**64))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbouring bytes along the last axis."""
    level, width, done, total = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    count = data.shape[-1] - size + 1
    rest = size
    while True:
        if rest & 1:
            part = level[..., done : done + count]
            total = part if total is None else total * _power(width) + part
            done += width
        rest >>= 1
        if not rest:
            return mix(total)
        level = level[..., :-width] * _power(width) + level[..., width:]
        width *= 2


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """`best` over each `size` neighbours."""
    width = 1
    while 2 * width <= size:
        values = best(values[:-width], values[width:])
        width *= 2
    return best(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(index of the text, place, anchor hash, context hash, bytes of the context before and behind as b * 256 + a, halves)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    grams = window_hashes(data, GRAM)
    rough = (grams >> np.uint64(32)).astype(np.uint32)
    least = _sliding(rough, LENGTH - GRAM + 1, np.minimum)
    valid = np.arange(len(least)) + LENGTH <= ends[owner[: len(least)]]
    # an anchor is the least gram of some string that lies in one text; 0 can't be told from "none" and is left to ties
    least = np.where(valid, np.maximum(least, 1), 0)
    pad = np.zeros(BEFORE, dtype=np.uint32)
    most = _sliding(np.concatenate([pad, least, pad]), BEFORE + 1, np.maximum)
    at = np.flatnonzero((most[: len(rough)] == np.maximum(rough, 1)) & (most[: len(rough)] > 0))
    text = owner[at]
    begin = ends[text] - sizes[text]
    place = at - begin
    before, after = np.minimum(place, BEFORE), np.minimum(ends[text] - at, LENGTH)
    context = np.zeros(len(at), dtype=np.uint64)
    full = (before == BEFORE) & (after == LENGTH)
    inner = at[full] - BEFORE
    total = np.full(len(inner), CONTEXT, dtype=np.uint64)
    for offset in [*range(0, CONTEXT - GRAM, GRAM), CONTEXT - GRAM]:
        total = total * _STEP + grams[inner + offset]
    context[full] = mix(total)
    edge = np.flatnonzero(~full)
    raw = data.tobytes()
    context[edge] = [
        xxhash.xxh3_64_intdigest(raw[a - b : a + c], seed=b * 256 + c)
        for a, b, c in zip(at[edge].tolist(), before[edge].tolist(), after[edge].tolist(), strict=True)
    ]
    return text, place, grams[at], context, before * 256 + after, _halves(grams, at, before, after)


def _halves(grams: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """32-bit hashes of the HALF bytes on the left and on the right of an anchor, 0 where there are fewer."""
    last = len(grams) - 1

    def one(start: np.ndarray, there: np.ndarray) -> np.ndarray:
        a, b = np.clip(start, 0, last), np.clip(start + HALF - GRAM, 0, last)
        mixed = mix(grams[a] * _STEP + grams[b]) >> np.uint64(32)
        return np.where(there, np.maximum(mixed, 1), 0)

    left, right = one(at - HALF, before >= HALF), one(at + GRAM, after >= GRAM + HALF)
    return ((left << np.uint64(32)) | right).view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, bits of the hashes of the texts, texts) of a batch, about PIECE bytes at a time."""
    ids, texts, held, size = batch.column(0).to_numpy(), batch.column(2).to_pylist(), [], 0
    bits = batch.column(1).to_numpy()
    start = 0
    for i, text in enumerate(texts):
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= PIECE or i == len(texts) - 1:
            yield ids[start : i + 1], bits[start : i + 1], held
            held, size, start = [], 0, i + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any key."""
    first = np.ones(len(keys[0]), dtype=bool)
    first[1:] = False
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return first


def _repeated(first: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of a sorted table that stand behind the first place of their class (the same place again does not count)."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (doc != doc[head]) | (place != place[head])


_CLASSES = "anchor long, context long, doc long, place long, reach int, halves long"


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _class_batch(*columns) -> pa.RecordBatch:
    return _table(["anchor", "context", "doc", "place", "reach", "halves"], *columns)


def _span(place: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    reach = reach & ((1 << REACH_BITS) - 1)
    before = reach // 256
    return place - before, before + reach % 256


def _united(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a document that touch become one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + length)[order]
    if not len(doc):
        return doc, start, length
    rank = np.cumsum(_new(doc)) - 1
    far = int(stop.max()) + 2
    reached = np.maximum.accumulate(stop + rank * far)
    first = np.ones(len(doc), dtype=bool)
    first[1:] = start[1:] + rank[1:] * far > reached[:-1]
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reached[ends] - rank[ends] * far - start[at]


def _settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """First places of the classes of a task, and without an anchor the spans of all other places."""
    doc, place, anchor, context, reach, halves = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((place, doc, context, anchor))
    doc, place, anchor, context, reach, halves = (v[order] for v in (doc, place, anchor, context, reach, halves))
    first = _new(anchor, context)
    again = _repeated(first, doc, place)
    yield _class_batch(
        _signed(anchor[first]), _signed(context[first]), doc[first], place[first], reach[first].astype(np.int32), halves[first]
    )
    where, start, length = _united(doc[again], *_span(place[again], reach[again]))
    zero = np.zeros(len(where), dtype=np.int64)
    yield _class_batch(pa.nulls(len(where), pa.int64()), zero, where, start, pa.nulls(len(where), pa.int32()), length)


def _find_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for ids, bits, texts in _pieces(batch):
            text, place, anchor, context, reach, halves = anchors(texts)
            held.append((ids[text], place, anchor, context, reach | (bits[text] << REACH_BITS), halves))
            size += len(text)
            if size >= HELD:
                yield from _settle(held)
                held, size = [], 0
    if held:
        yield from _settle(held)


_MEETING = "anchor long, doc long, place long, reach int, length long"


def _meeting(*columns) -> pa.RecordBatch:
    return _table(["anchor", "doc", "place", "reach", "length"], *columns)


def _shared(group: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Rows whose half some other row of the group has too."""
    key = mix(group.astype(np.uint64) * _STEP + half)
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    return (count[where] > 1) & (half > 0)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, context, doc, place): spans of repeated contexts, and first places of classes that may share more.

    Rows are looked at in chunks that end with an anchor. Only an anchor of more rows than a chunk is
    cut; its classes then all go on, and the last class is carried over.
    """
    carried = None  # anchor, context, doc and place of the first row of the last class, if its anchor goes on

    def look(rows: list[np.ndarray], part: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried
        anchor, context, doc, place, reach, halves = rows
        new, group = _new(anchor, context), np.cumsum(_new(anchor))
        part = part or (carried is not None and carried[0] == anchor[0])
        head_doc, head_place = doc, place
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        head_doc, head_place = doc[head], place[head]
        if carried is not None and carried[:2] == (anchor[0], context[0]):
            own = head == 0
            head_doc, head_place = np.where(own, carried[2], head_doc), np.where(own, carried[3], head_place)
            new[0] = False
        again = (doc != head_doc) | (place != head_place)
        at = np.flatnonzero(new)
        packed = halves[at].view(np.uint64)
        goes_on = _shared(group[at], packed >> np.uint64(32)) | _shared(group[at], packed & np.uint64(0xFFFFFFFF))
        out = at if part else at[goes_on]
        carried = (anchor[-1], context[-1], head_doc[-1], head_place[-1])
        yield _meeting(anchor[out], doc[out], place[out], reach[out], pa.nulls(len(out), pa.int64()))
        where, start, length = _united(doc[again], *_span(place[again], reach[again].astype(np.int64)))
        yield _meeting(pa.nulls(len(where), pa.int64()), where, start, pa.nulls(len(where), pa.int32()), length)

    held: list[np.ndarray] | None = None
    for batch in batches:
        gone = batch.filter(pa.compute.is_null(batch.column(0)))
        if gone.num_rows:  # spans on their way
            none = pa.nulls(gone.num_rows, pa.int64()), pa.nulls(gone.num_rows, pa.int32())
            yield _meeting(none[0], gone.column(2), gone.column(3), none[1], gone.column(5))
        batch = batch.filter(pa.compute.is_valid(batch.column(0)))
        if not batch.num_rows:
            continue
        rows = [np.asarray(c) for c in batch.columns]
        held = rows if held is None else [np.concatenate(v) for v in zip(held, rows, strict=True)]
        if len(held[0]) >= MEET:
            cut_at = int(np.searchsorted(held[0], held[0][-1]))
            part = cut_at == 0
            cut_at = len(held[0]) if part else cut_at
            yield from look([v[:cut_at] for v in held], part)
            held = [v[cut_at:] for v in held] if cut_at < len(held[0]) else None
    if held is not None and len(held[0]):
        yield from look(held, False)


#: Without an anchor a row is a span of `before` bytes, without a body the start of a string of LENGTH bytes.
_CONTEXTS = "anchor long, window long, doc long, place long, before int, body binary"


def _passes(field: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    mask = np.uint64(bits - 1)
    found = np.ones(len(key), dtype=bool)
    for slot in (key & mask, (key >> np.uint64(32)) & mask):
        found &= (field[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return found


def _ranges(low: int, high: int) -> list[tuple[int, int]]:
    """The ranges into which that of low to high is parted."""
    ends = [low + (high - low + 1) * i // FAN for i in range(FAN + 1)]
    return [(a, b - 1) for a, b in zip(ends, ends[1:]) if a < b]


def _hashed(bodies: list[bytes], start: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    found = (xxhash.xxh3_64_intdigest(b[i:j], seed=seed) for b, i, j in zip(bodies, start.tolist(), stop.tolist(), strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(bodies))


def _cores(anchor: np.ndarray, before: np.ndarray, bodies: list[bytes], hot: np.ndarray) -> Iterator[tuple]:
    """(depth, rows, keys of the cores, keys of all bytes, bytes before the anchor in the first and last string) of each range.

    Rows are those whose core in the range around is hot and which have a string of the range.
    """
    after = np.array([len(b) for b in bodies], dtype=np.int64) - before

    def run(rows: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple]:
        for a, b in _ranges(low, high):
            least, most = np.maximum(a, LENGTH - after[rows]), np.minimum(b, before[rows])
            some = least <= most
            inner, least, most = rows[some], least[some], most[some]
            if not len(inner):
                continue
            own, mid, seed = [bodies[i] for i in inner.tolist()], before[inner], a * 256 + b
            core = mix(_hashed(own, mid - a, mid - b + LENGTH, seed) * _STEP + anchor[inner])
            common = np.isin(core, hot) if a < b else np.zeros(len(inner), dtype=bool)
            ends = ~common
            # places with other strings of the range are not equal
            whole = _hashed(own, mid - most, mid - least + LENGTH, ~seed % 2**64)
            whole = mix(whole * _STEP + (least * 256 + most).astype(np.uint64))
            yield depth, inner[ends], core[ends], whole[ends], least[ends], most[ends]
            if common.any():
                yield from run(inner[common], a, b, depth + 1)

    yield from run(np.arange(len(bodies)), 0, BEFORE, 1)


def _hot_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[tuple]:
    """(doc, place, before, bodies, ranges) of batches of _CONTEXTS; rows and the rest of each range as in _cores."""
    for batch in batches:
        anchor, doc, place, before = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4))
        before, bodies = before.astype(np.int64), batch.column(5).to_pylist()
        yield doc, place, before, bodies, _cores(anchor.view(np.uint64), before, bodies, hot)


def _count_cores(hot, depth: int):
    """Per core at a depth, and rows held at once: how many classes have it, and how many of these differ in the range."""

    def settled(rows: list[tuple]) -> pa.RecordBatch:
        core, whole = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((whole, core))
        core, whole = core[order], whole[order]
        at = np.flatnonzero(_new(core))
        other = np.add.reduceat(_new(core, whole).astype(np.int64), at)
        return _table(["key", "classes", "different"], _signed(core[at]), np.diff([*at, len(core)]), other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, _, _, ranges in _hot_batches(batches, hot.value):
            for level, _, core, whole, _, _ in ranges:
                if level == depth:
                    held.append((core, whole))
                    size += len(core)
            if size >= HELD:
                yield settled(held)
                held, size = [], 0
        if held:
            yield settled(held)

    return run


def _parted(hot, shared, shared_bits: int):
    """Contexts of the classes of hot anchors within each range whose core other classes share, settled within the task."""

    def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        *columns, bodies = zip(*rows, strict=True)
        core, whole, doc, place, least, most = (np.concatenate(c) for c in columns)
        bodies = [b for part in bodies for b in part]
        order = np.lexsort((place, doc, whole, core))
        core, whole, doc, place, least, most = (v[order] for v in (core, whole, doc, place, least, most))
        first = _new(core, whole)
        again = _repeated(first, doc, place)
        some, one = np.flatnonzero(first & (least < most)), np.flatnonzero(first & (least == most))
        none = np.zeros(len(some), dtype=np.uint64)
        yield _context_batch(_signed(core[some]), none, doc[some], place[some], most[some], [bodies[i] for i in order[some].tolist()])
        yield _context_batch(_signed(core[one]), whole[one], doc[one], place[one] - most[one], None, None)
        where, start, length = _united(doc[again], (place - most)[again], (LENGTH + most - least)[again])
        yield _context_batch(None, np.zeros(len(where), dtype=np.uint64), where, start, length, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, held, size = np.frombuffer(shared.value, dtype=np.uint64), [], 0
        for doc, place, before, bodies, ranges in _hot_batches(batches, hot.value):
            for _, rows, core, whole, least, most in ranges:
                ok = np.flatnonzero(_passes(field, shared_bits, core))
                rows, core, whole, least, most = (v[ok] for v in (rows, core, whole, least, most))
                start, stop = before[rows] - most, before[rows] - least + LENGTH
                own = [bodies[r][i:j] for r, i, j in zip(rows.tolist(), start.tolist(), stop.tolist(), strict=True)]
                held.append((core, whole, doc[rows], place[rows], least, most, own))
                size += len(rows)
            if size >= HELD // 4:
                yield from settled(held)
                held, size = [], 0
        if held:
            yield from settled(held)

    return run


def _context_batch(anchor, window, doc, place, before, bodies) -> pa.RecordBatch:
    count = len(doc)
    columns = [
        pa.nulls(count, pa.int64()) if anchor is None else pa.array(anchor),
        pa.array(_signed(window)),
        pa.array(doc),
        pa.array(place),
        pa.nulls(count, pa.int32()) if before is None else pa.array(before.astype(np.int32)),
        pa.nulls(count, pa.binary()) if bodies is None else pa.array(bodies, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "doc", "place", "before", "body"])


def suffix_array(group: np.ndarray, before: np.ndarray, bodies: list[bytes]):
    """Suffixes of LENGTH bytes or more that may start a maximal repeat: (context, start), sorted, with common prefixes and the byte to the left.

    Suffixes are compared only within a group and at the same distance from the anchor. The first
    element of the common prefixes is 0, as is that of each new group.
    """
    sizes = np.array([len(b) for b in bodies])
    # behind each body so many zeros that a suffix can be read as a window of fixed size
    wide = 2 * CONTEXT
    flat = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), dtype=np.uint8)
    grid = flat.reshape(len(bodies), wide)[:, :CONTEXT]
    prefix = window_hashes(grid, LENGTH)
    starts = np.arange(prefix.shape[1])
    row, start = np.nonzero(starts[None, :] + LENGTH <= sizes[:, None])
    bucket = mix(prefix[row, start] + mix(group[row].astype(np.uint64) * _STEP + (start - before[row]).astype(np.uint64)))
    left = np.where(start > 0, grid[row, start - 1].astype(np.int64), -1 - row)
    order = np.argsort(bucket, kind="stable")
    row, start, bucket, left = row[order], start[order], bucket[order], left[order]
    bounds = np.flatnonzero(_new(bucket))
    counts = np.diff([*bounds, len(bucket)])
    open_ = np.minimum.reduceat(left, bounds) != np.maximum.reduceat(left, bounds) if len(bounds) else bounds > 0
    kept = np.repeat((counts > 1) & open_, counts)
    row, start, left = row[kept], start[kept], left[kept]
    rank = np.cumsum(_new(bucket[kept])) if kept.any() else np.zeros(0, dtype=np.int64)
    if not len(row):
        return row, start, start, left
    suffix = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT)[row * wide + start]
    keyed = np.concatenate([rank.astype(">u8").view(np.uint8).reshape(-1, 8), suffix], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{CONTEXT + 8}").ravel(), kind="stable")
    row, start, left, suffix, rank = row[order], start[order], left[order], suffix[order], rank[order]
    length = sizes[row] - start
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), CONTEXT)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    common = np.concatenate([[0], np.where((rank[1:] == rank[:-1]) & (common >= LENGTH), common, 0)])
    return row, start, common, left


def intervals(common: list[int], left: list[int], order: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(length, first, last, heads) of the intervals of common prefixes whose suffixes differ to the left, by a stack scan.

    `order` ranks the places of the suffixes. `heads` has the earliest suffix of each part of the
    interval, the earliest of all in front; a part is a single suffix or an interval within this one.
    So each suffix that is not the earliest of an interval is listed once, in the longest such
    interval, and all heads together are no more than twice the suffixes.
    """
    stack: list[list] = []  # [length, first, left byte or MIXED, heads]
    mixed = 1 << 40
    for at in range(1, len(common) + 1):
        depth = common[at] if at < len(common) else 0
        begin, seen, head = at - 1, left[at - 1], at - 1
        while stack and stack[-1][0] > depth:
            length, begin, own, heads = stack.pop()
            seen = own if own == seen else mixed
            heads.append(head)
            k = min(range(len(heads)), key=lambda i: order[heads[i]])
            heads[0], heads[k] = heads[k], heads[0]
            head = heads[0]
            if seen == mixed:
                yield length, begin, at - 1, heads
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else mixed
                stack[-1][3].append(head)
            else:
                stack.append([depth, begin, seen, [head]])


_GROUPS = "length long, docs array<long>, starts array<long>"


def _group_rows(held: list[tuple]) -> Iterator[tuple[int, list[int], list[int]]]:
    """Maximal repeats among rows (group number, doc, place, before, body)."""
    group, doc, place, before, bodies = zip(*held, strict=True)
    doc, place, before = np.array(doc), np.array(place), np.array(before)
    row, start, common, left = suffix_array(np.array(group), before, list(bodies))
    begin = place[row] - before[row] + start
    owner = doc[row]
    rank = np.empty(len(row), dtype=np.int64)
    rank[np.lexsort((begin, owner))] = np.arange(len(row))
    owner, begin = owner.tolist(), begin.tolist()
    for length, _, _, heads in intervals(common.tolist(), left.tolist(), rank.tolist()):
        head = owner[heads[0]], begin[heads[0]]
        rest = [h for h in heads[1:] if (owner[h], begin[h]) != head]
        if rest:
            yield length, [head[0], *(owner[h] for h in rest)], [head[1], *(begin[h] for h in rest)]


def _find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, window, doc, place)."""
    held: list[tuple] = []
    key, number, strings = None, 0, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "docs", "starts"])

    for batch in batches:
        found = []
        for anchor, window, doc, place, before, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = anchor, window, body is None
            if now != key:
                if len(strings) > 1:
                    found.append((LENGTH, [d for d, _ in strings], [p for _, p in strings]))
                strings = []
                if len(held) >= CHUNK:
                    found += _group_rows(held)
                    held = []
                key, number = now, number + 1
            if body is None:
                if not strings or strings[-1] != (doc, place):
                    strings.append((doc, place))
            else:
                held.append((number, doc, place, before, body))
        yield out(found)
    found = [(LENGTH, [d for d, _ in strings], [p for _, p in strings])] if len(strings) > 1 else []
    yield out(found + list(_group_rows(held) if held else []))


def _parts_of_hot(contexts: DataFrame, paths: list[str]) -> DataFrame:
    """Contexts of hot anchors as _parted gives them out."""
    context = contexts.sparkSession.sparkContext
    hot, counted, depth = np.zeros(0, dtype=np.uint64), [], 0
    while True:
        depth += 1
        cores = contexts.mapInArrow(_count_cores(context.broadcast(hot), depth), "key long, classes long, different long")
        sums = cores.groupBy("key").agg(F.sum("classes").alias("classes"), F.sum("different").alias("different"))
        shared, path = scratch.stage_alone(sums.where("classes > 1"), "cores")
        paths.append(path)
        counted.append(shared)
        found = [row["key"] for row in shared.where(F.col("different") > HOT).select("key").collect()]
        if not found:
            break
        hot = np.concatenate([hot, np.array(found, dtype=np.int64).view(np.uint64)])
    field, bits = bit_field(reduce(DataFrame.unionByName, counted), "key")
    return contexts.mapInArrow(_parted(context.broadcast(hot), context.broadcast(field), bits), _CONTEXTS)


def _groups_and_copies(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Those of maximal_repeats, and the folders that they are read from."""
    bounded(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    bits = F.xxhash64(F.col(text)).bitwiseAND(F.lit(2**TEXT_BITS - 1)).cast("int").alias("bits")
    rows = docs.select(doc, bits, F.col(text).alias("text"))
    # spans without an anchor travel along, dealt by document
    spread = F.coalesce("anchor", F.xxhash64("doc", "place"))
    classes = rows.mapInArrow(_find_classes, _CLASSES).repartition(spread)
    sorted_ = classes.sortWithinPartitions("anchor", "context", "doc", "place")
    meeting, path = scratch.stage_alone(sorted_.mapInArrow(_meet, _MEETING), "meeting")
    paths = [path]
    several = meeting.where("anchor is not null")
    # texts of one id are told apart by their bits
    places = several.select("doc", F.shiftright("reach", REACH_BITS).alias("bits"), F.struct("anchor", "place", "reach").alias("place"))
    wanted = places.groupBy("doc", "bits").agg(F.collect_list("place").alias("places"))
    joined = rows.withColumn("text", F.col("text").cast("binary")).join(wanted, ["doc", "bits"])
    one = joined.select("doc", "text", F.explode("places").alias("one")).select("doc", "text", "one.anchor", "one.place", "one.reach")
    before = F.shiftright("reach", 8).bitwiseAND(F.lit(2 ** (REACH_BITS - 8) - 1))
    body = F.substring("text", (F.col("place") - before + 1).cast("int"), before + F.col("reach").bitwiseAND(F.lit(255)))
    cut_out = one.select("anchor", F.lit(0).cast("long").alias("window"), "doc", "place", before.alias("before"), body.alias("body"))
    contexts, path = scratch.stage_alone(cut_out.where(F.length("body") >= LENGTH), "contexts")
    paths.append(path)
    hot, path = scratch.stage_alone(several.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    paths.append(path)
    grouped, copies = contexts, meeting.where("anchor is null").select("doc", "place", "length")
    if not hot.isEmpty():
        often, path = scratch.stage_alone(contexts.join(F.broadcast(hot), "anchor", "left_semi"), "often")
        paths.append(path)
        parts, path = scratch.stage_alone(_parts_of_hot(often, paths), "parts")
        paths.append(path)
        grouped = contexts.join(F.broadcast(hot), "anchor", "left_anti").unionByName(parts.where("anchor is not null"))
        copies = copies.unionByName(parts.where("anchor is null").select("doc", "place", F.col("before").cast("long").alias("length")))
    dealt = grouped.repartition("anchor", "window").sortWithinPartitions("anchor", "window", "doc", "place")
    return dealt.mapInArrow(_find_groups, _GROUPS), copies, paths


def maximal_repeats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(groups, copies).

    groups: length, docs, starts - a maximal repeat among the contexts of an anchor: its earliest place
    in front, then one place of each part of it. A part that is more than one place is a longer repeat
    and has a row of its own that begins with that place, so all places of a repeat are found by
    following these, and the rows together grow with the places only. Those of an anchor of more than
    HOT classes are maximal among the strings of a range only. copies: doc, place, length - places that
    repeat a whole context of an earlier place, or for such an anchor all strings of a range; they are not
    listed again in the groups of that place.
    """
    groups, copies, _ = _groups_and_copies(docs, text)
    return groups, copies


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int]:
    """What is left of `data` without the spans, and the number of maximal removed runs."""
    stops = np.minimum(stops, len(data))
    some = starts < stops
    where, starts, lengths = _united(np.zeros(int(some.sum()), dtype=np.int64), starts[some], (stops - starts)[some])
    left, at = [], 0
    for start, stop in zip(starts.tolist(), (starts + lengths).tolist(), strict=True):
        left.append(data[at:start])
        at = stop
    return b"".join([*left, data[at:]]), len(where)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, starts, stops = batch.columns
        rows = []
        for i, (doc, text) in enumerate(zip(docs.to_pylist(), texts.to_pylist(), strict=True)):
            data = (text or "").encode()
            left, runs = data, 0
            if starts[i].is_valid:
                left, runs = cut(data, np.asarray(starts[i].values), np.asarray(stops[i].values))
            rows.append((doc, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a batch that touch become one before they are shuffled."""
    for batch in batches:
        doc, start, length = _united(*(np.asarray(c) for c in batch.columns))
        yield _table(["doc", "place", "length"], doc, start, length)


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row what is left when every byte goes that a string of LENGTH bytes covers which starts earlier as well."""
    groups, copies, paths = _groups_and_copies(docs, text)
    later = groups.select("length", F.explode(F.slice(F.arrays_zip("docs", "starts"), 2, 2**31 - 1)).alias("o"))
    spans = copies.select("doc", "place", "length").unionByName(
        later.select(F.col("o.docs").alias("doc"), F.col("o.starts").alias("place"), "length")
    )
    spans, _ = scratch.stage_alone(spans.mapInArrow(_join_spans, "doc long, place long, length long"), "spans")
    for path in paths:
        scratch.drop(docs.sparkSession, path)
    lists = spans.groupBy("doc").agg(
        F.collect_list(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("length")).alias("stop"))).alias("_spans")
    )
    lists = lists.select("doc", F.col("_spans.start").alias("_starts"), F.col("_spans.stop").alias("_stops"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_body"))
    joined = rows.join(lists, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), "left")
    return joined.select("doc_id", "_body", "_starts", "_stops").mapInArrow(_cut_rows, _CUT)

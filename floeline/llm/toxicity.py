"""Toxicity of texts whose words may be disguised.

1. Language model: counts of four-letter sequences over all documents (at most 27^4 numbers).
2. Noisy channel: a run that hides letters behind digits and signs, stretches them or spaces them out
   is a lattice of readings: each sign stands for one of its letters, a stretched letter for one or
   two, a blank between single letters for a word boundary or none. The Viterbi path through the
   lattice under the language model is the restored word, or the words of spaced letters. Runs with
   a single reading need no decoding, and a run is decoded once in each worker.
3. Classifier: words and beginnings of words, as written and as restored, are features. Those that
   stand out in toxic texts of the labelled sample (SAMPLE rows at most, the smallest hashes of
   their ids) go into a logistic regression. Only the text is an input of a score.

Defined results: null and empty texts have the score of a text without features. Without labelled
rows of both kinds the score is the smoothed share of toxic rows (0.5 without any). Labels that are
null do not count; equal rows have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.batches import bounded

# fixed values: what a sign may stand for
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "€": "e", "(": "c", "#": "h",
}
#: Labelled rows that the classifier is fitted on at most, and features that it keeps.
SAMPLE = 8000
FEATURES = 4096
BEGINNINGS = (3, 4, 5, 6, 7)
REMEMBERED = 500_000

_LETTERS = 27
_SIZE = _LETTERS**4
_CODES = np.zeros(256, dtype=np.int64)
for _i in range(26):
    _CODES[ord("a") + _i] = _CODES[ord("A") + _i] = _i + 1


def letter_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of four neighbouring symbols: letters, or 0 for anything else."""
    total = np.zeros(_SIZE, dtype=np.int64)
    for at in range(0, len(texts), 64):
        raw = "\n\n\n".join(t or "" for t in texts[at : at + 64]).encode()
        c = _CODES[np.frombuffer(b"\n\n\n" + raw + b"\n\n\n", dtype=np.uint8)]
        total += np.bincount(((c[:-3] * _LETTERS + c[1:-2]) * _LETTERS + c[2:-1]) * _LETTERS + c[3:], minlength=_SIZE)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE, dtype=np.int64)
    for batch in batches:
        total += letter_counts(batch.column(0).to_pylist())
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(fourth symbol | three before), interpolated with shorter contexts; 27^4 numbers at most reach the driver."""
    counted = docs.select(text).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE)
    table = counted.toPandas()
    counts[table["gram"].to_numpy(dtype=np.int64)] = table["n"]
    return _smoothed(counts)


def _smoothed(counts: np.ndarray) -> np.ndarray:
    grid = counts.reshape((_LETTERS,) * 4)
    below = np.full(_LETTERS, 1 / _LETTERS)
    for order in range(4):
        level = grid.sum(axis=tuple(range(3 - order)))
        below = (level + 5 * below) / (level.sum(axis=-1, keepdims=True) + 5)
    return np.log(below).astype(np.float32)


_STRETCHED = re.compile(r"(.)\1{2,}", re.DOTALL)
_LATIN, _SIGN = re.compile("[A-Za-z]"), re.compile(r"[0-9@$!|+*€(#]")
_LETTER = re.compile(r"[^\W\d_]")
_DOTTED = re.compile(r"^\W*\w(?:[.\-_*~/]\w){2,}\W*$")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def lattice(run: str) -> list[tuple[str, ...]]:
    """For each place of `run` its readings, each a string of letters."""
    places: list[tuple[str, ...]] = []
    at, run = 0, run.lower()
    while at < len(run):
        c = run[at]
        stop = at
        while stop < len(run) and run[stop] == c:
            stop += 1
        options = SIGNS.get(c, c if c.isalpha() else "")
        if stop - at > 2:
            places.append(tuple(o * k for o in options for k in (1, 2)) or ("",))
        else:
            places += [tuple(options) or ("",)] * (stop - at)
        at = stop
    return places


def spaced_lattice(run: str) -> list[tuple[str, ...]]:
    """The lattice of single letters that stand apart: between two of them is a word boundary or none."""
    places: list[tuple[str, ...]] = []
    for options in lattice(run):
        if places:
            places.append(("", "\n"))
        if any(len(o) > 1 for o in options):  # stretched: the end of one word and the beginning of the next may be alike
            single = [o for o in options if len(o) == 1]
            options += tuple(form for o in single for form in (f"{o}\n{o}", f"{o}{o}\n{o}", f"{o}\n{o}{o}"))
        places.append(options)
    return places


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0


def decode(places: list[tuple[str, ...]], model: np.ndarray) -> str:
    """The Viterbi path: the likeliest word, with word boundaries on both sides."""
    states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    for options in [*places, ("\n",)]:
        after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for (a, b, c), (cost, path) in states.items():
            for option in options:
                x, y, z, total = a, b, c, cost
                for letter in option:
                    code = _code(letter)
                    total -= float(model[x, y, z, code])
                    x, y, z = y, z, code
                best = after.get((x, y, z))
                if best is None or total < best[0]:
                    after[x, y, z] = total, (path, option)
        states = after
    path, read = min(states.values(), key=lambda state: state[0])[1], []
    while path:
        path, option = path
        read.append(option)
    return "".join(reversed(read)).rstrip("\n")


def restored(run: str, model: np.ndarray) -> list[str]:
    """Readings of a run without blanks: as written, and as decoded if it hides something."""
    plain = _EDGE.sub("", run).lower()
    words = [plain] if plain else []
    # trailing signs are mostly punctuation: they are read as letters in one of two lattices only
    for form in dict.fromkeys((_EDGE.sub("", run), run)):
        if _DOTTED.match(form):
            form = re.sub(r"[.\-_*~/]", "", form)
            words.append(form.lower())
        if (_LATIN.search(form) and _SIGN.search(form)) or (_LETTER.search(form) and _STRETCHED.search(form)):
            word = decode(lattice(form), model)
            if word and word not in words:
                words.append(word)
    return words


def spaced(run: str, model: np.ndarray) -> list[str]:
    """Words in letters that stand apart: those of the likeliest boundaries, and all letters as one word."""
    letters = "".join(run.split())
    words = [word for word in decode(spaced_lattice(letters), model).split("\n") if word]
    return list(dict.fromkeys([*words, *restored(letters, model)]))


def features(word: str) -> tuple[int, ...]:
    parts = [word, *(word[:n] + "…" for n in BEGINNINGS if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(p) >> 1 for p in parts)


class Reader(dict):
    """Features of a run, or of single letters with blanks between them; `wanted` limits them to those that a classifier knows."""

    def __init__(self, model: np.ndarray, wanted: dict[int, float] | None = None):
        super().__init__()
        self.model, self.wanted = model, wanted

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        words = spaced(run, self.model) if " " in run else restored(run, self.model)
        found = [f for word in words for f in features(word)]
        if self.wanted is not None:
            found = [f for f in found if f in self.wanted]
        self[run] = value = tuple(found)
        return value

    def features(self, text: str | None) -> set[int]:
        text = text or ""
        runs = set(text.split())
        runs.update(" ".join(m.group().split()) for m in _SPACED.finditer(text))
        return set().union(*map(self.__getitem__, runs))


def _rows(reader: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, texts = batch.columns
            found = [sorted(reader.features(t)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([toxic, pa.array(found, pa.list_(pa.int64()))], names=["toxic", "found"])

    return run


def stands_out(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed strength of features: a shrunk log ratio of their shares in toxic and clean texts."""
    return np.log(np.maximum(toxic - 2, 0) + 1e-9) - math.log(n_toxic) - np.log(clean + 1) + math.log(n_clean)


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[dict[int, float], float]:
    """Weights of features and the intercept, from (toxic, sorted features)."""
    y = np.array([t for t, _ in rows], dtype=np.float64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return {}, math.log((n1 + 1) / (n0 + 1))
    doc = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    known, column = np.unique(np.concatenate([f for _, f in rows]), return_inverse=True)
    toxic = np.bincount(column, weights=y[doc], minlength=len(known))
    clean = np.bincount(column, minlength=len(known)) - toxic
    strength = stands_out(toxic, clean, n1, n0)
    order = np.lexsort((known, -(strength * toxic)))[:FEATURES]
    chosen = order[(strength[order] > math.log(6)) & (toxic[order] >= 4)]
    slot = np.full(len(known), -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[column] >= 0
    doc, column = doc[used], slot[column[used]]
    # a doc with many features of one word would count it many times over
    weight, bias = np.zeros(len(chosen)), math.log(n1 / n0)
    speed, slope = np.zeros(len(chosen)), 0.0
    for _ in range(400):
        z = bias + np.bincount(doc, weights=weight[column], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.bincount(column, weights=error[doc], minlength=len(chosen)) + 0.05 * weight
        speed = 0.9 * speed - 2.0 / len(rows) ** 0.5 * gradient / np.sqrt(toxic[chosen] + clean[chosen])
        slope = 0.9 * slope - 0.5 * error.mean()
        weight, bias = np.clip(weight + speed, -2, 12), bias + slope
    return {int(known[c]): float(w) for c, w in zip(chosen, weight, strict=True) if w}, float(bias)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        toxic, found = batch.columns
        rows += [(t, np.asarray(f.values, dtype=np.int64)) for t, f in zip(toxic.to_pylist(), found, strict=True)]
    weights, bias = fit(rows)
    keys, values = [-1, *weights], [bias, *weights.values()]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], names=["feature", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE):
    """(language model, weights, intercept); at most FEATURES weights reach the driver."""
    model = language_model(docs, text)
    # a null id has no remainder and so no label
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
    rows = docs.select("doc_id", text).join(chosen, "doc_id").select("toxic", text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def extract(batches):
        return _rows(Reader(shared.value))(batches)

    found = rows.mapInArrow(extract, "toxic int, found array<long>")
    learned = found.repartition(1).mapInArrow(_fit, "feature long, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in learned}
    return model, {f: w for f, w in weights.items() if f >= 0}, weights.get(-1, 0.0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = shared.value
        reader = Reader(model, weights)
        for batch in batches:
            *rest, texts = batch.columns
            scores = []
            for text in texts.to_pylist():
                z = bias + math.fsum(weights[f] for f in reader.features(text))
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(_score(shared), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

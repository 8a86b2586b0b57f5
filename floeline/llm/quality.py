"""Quality rules as a short-circuit cascade, in built-in expressions only.

Features come from one pass over each text. The rules run in an order found on a sample: a rule
that rejects much for little time goes first, so that most bad texts never reach the dear rules.
The order changes the time only; whether a document is kept does not depend on it.

Defined results: a null text counts as an empty one (no words, so it is rejected); an empty table
gives no rows; repeated rows are judged each on its own; columns of the input stay, and a column
whose name a feature needs is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: white space, symbols and bounds of the two base rules
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

#: Rows of the sample on which cost and rejection of the rules are measured.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """`rejects(text)` is true for a text that must go. It is evaluated only if reached."""

    name: str
    rejects: Callable[[Column], Column]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once; a lambda that names an expression evaluates it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(tokens: Column) -> Column:
    """A hash for each window of three words, by its first position. `tokens` is a column or bound by let()."""
    whole = F.when(
        F.size(tokens) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - 3),
            lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
        ),
    )
    return F.coalesce(whole, F.array().cast("array<bigint>"))


def _covered(placed: Column) -> Column:
    """Words in windows whose hash has an equal neighbour; `placed` is sorted by hash, then position."""

    def twin(entry: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(placed, k - 1)["h"] == entry["h"])
        after = F.get(placed, k + 1)["h"] == entry["h"]
        return before | F.coalesce(after, F.lit(False))

    starts = F.sort_array(F.transform(F.filter(placed, twin), lambda entry: entry["i"]))
    return let(starts, _spanned)


def _spanned(starts: Column) -> Column:
    spans = F.transform(starts, lambda p, k: F.least(F.lit(3), F.get(starts, k + 1) - p))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("long")).otherwise(let(placed, _covered))


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of three words that stand at two places or more."""
    return let(tokens, lambda t: let(window_hashes(t), _repeated))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("_words", words(body)).withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": word_chars(body),
                "n_symbols": n_symbols(body),
                "n_dup_lines": n_dup_lines(body),
                "n_repeat_words": repeated_words(F.col("_words")),
            }
        )
        .drop("_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def _count_words(text: Column) -> Column:
    return F.size(words(text))


def _shouting(text: Column) -> Column:
    """More capitals than small letters, of those that have both forms."""
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    small = F.length(F.regexp_replace(text, r"\P{Ll}+", ""))
    return capitals > small


def _repeats(text: Column) -> Column:
    return let(words(text), lambda t: 100 * repeated_words(t) > REPEAT_PERCENT * F.size(t))


#: Bounds of the rules beside the base: symbols for each hundred words, repeated lines for each
#: hundred lines, mean word length.
SYMBOL_PERCENT = 20
DUP_LINE_PERCENT = 50
MEAN_WORD = (2, 15)

RULES = (
    Rule("few_words", lambda t: _count_words(t) < LEAST_WORDS),
    Rule("symbols", lambda t: 100 * n_symbols(t) > SYMBOL_PERCENT * _count_words(t)),
    Rule("capitals", _shouting),
    Rule("line_copies", lambda t: 100 * n_dup_lines(t) > DUP_LINE_PERCENT * F.size(F.split(t, "\n"))),
    Rule("short_words", lambda t: word_chars(t) < MEAN_WORD[0] * _count_words(t)),
    Rule("long_words", lambda t: word_chars(t) > MEAN_WORD[1] * _count_words(t)),
    Rule("repeats", _repeats),
)


def measure(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Time and share of rejected rows of each rule, on the first `rows` rows at most.

    take() reads as few partitions as it needs; a limit in the plan would send `rows` rows of every
    partition to one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(body.alias("body")).take(rows)
    sample = docs.sparkSession.createDataFrame(taken, "body string").repartition(1).persist()
    try:
        total = sample.count()
        found = []
        for rule in rules:
            started = time.perf_counter()
            hits = sample.where(rule.rejects(F.col("body"))).count()
            found.append(Measured(rule, time.perf_counter() - started, hits / max(total, 1)))
        return found
    finally:
        sample.unpersist()


def by_worth(measured: list[Measured]) -> list[Rule]:
    """Most rejection for each second first; of equals, the cheaper one first."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.worth, m.seconds, m.rule.name))]


def verdict(rules, text: Column) -> Column:
    """Name of the first rule that rejects, or null. A branch is evaluated only if all before it passed."""
    body = F.coalesce(text, F.lit(""))
    found = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        found = F.when(rule.rejects(body), F.lit(rule.name)).otherwise(found)
    return found


def cascade(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds `rejected_by`: a rule that rejects the row (the first in the measured order), null if none does."""
    ordered = by_worth(measure(docs, rules, text, rows))
    return docs.withColumn("rejected_by", verdict(ordered, F.col(text)))


def kept(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of the input."""
    ordered = by_worth(measure(docs, rules, text, rows))
    return docs.where(verdict(ordered, F.col(text)).isNull())


def judge_features(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features and verdict together; the cascade reads the features, so no text is split twice."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.size(F.split(body, "\n"))
    ordered = by_worth(measure(docs, RULES, text, rows))
    ready = {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"),
        "capitals": _shouting(body),
        "line_copies": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * lines,
        "short_words": F.col("word_chars") < MEAN_WORD[0] * F.col("n_words"),
        "long_words": F.col("word_chars") > MEAN_WORD[1] * F.col("n_words"),
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
    }
    rules = [Rule(rule.name, lambda _, c=ready[rule.name]: c) for rule in ordered]
    return (
        with_features(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", verdict(rules, body))
        .withColumn("kept", F.col("rejected_by").isNull())
    )

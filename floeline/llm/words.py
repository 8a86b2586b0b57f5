"""Word hashes of texts, for operators that compare texts by their words.

A word is a run between blanks without its punctuation and in small letters; runs without a letter or
digit are no words. Words are 64-bit hashes, never 0.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash

#: Runs whose hash a worker remembers; beyond it begins anew.
REMEMBERED = 500_000
_NO_WORD = re.compile(r"[\W_]+")


class Hashes(dict):
    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = _NO_WORD.sub("", run.lower())
        value = self[run] = (xxhash.xxh3_64_intdigest(word) or 1) if word else 0
        return value


@cache
def _hashes() -> Hashes:
    return Hashes()


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of `text`, in order."""
    runs = (text or "").split()
    found = np.fromiter(map(_hashes().__getitem__, runs), dtype=np.uint64, count=len(runs))
    return found[found != 0]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of a well-known hash)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def combined(words: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """A hash of the words at `offsets` from each position at which all of them exist."""
    count = max(0, len(words) - offsets[-1])
    total = np.full(count, salt, dtype=np.uint64)
    for offset in offsets:
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + count]
    return mix(total)

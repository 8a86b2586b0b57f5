"""Byte-level BPE vocabularies of public tokenizers, loaded once in each Python worker.

The file is the `tokenizers` JSON whose path the caller gives. Whole texts are encoded through
`tiktoken` on the ranks of that same file, which gives the same ids several times faster (the tests
compare both, on every code point); offsets, pieces and merges inside a window come from
`tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: How far behind a boundary a piece can still depend on the text: a special string and a blank.
LOOKAHEAD = 16


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def letters_of_bytes() -> list[str]:
    """The stand-in letter of each byte."""
    return [c for c, _ in sorted(byte_letters().items(), key=lambda item: item[1])]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {word: i for word, i in ranks.items() if i not in self.special.values()}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in ranks.items():
            self.bytes_of[i] = word
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        if any(word in text for word in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the byte position at which each token starts, and whether a piece starts there."""
        found = self.library.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.int64)
        ends = np.cumsum(self.length_of[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        starts = ends - self.length_of[ids] if len(ids) else ends
        pieces = np.array(found.word_ids, dtype=np.int64)
        first = np.ones(len(ids), dtype=bool)
        first[1:] = pieces[1:] != pieces[:-1]
        return ids, starts, first

    def pieces(self, text: str) -> list[tuple[str, int, int]]:
        """(stand-in letters, start, end) of each piece, positions in code points; a special string has no letters."""
        spans, at = [], 0
        while at < len(text):
            hits = [(text.find(word, at), word) for word in self.special]
            hits = [h for h in hits if h[0] >= 0]
            upto, word = min(hits) if hits else (len(text), "")
            if upto > at:
                part = self.library.pre_tokenizer.pre_tokenize_str(text[at:upto])
                spans += [(letters, at + s, at + e) for letters, (s, e) in part]
            if word:
                spans.append(("", upto, upto + len(word)))
            at = upto + len(word)
        return spans

    def merge(self, letters: str) -> list[int]:
        """Ids of one piece, given as stand-in letters."""
        return [t.id for t in self.library.model.tokenize(letters)]


@cache
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def stable_end(text: str) -> int:
    """Pieces that start at or before this position are the same whatever follows `text`; -1 if none is.

    A piece depends on what follows it up to the end of a run of blanks, and a special string must be
    visible as a whole. So the last character that is no blank and has LOOKAHEAD more behind it is safe.
    """
    at = len(text) - LOOKAHEAD
    while at >= 0 and text[at].isspace():
        at -= 1
    return at

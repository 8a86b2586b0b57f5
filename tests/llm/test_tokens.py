"""Token counts, encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from floeline.llm import bpe, token_counts, vocabulary

PARTS = ["the ", "token", "  ", "\n", "\n\n ", "<|endoftext|>", "<|endo", "'re", "'", "é", "汉字", "a" * 90, "1234", "...", " !", "\t", "\x1c", " ", "x'll "]


def made_up(seed: int, parts: int) -> str:
    pick = random.Random(seed)
    return "".join(pick.choice(PARTS) for _ in range(parts))


TEXTS = [None, "", " ", "\n" * 700, "b" * 3000, "<|endoftext|>" * 80, *(made_up(s, 8 * s) for s in range(60))]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").drop("n_bytes").repartition(3)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 30), (500, 40), (32768, 1024)])
def test_counts(spark, frame, library, chunk, overlap):
    rows = token_counts.token_counts(frame, ["doc_id"], chunk=chunk, overlap=overlap).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "null id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert row.n_bytes == len(text.encode())
        assert row.n_tokens == len(expected(library, text)), repr(text[:200])


def test_counts_of_no_rows(frame):
    assert token_counts.token_counts(frame.limit(0), ["doc_id"]).count() == 0


def test_fast_ids_are_those_of_the_library(library):
    known = vocabulary.load(vocabulary.default_path())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):
        text = " ".join(f"a{chr(c)}1{chr(c)}.{chr(c)}" for c in points[at : at + 997])
        assert known.ids(text) == expected(library, text)
    for text in TEXTS:
        assert known.ids(text or "") == expected(library, text)
        assert known.decode(known.ids(text or "")) == (text or "")


@pytest.mark.parametrize("leaf", [7, 50, 1000, 65536])
def test_round_trip(spark, frame, library, leaf):
    rows = bpe.digests(frame, ["doc_id"], leaf=leaf).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "null id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        ids = expected(library, text)
        assert row.n_tokens == len(ids), (repr(text[:300]), leaf)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("leaf", [600, 5000])
def test_unsplit_text(leaf, library):
    known = vocabulary.load(vocabulary.default_path())
    pick = random.Random(5)
    syllables = ["th", "er", "on", "an", "ing", "é", "ß", "tion", "aa", "zzz"]
    for text in ("".join(pick.choice(syllables) for _ in range(9000)), "a" * 20000, "-=" * 9000, "x" * 700 + " " + "y" * 9000):
        leaves = [bpe.encode_leaf(known, text[a:b]) for a, b in bpe.halves(text, leaf)]
        assert bpe.tree(known, leaves).tolist() == expected(library, text)


def test_encode_and_decode(spark, frame, library):
    encoded = bpe.encode(frame, ["doc_id"], leaf=300)
    rows = bpe.decode(encoded, ["doc_id", "ids"]).collect()
    for row in rows:
        text = "null id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert list(row.ids) == expected(library, text)
        assert row.text == text

"""The pipeline beside plain Python over the smallest tables, and its stages on odd rows."""

from collections import Counter

import compare
import numpy as np
import pytest
from test_jaccard import by_force as classes_by_force

import __spark_entry__ as entry
import corpus_pipeline
from floeline.llm import decontamination as dc
from floeline.llm import statements, words


def contaminated(text, items):
    doc = words.hashes(text)
    places = {}
    for i, word in enumerate(doc.tolist()):
        places.setdefault(word, []).append(i)
    for item in items:
        shifts = Counter(i - j for j, word in enumerate(item.tolist()) for i in places.get(word, ()))
        enough = min(dc.needed(len(item)), len(item))
        if any(n >= enough and dc.best_overlap(doc, item, s) for s, n in shifts.items()):
            return True
    return False


def test_run(spark, small, library):
    con = compare.connect(small)
    docs = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    good = {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({statements.SQL['op8_quality_cascade']})").fetchall() if kept}
    rows = [(d, t) for d, t, *_ in docs if d in good]
    least = {c for _, c, _ in classes_by_force(rows)}
    items = [words.hashes(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    left = {d: t for d, t in rows if d in least and not contaminated(t, items)}
    assert 0 < len(left) < len(least) < len(rows) < len(docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(left)
    same = 0
    for d, text in left.items():
        decoded = library.decode(list(got[d].ids), skip_special_tokens=False)
        assert list(got[d].ids) == library.encode(decoded, add_special_tokens=False).ids
        assert got[d].n_tokens == len(got[d].ids)
        same += decoded == text
    # only texts with personal data differ
    assert 0.7 * len(left) < same < len(left)


def test_columns_of_the_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).dtypes == docs.dtypes
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows(spark, small):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, long, "en", "s", 0), (None, long, "en", "s", 0), (3, long + " end", "en", "s", 0), (4, "word " * 300, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert [(r.doc_id, r.n_tokens > 100) for r in docs.collect()] == [(3, True)]


@pytest.mark.parametrize("name", sorted(statements.SQL))
def test_sql(spark, small, name):
    assert compare.compare(entry.queries()[name](spark, small), compare.connect(small), statements.SQL[name]) == ""


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 11)) and "pipeline" in entry.queries()
    assert np.all([n in entry.queries() for n in entry.oracle_sql()])

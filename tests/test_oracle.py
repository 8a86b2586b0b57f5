"""Every registered query beside its SQL."""

import compare
import pytest

import __spark_entry__ as entry
from floeline.plans import oracle, registry

STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, duck, small, name):
    assert compare.compare(entry.queries()[name](spark, small), duck, STATEMENTS[name]) == ""


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(STATEMENTS)))
def test_rows_only(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour", "cam_id", "conc", "severity", "total_frames"]
    assert 0 < df.count() <= 50

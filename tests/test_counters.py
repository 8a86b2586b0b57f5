"""Stateless random numbers against plain whole numbers, their spread, and permutations."""

import numpy as np
from pyspark.sql import functions as F

from floeline.functions import counters


def plain(n, stream, seed):
    p = 2**31 - 1
    h = (n % p * 48271 + n // p % p * 1000003 + (stream * 7919999 + seed * 104729 + 12345) % p) % p
    h = (h ^ h >> 16) * 69621 % p
    h = (h ^ h >> 15) * 39373 % p
    return (h ^ h >> 13) % p


def test_against_plain_numbers(spark):
    at = [0, 1, 2, 12345, 2**31 - 2, 2**31 - 1, 2**31, 2**40 + 7, 2**62 - 1]
    df = spark.createDataFrame([(n,) for n in at], "n long").select("n", counters.mixed(F.col("n"), 3, 9).alias("m"))
    assert {r.n: r.m for r in df.collect()} == {n: plain(n, 3, 9) for n in at}


def test_spread(spark):
    df = spark.range(20_000).select(
        counters.share(F.col("id"), 1, 5).alias("a"), counters.share(F.col("id"), 2, 5).alias("b"), counters.below(F.col("id"), 3, 5, 4).alias("c")
    )
    a, b, c = (np.array(x) for x in zip(*[(r.a, r.b, r.c) for r in df.collect()], strict=True))
    assert abs(a.mean() - 0.5) < 0.01 and abs(a.std() - 12**-0.5) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.03
    assert (np.histogram(a, 20, (0, 1))[0] > 850).all() and (np.bincount(c, minlength=4) > 4700).all()


def test_permuted_is_one_to_one(spark):
    ids = spark.range(5000).withColumn("id", F.col("id") * 7 + F.when(F.col("id") % 2 == 0, 0).otherwise(2**40))
    got = counters.permuted(ids, F.col("id"), 3, "place").collect()
    places = [r.place for r in got]
    assert len(set(places)) == 5000 and min(places) >= 0 and max(places) < 2**62
    assert np.abs(np.corrcoef([r.id for r in got], places)[0, 1]) < 0.05
    other = counters.permuted(ids, F.col("id"), 4, "place").collect()
    assert [r.place for r in sorted(other)] != [r.place for r in sorted(got)]

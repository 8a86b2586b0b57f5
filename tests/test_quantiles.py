"""Sketches against true ranks, exact quantiles against numpy where bounds miss, and what is read and shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeline.operators import quantiles

PROBS = {"lowest": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "highest": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    pick = random.Random(4)
    rows = [("big", d % 30, pick.lognormvariate(0, 2)) for d in range(40_000)]
    rows += [("few", d, float(v)) for d, v in enumerate([3, 1, 2])]
    rows += [("same", 0, 7.5)] * 2000 + [(None, 1, float(v)) for v in range(50)]
    return spark.createDataFrame(rows, "k string, dt int, v double").repartition(9).persist()


def expected(values, probs, method):
    by_key = {}
    for r in values.collect():
        by_key.setdefault(r.k, []).append(r.v)
    return {k: {n: np.quantile(v, p, method=method) for n, p in probs.items()} for k, v in by_key.items()}


@pytest.mark.parametrize("interpolate", [True, False])
@pytest.mark.parametrize("size,limit", [(1000, 1_000_000), (8, 1_000_000), (1000, 10)])
def test_exact_quantiles(values, interpolate, size, limit):
    """With tight bounds, with those of a coarse sketch, and with counted values in ranges."""
    got = quantiles.exact_quantiles(values, ["k"], "v", PROBS, interpolate, size, limit).collect()
    want = expected(values, PROBS, "linear" if interpolate else "inverted_cdf")
    assert {r.k for r in got} == set(want)
    for r in got:
        for name in PROBS:
            assert r[name] == pytest.approx(want[r.k][name], abs=1e-12), (r.k, name)


def test_bounds_that_miss_are_widened(values, monkeypatch):
    """A sketch that promises far more than it keeps."""
    monkeypatch.setattr(quantiles, "rank_error", lambda size=0: 1e-7)
    got = {r.k: r for r in quantiles.exact_quantiles(values, ["k"], "v", PROBS, False, size=8).collect()}
    want = expected(values, PROBS, "inverted_cdf")
    assert all(got[k][n] == want[k][n] for k in want for n in PROBS)


def test_nan_is_the_largest_value(spark):
    rows = [("a", float(v)) for v in range(1000)] + [("a", float("nan"))] * 400 + [("a", float("inf")), ("b", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}, False).collect()}
    assert got["a"].m == 700 and np.isnan(got["a"].p) and np.isnan(got["b"].m) and "c" not in got


def test_only_values_inside_the_bounds_are_counted_apart(values):
    rows = values.where("k = 'big'").select("k", "v")
    found = quantiles.sketches(rows, ["k"], "v").withColumn("_total", F.col("n"))
    bounds = quantiles._bounds(found, [0.5], 1000, 1.0)
    counted = quantiles._counted(rows, bounds, ["k"], "v", 1)
    kept, all_rows = counted.count(), rows.count()
    assert kept < 0.03 * all_rows and counted.agg(F.sum("_w")).first()[0] == all_rows
    assert counted.where("_gap").count() == 2


def test_sketches_of_days_merge(values):
    days = quantiles.sketches(values, ["k", "dt"], "v", 2000)
    got = {r.k: r for r in quantiles.approximate(days, ["k"], {"median": 0.5, "p95": 0.95}).collect()}
    data = [r.v for r in values.where("k = 'big'").collect()]
    for name, p in (("median", 0.5), ("p95", 0.95)):
        rank = np.mean(np.array(data) <= got["big"][name])
        assert abs(rank - p) < 3 * quantiles.rank_error(2000)
    assert got["big"].n == len(data) and got["big"].largest == max(data)
    assert got["few"].median in (1.0, 2.0, 3.0) and got["same"].p95 == 7.5


def test_empty(values):
    nothing = values.where("v < 0")
    assert quantiles.exact_quantiles(nothing, ["k"], "v", PROBS).count() == 0
    assert quantiles.approximate(quantiles.sketches(nothing, ["k"], "v"), ["k"], {"m": 0.5}).count() == 0

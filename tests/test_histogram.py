"""Quantiles from counted values, on both ways."""

import random

import numpy as np
import pytest

from bondmarts.operators import bench, histogram
from bondmarts.storage import store
from conftest import rows

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


def made_up(n=5000, seed=2):
    """Groups of many magnitudes and signs; a hot group, a hot value, values close together, infinities, a group of nulls."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        group = "hot" if i % 3 else rng.choice(["a", "b", None, "close"])
        value = rng.choice([5.0, 5.0, None, rng.gauss(0, 1), rng.lognormvariate(0, 6), -rng.lognormvariate(3, 2), rng.uniform(0, 1e-9), 0.0, 1e300])
        if group == "close" and value is not None:
            value = 1000 + rng.randrange(200) * 1e-12
        data.append((group, value))
    return data + [("nulls", None)] * 3 + [("one", 7.0)]


def check(found, data):
    found = {r.grp: r for r in found.collect()}
    assert set(found) == {g for g, _ in data}
    for group, r in found.items():
        values = [v for g, v in data if g == group and v is not None]
        assert (r.metric, r.n_rows, r.n) == ("value", sum(g == group for g, _ in data), len(values))
        if not values:
            assert (r["min"], r["max"], r["mean"], r.median) == (None, None, None, None)
            continue
        assert (r["min"], r["max"]) == (min(values), max(values)) and r["mean"] == pytest.approx(np.mean(values))
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("few, cuts", [(histogram.FEW, 4096), (100, 4096), (1, 4096), (5, 2)])
def test_equals_numpy(spark, monkeypatch, few, cuts):
    monkeypatch.setattr(histogram, "CUTS", cuts)
    data = made_up()
    df = spark.createDataFrame(data, "grp string, value double").repartition(8)
    counted = store(histogram.counted_values(df, ["grp"], ["value"]))
    check(histogram.counted_quantiles(counted, ["grp"], PROBS, few=few), data)


def test_a_hot_value_is_counted_before_the_shuffle(spark):
    """A value of a third of all rows leaves each map task as one row, without a salt."""
    df = spark.createDataFrame([("g", 5.0 if i % 3 == 0 else float(i)) for i in range(3000)], "grp string, value double").repartition(4)
    text = histogram.counted_values(df, ["grp"], ["value"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "rangepartitioning" not in text and "Sort" not in text
    counted = {r.value: r.rows for r in histogram.counted_values(df, ["grp"], ["value"]).collect()}
    assert counted[5.0] == 1000 + 1 and len(counted) == 2000


@pytest.mark.parametrize("few", [histogram.FEW, 3])
def test_whole_table_and_empty_table(spark, few):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2, 5, 5, 5)], "value double")
    counted = store(histogram.counted_values(df, [], ["value"]))
    assert rows(histogram.counted_quantiles(counted, [], {"q1": 0.25, "median": 0.5}, few=few), "n", "q1", "median") == [(7, 2.5, 4.0)]
    none = store(counted.limit(0))
    assert histogram.counted_quantiles(none, [], {"q1": 0.25}, few=few).count() == 0


@pytest.mark.parametrize("few", [histogram.FEW, 4])
def test_coarser_groups_are_merged_from_finer_ones(spark, few):
    data = [(g or "none", v) for g, v in made_up(1500, 9)]
    df = spark.createDataFrame([(g, str(i % 5), v) for i, (g, v) in enumerate(data)], "grp string, sub string, value double")
    counted = store(histogram.counted_values(df, ["grp", "sub"], ["value"]))
    merged = lambda rows: rows.drop("sub")
    check(histogram.counted_quantiles(counted, ["grp"], PROBS, ["grp", "sub"], merged, few=few), data)


def issuers(spark, n=600):
    rng = random.Random(4)
    pick = lambda *values: rng.choice(values)
    data = [
        (f"i{i}", pick("P", "Q"), pick("C", "D", "", None), pick("省级", "地市级"), pick("AA", "AAA"), *[pick(None, rng.randrange(400) / 4) for _ in range(5)]) for i in range(n)
    ]
    return store(spark.createDataFrame(
        data, "issuer string, province string, city string, admin_level string, rating string, total_assets double, net_assets double, revenue double, net_profit double, leverage double"
    ))


def test_the_cube_spreads_counts_and_sorts_nothing(spark):
    """Issuers are counted by the finest cell; what is repeated for coarser combinations are these counts."""
    e = issuers(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(bench.bench_cube(e))
    assert "rangepartitioning" not in text and "issuer" not in text
    assert "rangepartitioning" not in plan(bench.financial_bench(e)) + plan(bench.bench_slice(e))


def test_a_slice_of_the_cube_equals_the_slice_computed(spark):
    e = issuers(spark)
    cube = store(bench.bench_cube(e))
    for wanted in ({}, {"rating": "AA"}, {"city": "C", "admin_level": "省级"}, {"city": "D", "admin_level": "地市级", "rating": "AAA"}):
        for province in ("P", "Q"):
            found = bench.cube_slice(cube, province=province, **wanted).drop("province")
            assert rows(found) == rows(bench.bench_slice(e, province=province, **wanted).select(*found.columns)), wanted
    assert bench.cube_slice(cube, province="nowhere").count() == 0

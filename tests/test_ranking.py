import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondmarts.operators import ranking
from conftest import rows


def skewed(spark, n=4000):
    """Two thirds of the rows in one group, a third of them with one value, some nulls."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        group = "hot" if i % 3 else f"g{i % 7}"
        value = None if i % 11 == 0 else 5.0 if i % 2 else round(rng.random() * 100, 1)
        data.append((i, group, value))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id int, grp string, value double").repartition(8)


def test_numbered_equals_row_number_per_group(spark):
    data, df = skewed(spark)
    got = {r.id: r.seq for r in ranking.numbered(df, [F.col("value").desc_nulls_last(), F.col("id")], by=["grp"]).collect()}
    for group in {g for _, g, _ in data}:
        own = sorted((d for d in data if d[1] == group), key=lambda d: (d[2] is None, -(d[2] or 0), d[0]))
        assert [got[d[0]] for d in own] == list(range(1, len(own) + 1))


def test_numbered_over_the_whole_table_and_null_groups(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, None), (4, "a")], "id int, grp string")
    assert rows(ranking.numbered(df, [F.col("id")]), "id", "seq") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    by_group = ranking.numbered(df, [F.col("id")], by=["grp"], totals={"size": F.count("*")})
    assert rows(by_group, "id", "seq", "size") == [(1, 1, 2), (2, 1, 2), (3, 2, 2), (4, 2, 2)]


def test_numbered_on_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, grp string")
    assert ranking.numbered(df, [F.col("id")], by=["grp"]).count() == 0


def test_hot_group_is_sorted_by_several_tasks(spark):
    _, df = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = df.orderBy("grp", F.col("value").asc_nulls_last(), F.xxhash64("id"))
        tasks = Counter(r[0] for r in ordered.filter("grp = 'hot'").select(F.spark_partition_id()).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(tasks.values()) < 0.7 * sum(tasks.values())


def test_quantiles_equal_numpy(spark):
    data, df = skewed(spark)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    found = {r.grp: r for r in ranking.quantiles(df, ["grp"], ["value"], "id", probs).collect()}
    for group in {g for _, g, _ in data}:
        values = [v for _, g, v in data if g == group and v is not None]
        r = found[group]
        assert (r.n_rows, r.n) == (sum(g == group for _, g, _ in data), len(values))
        assert (r["min"], r["max"]) == (min(values), max(values))
        assert r["mean"] == pytest.approx(np.mean(values))
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("values, expected", [
    ([None, None], (2, 0, None, None, None)),
    ([7.0], (1, 1, 7.0, 7.0, 7.0)),
    ([1.0, 2.0], (2, 2, 1.25, 1.5, 1.75)),
    ([4.0, 1.0, None, 3.0, 2.0], (5, 4, 1.75, 2.5, 3.25)),
    ([1.0, 2.0, 3.0, 4.0, 5.0], (5, 5, 2.0, 3.0, 4.0)),
])
def test_quantiles_of_few_values(spark, values, expected):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    found = ranking.quantiles(df, [], ["v"], "id", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    assert rows(found, "n_rows", "n", "q1", "median", "q3") == [expected]


def test_top_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "g string, x int")
    assert rows(ranking.top_rows(df, 2, [F.desc("x")], ["g"])) == [("a", 2), ("a", 3), ("b", 9)]
    assert rows(ranking.top_rows(df, 1, [F.desc("x")])) == [("b", 9)]

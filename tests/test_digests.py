"""Digests of buckets, comparisons that join only what differs, and issuers kept from snapshot to snapshot."""

import random

import pytest
from pyspark.sql import functions as F

from bondmarts.operators import digests, issuers, quality
from bondmarts.plans.issuer_store import IssuerStore
from bondmarts.sources import snapshots
from bondmarts.storage import store
from conftest import rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def table(spark):
    rng = random.Random(5)
    values = [(i, rng.choice([None, 1.5, float("nan"), -0.0, 7.25]), rng.choice([None, i])) for i in range(400)]
    return store(spark.createDataFrame(values, "key int, x double, y int"))


def test_order_and_placing_do_not_count_but_rows_do(spark, table):
    columns = [F.col("x"), F.col("y")]
    same = table.repartition(7).orderBy(F.desc("key"))
    assert digests.differing(table, same, "key", columns) == []
    one = F.col("key") == 7
    for changed in (
        table.filter(~one), table.unionAll(table.filter(one)), table.withColumn("y", F.when(one, -1).otherwise(F.col("y"))),
        table.withColumn("x", F.when(one, 99.0).otherwise(F.col("x"))),
    ):
        want = [r.b for r in table.filter(one).select(digests.bucket("key").alias("b")).collect()]
        assert digests.differing(table, changed, "key", columns) == want
    # A null moved to another column, and pairs of equal rows that cancel out in an exclusive-or.
    a, b = (spark.createDataFrame([r], "key string, y int, z int") for r in (("k", None, 1), ("k", 1, None)))
    assert digests.differing(a, b, "key", [F.col("y"), F.col("z")]) != []
    a, b = (spark.createDataFrame([r, r], "key string, y int") for r in (("k7", 1), ("k7", 2)))
    assert digests.differing(a, b, "key", [F.col("y")]) != []


def test_rows_without_a_key_always_differ(spark):
    a = spark.createDataFrame([(None, 1.0)], "key string, x double")
    assert digests.differing(a, a, "key", [F.col("x")]) == [digests.NO_KEY]
    assert rows(quality.table_diff(a, a, "key", ["x"]), "compared", "only_a", "only_b", "within") == [(0, 1, 1, False)]


@pytest.mark.parametrize("buckets", [1, 16, digests.BUCKETS])
def test_comparison_is_that_of_all_rows(table, buckets):
    """However many buckets are joined the rows are the same; a key of another type takes the plain join."""
    one = F.col("key").isin(3, 30, 300)
    other = table.withColumn("x", F.when(one, 3.0).otherwise(F.col("x"))).filter("key <> 11").unionAll(table.filter("key = 12"))
    for b in (table, other, table.limit(0)):
        got = rows(quality.table_diff(table, b, "key", ["x", "y"], buckets=buckets))
        want = quality.table_diff(table, b.withColumn("key", F.col("key").cast("long")), "key", ["x", "y"])
        assert str(got) == str(rows(want))
        keys = {r.key for r in table.collect()}, {r.key for r in b.collect()}
        assert sorted(rows(quality.key_diff(table, b, "key", buckets))) == sorted([*((k, "a") for k in keys[0] - keys[1]), *((k, "b") for k in keys[1] - keys[0])])


def test_equal_tables_start_no_join(table):
    same = store(table.repartition(3))
    assert "Join" not in plan(quality.table_diff(table, same, "key", ["x", "y"]))
    assert "Aggregate" not in plan(quality.key_diff(table, same, "key"))
    assert "Join" in plan(quality.table_diff(table, table.filter("key <> 1"), "key", ["x"]))


def bond(code, issuer, **more):
    return {"security_code": code, "issuer": issuer, "province": "P", "city": "C", "rating": "AA", "issuer_agency": "x", "level_rank": 1, **more}


def test_issuers_of_the_next_snapshot(spark, bonds, tmp_path):
    root = str(tmp_path)
    first = [bond(f"{i:03}", f"i{i % 40}", level_rank=i % 3) for i in range(200)] + [bond("900", None), bond("901", "unrated", rating=" ")]
    changed = [b for b in first if b["issuer"] != "i5" and b["security_code"] != "007"]  # an issuer and a bond go
    changed += [bond("300", "i9", level_rank=9, city="D"), bond("301", "new")]  # a stronger bond and an issuer come
    changed[3] = {**changed[3], "rating": "AAA"}
    fiscal = spark.createDataFrame([("C", 700.0, "P", "2021"), ("D", 90.0, "P", "2021")], "city string, revenue double, province string, fiscal_year string")
    kept = IssuerStore(spark, root, buckets=64)
    for date, own in (("20230101", first), ("20230201", changed), ("20230301", first)):
        snapshots.write_snapshot(bonds(*own), root, date)
    assert kept.manifest("20230101") is None
    with pytest.raises(ValueError):
        kept.issuers("20230101")
    written = [kept.write(date) for date in ("20230101", "20230201", "20230301")]
    for date in ("20230101", "20230201", "20230301"):
        full = issuers.enriched(snapshots.bond(spark, root, date).drop("snapshot_date"), fiscal)
        got = kept.enriched(date, fiscal)
        assert got.columns == full.columns and got.exceptAll(full).isEmpty() and full.exceptAll(got).isEmpty()
    touched = spark.createDataFrame([("i5",), ("i7",), ("i9",), ("new",), (changed[3]["issuer"],)], "issuer string")
    buckets = {r.b for r in touched.select(digests.bucket("issuer", 64).alias("b")).collect()}
    assert digests.NO_KEY in written[0] and set(written[1]) <= buckets and len(buckets) - len(written[1]) <= 1
    assert written[2] == [] and kept.write("20230201") == written[1]


def test_issuers_of_a_snapshot_without_rated_bonds(spark, bonds, tmp_path):
    kept = IssuerStore(spark, str(tmp_path))
    snapshots.write_snapshot(bonds(bond("1", "a", rating=None)), str(tmp_path), "20230101")
    assert kept.write("20230101") == [] and kept.enriched("20230101", None).count() == 0

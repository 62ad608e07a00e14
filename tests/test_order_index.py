import random

import pytest
from pyspark.sql import functions as F

from bondmarts.operators import filters
from bondmarts.operators.order_index import open_index, write_index
from conftest import rows



def order():
    return [F.col("value").desc_nulls_last(), F.col("id")]


def listed(data, where=lambda d: True):
    """(id, place) of the rows that meet a condition, by group."""
    found = {}
    for group in {d[1] for d in data}:
        own = sorted((d for d in data if d[1] == group and where(d)), key=lambda d: (d[2] is None, -(d[2] or 0), d[0]))
        found[group] = [(d[0], i + 1) for i, d in enumerate(own)]
    return found


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, some in none, many equal and some null values; blocks far smaller than a task."""
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else None if i % 7 == 0 else f"g{i % 5}", None if i % 11 == 0 else float(rng.randrange(20))) for i in range(3000)]
    rng.shuffle(data)
    return data, write_index(spark.createDataFrame(data, "id int, grp string, value double").repartition(8), order(), ("grp",), block_rows=64)


@pytest.mark.parametrize("where, meets", [(None, lambda d: True), ("id % 4 = 1", lambda d: d[0] % 4 == 1), ("value = 3", lambda d: d[2] == 3.0), ("false", lambda d: False)])
def test_listings_equal_row_number(skewed, where, meets):
    data, index = skewed
    expected = [(g, *pair) for g, pairs in listed(data, meets).items() for pair in pairs]
    assert rows(index.listing(where and F.expr(where)), "grp", "id", "seq") == sorted(expected, key=repr)


@pytest.mark.parametrize("group", ["hot", "g1", None, "absent"])
@pytest.mark.parametrize("first, size", [(1, 10), (60, 10), (129, 200), (1990, 500), (5000, 5)])
def test_pages_are_cut_from_the_listing(skewed, group, first, size):
    data, index = skewed
    for where, meets in ((None, lambda d: True), (F.col("id") % 4 == 1, lambda d: d[0] % 4 == 1)):
        expected = [p for p in listed(data, meets).get(group, []) if first <= p[1] < first + size]
        page = index.page(first, size, {"grp": group}, where)
        assert sorted(rows(page, "id", "seq"), key=lambda r: r[1]) == expected and page.columns == ["id", "grp", "value", "seq"]


def test_page_reads_only_its_blocks(skewed):
    _, index = skewed
    page = index.page(200, 20, {"grp": "hot"})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_pos" in plan and "LessThanOrEqual(_pos" in plan
    bounds = index.blocks.filter("grp = 'hot'").orderBy("_low").collect()
    assert len(bounds) > 20 and max(r["_rows"] for r in bounds) <= 64


def test_pages_need_their_group(skewed):
    _, index = skewed
    for wrong in (lambda: index.page(1, 5), lambda: index.page(1, 5, {"value": 1.0}), lambda: index.page(0, 5, {"grp": "hot"}), lambda: index.page(1, 0, {"grp": "hot"})):
        with pytest.raises(ValueError):
            wrong()


def test_whole_table_kept_in_a_folder_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "c")], "id int, name string")
    write_index(df, [F.desc("id")], path=str(tmp_path / "index"), block_rows=1)
    index = open_index(spark, str(tmp_path / "index"), ())
    assert rows(index.listing(name="n"), "id", "n") == [(1, 3), (2, 2), (3, 1)]
    assert rows(index.page(2, 1), "id", "seq") == [(2, 2)]
    none = write_index(df.limit(0), [F.col("id")], ("name",))
    assert none.listing().count() == 0 and none.page(1, 5, {"name": "a"}).count() == 0


def test_case_and_issuer_lists_from_one_index_each(spark, bonds):
    names = ["甲评级", "乙评级", None, "甲评级,乙评级"]
    df = bonds(*[
        {"issuer": f"i{n % 9}", "province": "PQ"[n % 2], "rating": "AA" if n % 3 else "A", "rating_rank": n % 3, "issue_amount": None if n % 5 == 0 else float(n % 4), "issuer_agency": names[n % 4]}
        for n in range(40)
    ]).withColumn("city_fiscal", F.lit(None).cast("double"))
    index = filters.case_index(df)
    for agency, wanted in (("甲", {}), ("乙", {"rating": "AA"}), ("丙", {}), ("乙", {"rating": ""})):
        expected = rows(filters.case_list(df, agency, **wanted), "province", "seq", "security_code")
        assert rows(index.listing(filters.is_case(agency, **wanted)), "province", "seq", "security_code") == expected
        page = index.page(2, 3, {"province": "Q"}, filters.is_case(agency, **wanted))
        assert rows(page, "province", "seq", "security_code") == [r for r in expected if r[0] == "Q" and 2 <= r[1] <= 4]
    e = df.dropDuplicates(["issuer"])
    assert rows(filters.issuer_index(e).listing(filters.matches(rating="A")), "issuer", "seq") == rows(filters.issuer_list(e, rating="A"), "issuer", "seq")

import pytest
from pyspark.sql import functions as F

from bondmarts import constants as K
from bondmarts.operators import agency, bench, city, decisions, issuers, kpi, lists, underwriter
from conftest import rows

BASE = {"province": "P", "city": "C", "rating": "AA", "admin_level": "地市级", "level_rank": 5, "rating_rank": 3}


def bond(issuer, **more):
    return {**BASE, "issuer": issuer, **more}


def test_province_kpi(spark, bonds):
    df = bonds(
        bond("甲", issue_amount=1.5, coupon=2.0, issuer_agency="x"), bond("甲", issue_amount=None, coupon=None, issuer_agency=""),
        bond("乙", rating=" ", issue_amount=2.0, coupon=4.0, city=None), bond("丙", province=None), bond(None, rating=None, city="D"),
    )
    assert rows(kpi.province_kpi(df)) == [("P", 2, 1, 4, 3.5, 3.0, 2, 2)]


def test_median_sized_province(spark, bonds):
    df = bonds(*[bond(f"i{n}", province=p) for p, count in (("A", 3), ("B", 1), ("C", 2), ("D", 5)) for n in range(count)])
    assert rows(kpi.median_sized_province(df)) == [("A", 3)]


def test_market_share_shares_and_blank_names(spark, bonds):
    df = bonds(
        bond("甲", issuer_agency="x"), bond("甲", issuer_agency=" x "), bond("乙", issuer_agency="y"), bond("丙", issuer_agency="y"),
        bond("丁", issuer_agency="  "), bond("戊", issuer_agency=""), bond("己"), bond("庚", issuer_agency="x,y"),
    )
    share = agency.agency_market_share(df)
    assert rows(share) == [
        ("", "P", 1, 1, 20.0, 1.0), ("x", "P", 1, 2, 20.0, 2.0), ("x,y", "P", 1, 1, 20.0, 1.0), ("y", "P", 2, 2, 40.0, 1.0),
    ]
    split = agency.agency_market_share(df, split=True, drop_blank=True)
    assert rows(split, "agency", "issuers", "bonds") == [("x", 2, 3), ("y", 3, 3)]
    assert [r.agency for r in agency.agency_ranking(split).orderBy("seq").collect()] == ["y", "x"]


def test_agency_list_counts_issuer_bonds(spark, bonds):
    df = bonds(bond("甲", issuer_agency="x", bond_agency="y"), bond("乙", issuer_agency="x"), bond("丙", issuer_agency=" ", bond_agency=None))
    assert rows(agency.agency_list(df)) == [("P", "x", 2), ("P", "y", 0)]


@pytest.fixture
def matrix_bonds(spark, bonds):
    df = bonds(
        bond("甲", issuer_agency="x"), bond("乙", issuer_agency="x"), bond("丙", issuer_agency="y", admin_level="省级", level_rank=7),
        bond("丁", issuer_agency="y"), bond("戊", issuer_agency="z", admin_level="区县级", level_rank=1), bond("己", issuer_agency="y"),
        bond("庚", bond_agency="w", admin_level="", level_rank=0),
    )
    return df.withColumn("city_fiscal", F.when(F.col("issuer") != "戊", F.lit(150.0)))


def counts(matrix):
    return {(r.agency, r.category): r.issuers for r in matrix.collect()}


def test_competition_matrix_is_zero_filled(matrix_bonds):
    level = agency.competition_matrix(matrix_bonds, "level", own="z")
    got = counts(level)
    assert len(got) == 4 * 4 and got["x", "地市级"] == 2 and got["y", "省级"] == 1 and got["w", ""] == 0
    order = {r.agency: r.agency_order for r in level.select("agency", "agency_order").distinct().collect()}
    assert sorted(order, key=order.get) == ["z", "y", "x", "w"]
    places = {r.category: r.category_order for r in level.collect()}
    assert places["省级"] < places["地市级"] < places["区县级"]
    fiscal = agency.competition_matrix(matrix_bonds, "fiscal", own="absent")
    assert counts(fiscal)["y", "100-200亿"] == 3 and sum(counts(fiscal).values()) == 5
    assert not fiscal.filter("is_own").count() and fiscal.count() == 4 * 7


def test_wide_matrix(matrix_bonds):
    wide = agency.competition_matrix(matrix_bonds, "rating", wide=True)
    assert wide.columns == ["province", "agency", "is_own", "agency_order", "AAA", "AA+", "AA", "AA-", "A+", "A"]
    assert rows(wide, "agency", "AA", "AAA") == [("w", 0, 0), ("x", 2, 0), ("y", 3, 0), ("z", 1, 0)]
    with pytest.raises(ValueError, match="long form"):
        agency.competition_matrix(matrix_bonds, "city", wide=True)


def test_wide_matrix_counts_other_levels(matrix_bonds):
    town = matrix_bonds.withColumn("admin_level", F.when(F.col("admin_level") == "地市级", "镇级").otherwise(F.col("admin_level")))
    long = agency.competition_matrix(town, "level")
    wide = agency.competition_matrix(town, "level", wide=True)
    assert wide.agg(F.sum("其他")).first()[0] == long.filter("category not in ('省级', '区县级')").agg(F.sum("issuers")).first()[0] > 0


def test_negative_revenue_has_no_category(matrix_bonds):
    negative = matrix_bonds.withColumn("city_fiscal", F.lit(-1.0))
    assert agency.competition_matrix(negative, "fiscal").agg(F.sum("issuers")).first()[0] == 0


def test_rank_and_position_in_category(matrix_bonds):
    matrix = agency.competition_matrix(matrix_bonds, "level", own="x")
    ranks = {r.category: r for r in decisions.rank_in_category(matrix).collect()}
    assert set(ranks) == {"省级", "地市级", "区县级"}
    tied = ranks["地市级"]
    assert (tied.leader, tied.leader_issuers, tied.own_issuers, tied.own_rank, tied.own_share_pct) == ("x", 2, 2, 1, 50.0)
    assert (ranks["省级"].leader, ranks["省级"].own_rank, ranks["省级"].own_share_pct) == ("y", 2, 0.0)
    classes = {r.category: (r.strong, r.weak, r.blank) for r in decisions.classify_positions(matrix).collect()}
    assert classes == {"地市级": (True, False, False), "省级": (False, False, True), "区县级": (False, False, True), "": (False, False, True)}
    none = decisions.rank_in_category(agency.competition_matrix(matrix_bonds, "level", own="absent"))
    assert {(r.own_issuers, r.own_rank) for r in none.collect()} == {(0, None)}


@pytest.mark.parametrize("dimension", ["fiscal", "level", "rating", "city"])
@pytest.mark.parametrize("own", ["x", "w", "absent", None])
def test_sparse_matrix_gives_the_positions_of_the_dense_one(matrix_bonds, bonds, dimension, own):
    more = bonds(
        bond("n1", province="Q", issuer_agency="x", city=None), bond("n2", province="Q", issuer_agency=" y "), bond("n3", province="R", issuer_agency=None),
        bond("n4", province=None, issuer_agency="x"), bond("n5", province="Q", issuer_agency="", rating=None), bond("n6", province="S", issuer_agency="w", admin_level=""),
    ).withColumn("city_fiscal", F.lit(50.0))
    df = matrix_bonds.unionByName(more)
    dense, sparse = agency.competition_matrix(df, dimension, own), agency.sparse_matrix(df, dimension, own)
    assert rows(sparse) == rows(dense.filter("issuers > 0 or agency_order = 1"), *sparse.columns)
    assert rows(decisions.rank_in_category(sparse)) == rows(decisions.rank_in_category(dense))
    assert rows(decisions.classify_positions(sparse)) == rows(decisions.classify_positions(dense))


def test_weak_needs_two_agencies_above(spark, bonds):
    names = ["x"] * 1 + ["y"] * 2 + ["z"] * 3
    df = bonds(*[bond(f"i{n}", issuer_agency=a) for n, a in enumerate(names)]).withColumn("city_fiscal", F.lit(1.0))
    def classes(own):
        return rows(decisions.classify_positions(agency.competition_matrix(df, "rating", own)), "agencies_above", "strong", "weak", "blank")
    assert classes("x") == [(2, False, True, False)]
    assert classes("y") == [(1, False, False, False)]
    assert classes("z") == [(0, True, False, False)]


@pytest.fixture
def e(spark, bonds, fiscal):
    df = bonds(
        bond("甲", city="C1", rating="AAA", rating_rank=5), bond("乙", city="C1"), bond("丙", city="C1", admin_level="省级", level_rank=7),
        bond("丁", city="C2"), bond("戊", city="C3"), bond("己", city="C4"), bond("庚", city=None),
    )
    return issuers.enriched(df, fiscal(("C1", 10.0, "P"), ("C2", 20.0, "P"), ("C3", 20.0, "P")))


def test_city_credit_overview(e):
    got = {(r.city, r.rating, r.admin_level): r for r in city.city_credit_overview(e).collect()}
    assert len(got) == 6 and {r.cities for r in got.values()} == {5}
    assert {c: r.fiscal_rank for (c, _, _), r in got.items()} == {"C2": 1, "C3": 1, "C1": 2, "C4": 3}
    assert (got["C1", "AA", "省级"].city_issuers, got["C1", "AA", "省级"].rating_issuers, got["C1", "AA", "省级"].level_issuers) == (3, 2, 1)
    served = [(r.city, r.rating) for r in city.city_overview_listing(city.city_credit_overview(e)).collect()]
    assert served[:2] == [("C2", "AA"), ("C3", "AA")] and served[2] == ("C1", "AAA")
    by_text = [r.rating for r in city.city_overview_listing(city.city_credit_overview(e), by_text=True).collect()]
    assert by_text[2] == "AAA"


def test_city_bubbles(spark, e):
    coords = spark.createDataFrame([("C1", 100.0, 30.0), ("C2", 102.0, 32.0), ("C4", 104.0, 34.0)], "city string, lon double, lat double")
    got = {r.city: r for r in city.city_bubbles(e, coords).collect()}
    assert set(got) == {"C1", "C2", "C4"}
    assert (got["C1"].top_rating, got["C1"].fiscal_rank, got["C1"].ranked_cities, got["C1"].marker_size) == ("AAA", 3, 3, 18.5)
    assert (got["C2"].fiscal_rank, got["C4"].fiscal_rank, got["C4"].marker_size) == (1, None, 11.5)
    assert rows(city.map_centre(e, coords)) == [(102.0, 32.0)]
    assert rows(city.map_centre(e.filter("false"), coords)) == [(104.0, 30.0)]


def test_marker_size_is_limited(spark, bonds):
    df = bonds(*[bond(f"i{n}") for n in range(12)]).withColumn("city_fiscal", F.lit(None).cast("double"))
    coords = spark.createDataFrame([("C", 1.0, 2.0)], "city string, lon double, lat double")
    assert city.city_bubbles(df, coords).first().marker_size == 40.0


def test_known_coordinates(spark):
    assert city.known_coords(spark).count() == 93
    assert rows(city.known_coords(spark).filter("city = '成都市'")) == [("成都市", 104.07, 30.67)]


def test_empty_cities_and_city_orders(e, fiscal):
    f = fiscal(("C1", 1.0, "P"), ("C9", 1.0, "P"), (None, 1.0, "P"))
    assert rows(city.empty_cities(e, f, rating="AAA")) == [("C2",), ("C3",), ("C4",), ("C9",)]
    assert rows(city.empty_cities(e, None)) == []
    assert [r.city for r in city.cities_listing(city.cities_by_fiscal(e)).collect()] == ["C2", "C3", "C1", "C4"]
    breakdown = [(r.rating, r.admin_level, r.issuers) for r in city.city_breakdown(e).filter("city = 'C1'").orderBy("seq").collect()]
    assert breakdown == [("AAA", "地市级", 1), ("AA", "省级", 1), ("AA", "地市级", 1)]


def test_financial_bench_keeps_raw_groups_and_labels_blanks(spark, bonds):
    df = bonds(
        bond("甲", total_assets=1.0, city=" "), bond("乙", total_assets=2.0, city=" "), bond("丙", total_assets=None, city=" "),
        bond("丁", total_assets=9.0, city=None), bond("戊", total_assets=9.0, province=""), bond("己", total_assets=9.0, rating=" "),
    ).withColumn("city_fiscal", F.lit(None).cast("double"))
    got = bench.financial_bench(df)
    columns = ["city", "sample_size", "total_assets_min", "total_assets_q1", "total_assets_median", "total_assets_mean", "total_assets_q3", "total_assets_max"]
    assert rows(got, *columns) == [
        ("未知城市", 1, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0), ("未知城市", 3, 1.0, 1.25, 1.5, 1.5, 1.75, 2.0),
    ]
    assert got.count() == 2 and len(got.columns) == 5 + 30


def test_bench_slice_and_cube_agree(e):
    with_assets = e.withColumn("total_assets", F.length("issuer") + F.col("rating_rank") * 1.0)
    cube = bench.bench_cube(with_assets)
    for wanted in ({}, {"city": "C1"}, {"rating": "AA"}, {"city": "C1", "admin_level": "省级", "rating": "AA"}):
        labels = {c: wanted.get(c, K.ALL) for c in ("city", "admin_level", "rating")}
        cell = cube.filter("metric = 'total_assets'")
        for c, label in labels.items():
            cell = cell.filter(F.col(c) == label)
        one = bench.bench_slice(with_assets, **wanted)
        expected = rows(cell, "n_rows", "min", "q1", "median", "mean", "q3", "max")
        assert rows(one, "sample_size", *[f"total_assets_{s}" for s in bench.STATS]) == expected
    assert rows(bench.bench_slice(with_assets, city="none"), "sample_size", "total_assets_q1") == [(0, None)]
    assert {r.metric for r in bench.issuer_bench(with_assets).collect()} == {"total_assets"}


def test_underwriter_lists(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["A, B", "A,,B", "A,", "A,A", " ", "", None])], "id int, u string")
    kept = lists.exploded(df, "u", "name")
    assert rows(kept) == [(0, "A"), (0, "B"), (1, ""), (1, "A"), (1, "B"), (2, ""), (2, "A"), (3, "A"), (3, "A"), (4, ""), (5, "")]
    assert rows(lists.exploded(df, "u", "name", drop_blank=True).groupBy("id").count()) == [(0, 2), (1, 2), (2, 1), (3, 2)]


def test_underwriter_stats(spark, bonds, fiscal):
    df = bonds(
        bond("甲", underwriters="A,B", issue_amount=1.0), bond("甲", underwriters="A,A", issue_amount=2.0), bond("乙", underwriters="B", issue_amount=4.0),
        bond("丙", underwriters="B, ", issue_amount=8.0, province=None), bond("丁", underwriters="A", rating=None, issue_amount=None), bond("戊", underwriters=""),
    )
    e = issuers.enriched(df, fiscal(("C", 150.0, "P")))
    got = underwriter.underwriter_stats(df, e)
    assert rows(got, "province", "rating", "fiscal_band", "underwriter", "issuers", "bonds", "issue_amount", "bonds_per_issuer", "seq") == [
        ("P", "AA", "100-200亿", "A", 1, 3, 5.0, 3.0, 1), ("P", "AA", "100-200亿", "B", 2, 2, 5.0, 1.0, 2),
        ("P", None, "财力未知", "A", 1, 1, None, 1.0, 1),
        ("未知", "AA", "100-200亿", "", 1, 1, 8.0, 1.0, 1), ("未知", "AA", "100-200亿", "B", 1, 1, 8.0, 1.0, 2),
    ]
    totals = underwriter.underwriter_province_stats(df)
    assert rows(totals, "province", "underwriter", "issuers", "bonds", "seq") == [("P", "A", 2, 4, 1), ("P", "B", 2, 2, 2), (None, "B", 1, 1, 1)]


def test_key_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(lists.key_sets(a, b, "k")) == [(1, "a"), (2, "both"), (3, "b")]

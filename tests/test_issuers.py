from pyspark.sql import functions as F

from bondmarts.operators import filters, issuers
from conftest import rows

BASE = {"province": "四川", "city": "成都市", "rating": "AA"}


def bond(issuer, level, code, **more):
    return {**BASE, "issuer": issuer, "level_rank": level, "security_code": code, **more}


def test_dedup_prefers_level_then_code(spark, bonds):
    df = bonds(
        bond("甲", 5, "3", issuer_agency="x"), bond("甲", 5, "2", issuer_agency="y"), bond("甲", 7, "9", issuer_agency="z"),
        bond("乙", 1, "5"), bond("乙", 1, "4", province="浙江"), bond("丙", 7, "1", rating=" "), bond("丁", 7, "1", rating=None),
    )
    e = issuers.enriched(df, None)
    assert rows(e, "issuer", "issuer_agency", "province", "city_fiscal", "fiscal_band") == [
        ("乙", None, "浙江", None, "财力未知"), ("甲", "z", "四川", None, "财力未知"),
    ]


def test_issuer_view_keeps_an_issuer_per_province(spark, bonds):
    df = bonds(bond("乙", 1, "5"), bond("乙", 1, "4", province="浙江"), bond("乙", 1, "3")).withColumn("city_fiscal", F.lit(1.0))
    assert rows(issuers.issuer_view(df), "province", "issuer", "seq") == [("四川", "乙", 1), ("浙江", "乙", 1)]


def test_same_city_name_in_two_provinces_shares_the_maximum_by_default(spark, bonds, fiscal):
    df = bonds(bond("甲", 1, "1", province="A", city="同"), bond("乙", 1, "2", province="B", city="同"), bond("丙", 1, "3", city="无"))
    f = fiscal(("同", 150.0, "A"), ("同", 900.0, "B"), ("同", 950.0, "B", "2020"), ("空", None, "A"))
    assert rows(issuers.enriched(df, f), "issuer", "city_fiscal", "fiscal_band") == [
        ("丙", None, "财力未知"), ("乙", 950.0, "700-1000亿"), ("甲", 950.0, "700-1000亿"),
    ]
    by_province = issuers.enriched(df, f, keys=("province", "city"), fiscal_year="2021")
    assert rows(by_province, "issuer", "city_fiscal") == [("丙", None), ("乙", 900.0), ("甲", 150.0)]


def test_join_without_fiscal_columns(spark, bonds):
    no_revenue = spark.createDataFrame([("成都市",)], "city string")
    joined = issuers.with_city_fiscal(bonds(bond("甲", 1, "1")), no_revenue)
    assert rows(joined, "issuer", "city_fiscal") == [("甲", None)]


def test_province_slice_takes_one_province(spark, bonds):
    df = bonds(
        bond("甲", 1, "1"), bond("乙", 1, "2", province="四川省"), bond("丙", 1, "3", province=None), bond("丁", 1, "4", province="浙江"),
        bond("戊", 1, "5", province="四川北部"), bond("己", 1, "6", province="省"),
    )
    assert rows(filters.province_slice(df, "省"), "issuer") == [("己",)]
    assert rows(filters.province_slice(df, "四川省"), "issuer") == [("乙",), ("甲",)]


def test_filter_eq_skips_empty_values(spark, bonds):
    df = bonds(bond("甲", 1, "1"), bond("乙", 1, "2", city="绵阳市"), bond("丙", 1, "3", rating=None))
    assert rows(filters.filter_eq(df, city="成都市", rating="", admin_level=None), "issuer") == [("丙",), ("甲",)]


def test_agency_clients_look_at_both_agencies(spark, bonds):
    df = bonds(
        bond("甲", 1, "1", issuer_agency="鹏元资信评估有限公司"), bond("乙", 1, "2", bond_agency="x, 鹏元资信评估有限公司"),
        bond("丙", 1, "3", issuer_agency="x", bond_agency=None), bond(None, 1, "4", issuer_agency="鹏元"), bond("甲", 1, "5", bond_agency="鹏元"),
    )
    assert rows(filters.agency_clients(df, "鹏元")) == [("乙",), ("甲",)]
    assert rows(filters.agency_client_counts(df, "鹏元")) == [("四川", 2)]


def test_case_list_sorts_nulls_last(spark, bonds):
    df = bonds(
        bond("甲", 5, "1", issuer_agency="x1", issue_amount=1.0), bond("乙", 5, "2", issuer_agency="x2", issue_amount=None),
        bond("丙", 7, "3", issuer_agency="x", issue_amount=0.5), bond("丁", 5, "4", issuer_agency="y"),
    ).withColumn("city_fiscal", F.when(F.col("issuer") != "丙", F.lit(9.0)))
    listed = filters.case_list(df, "x")
    assert [tuple(r) for r in listed.orderBy("seq").select("seq", "issuer").collect()] == [(1, "甲"), (2, "乙"), (3, "丙")]
    assert filters.case_list(df, "x", rating="AAA").count() == 0


def test_financial_coverage(spark, bonds):
    df = bonds(bond("甲", 1, "1", total_assets=1.0), bond("乙", 1, "2", total_assets=0.0), bond("丙", 1, "3"), bond("丁", 1, "4", total_assets=2.0))
    assert rows(filters.financial_coverage(df)) == [("四川", 4, 2, 50.0)]
    assert rows(filters.financial_coverage(df.filter("false"), by=())) == [(0, 0, 0.0)]

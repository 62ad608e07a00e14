import pytest
from pyspark.sql import functions as F

from bondmarts.functions import numeric, text
from conftest import rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_round_scales_before_rounding(spark):
    df = column(spark, [1.005, 0.285, 2.675, -2.5, None], "double")
    assert [r[0] for r in df.select(numeric.round_to("x", 2)).collect()] == [1.0, 0.28, 2.68, -2.5, None]
    assert [r[0] for r in df.select(numeric.round_to("x", 0)).collect()] == [1.0, 0.0, 3.0, -3.0, None]


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(numeric.ratio("a", "b")).collect()] == [None, 0.25]


def test_fiscal_bands_are_half_open(spark):
    values = [-1.0, 0.0, 99.99, 100.0, 200.0, 300.0, 500.0, 700.0, 999.99, 1000.0, 100000.0, None]
    got = [r[0] for r in column(spark, values, "double").select(numeric.fiscal_band("x")).collect()]
    assert got == [
        "0-100亿", "0-100亿", "0-100亿", "100-200亿", "200-300亿", "300-500亿", "500-700亿", "700-1000亿", "700-1000亿",
        "1000亿以上", "1000亿以上", "财力未知",
    ]


def test_to_number_turns_bad_text_and_nan_to_null(spark):
    got = [r[0] for r in column(spark, ["1.5", " 2 ", "-", "暂无", "", "NaN", None]).select(numeric.to_number("x")).collect()]
    assert got == [1.5, 2.0, None, None, None, None, None]


def test_trim_spaces_removes_unicode_spaces_but_no_tab(spark):
    got = [r[0] for r in column(spark, ["　A  ", "\tA ", " ", None]).select(text.trim_spaces("x")).collect()]
    assert got == ["A", "\tA", "", None]


def test_strip_text_removes_all_white_space(spark):
    got = [r[0] for r in column(spark, ["\t　A B\n", " x\x85"]).select(text.strip_text("x")).collect()]
    assert got == ["A B", "x"]


@pytest.mark.parametrize("value, expected", [
    (" 联合资信\t", "联合资信评估股份有限公司"),
    ("联合信用评级有限公司", "联合资信评估股份有限公司"),
    ("中证鹏元资信评估股份有限公司", "中证鹏元资信评估股份有限公司"),
    ("大公国际, 联合资信", "大公国际, 联合资信"),
    (" 别的机构 ", "别的机构"),
    ("", ""),
    (None, None),
])
def test_normalize_agency(spark, value, expected):
    assert column(spark, [value]).select(text.normalize_agency("x")).first()[0] == expected


def test_short_names(spark):
    agencies = column(spark, ["东方金诚国际信用评估有限公司", "某某某某某公司", None])
    assert [r[0] for r in agencies.select(text.agency_short("x")).collect()] == ["东方金诚", "某某某某", None]
    cities = column(spark, ["攀枝花市", "西双版纳傣族自治州", "成都市", None])
    assert [r[0] for r in cities.select(text.city_short("x")).collect()] == ["攀枝花", "西双版纳", "成都", None]


def test_levels(spark):
    df = column(spark, ["地市", "地市级", "省(开发区)", "县", None]).select(text.with_level_suffix("x").alias("x"))
    got = [tuple(r) for r in df.select("x", text.level_rank("x")).collect()]
    assert got == [("地市级", 5), ("地市级", 5), ("省(开发区)级", 6), ("县级", 0), (None, 0)]


def test_rating_rank(spark):
    df = column(spark, ["AAA", "A", "BBB", None])
    assert [r[0] for r in df.select(text.rating_rank("x")).collect()] == [5, 0, 0, 0]


def test_joined_names_are_distinct_and_sorted(spark):
    df = column(spark, ["乙", "甲", "乙", None])
    assert df.agg(text.joined_names("x")).first()[0] == "乙、甲"
    assert df.filter("false").agg(text.joined_names("x")).first()[0] == ""


def test_not_blank_is_never_null(spark):
    df = column(spark, ["A", " ", None])
    assert rows(df.filter(~text.not_blank(F.col("x")))) == [(" ",), (None,)]

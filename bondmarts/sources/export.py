"""Case lists as files."""

from pyspark.sql import DataFrame

# Headers of an exported case list.
CASE_HEADERS = {
    "province": "省份", "seq": "序号", "issuer": "发行人中文名称", "city": "城市",
    "city_fiscal": "一般公共预算收入(亿元)", "admin_level": "行政级别", "rating": "主体评级",
    "security_code": "证券代码", "security_name": "证券简称", "underwriters": "主承销商",
    "bond_class": "Wind债券二级分类", "issue_amount": "发行总额(亿元)", "coupon": "票面利率(%)",
}


# A missing value is shown as a dash, which keeps it apart from an empty text; spaces are data.
CSV_OPTIONS = {
    "header": True, "nullValue": "—", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def renamed_cases(cases: DataFrame) -> DataFrame:
    return cases.withColumnsRenamed({c: h for c, h in CASE_HEADERS.items() if c in cases.columns})


def export_cases(cases: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write a numbered case list in order, as CSV with a header or as Parquet. Files are split by range."""
    keys = [c for c in ("province", "seq") if c in cases.columns]
    ordered = cases.orderBy(*keys)
    if file_format == "csv":
        renamed_cases(ordered).write.options(**CSV_OPTIONS).csv(path)
    else:
        renamed_cases(ordered).write.parquet(path)

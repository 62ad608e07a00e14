"""Slices: province, optional equality, agency clients, case and issuer lists."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.functions.numeric import ratio
from bondmarts.functions.text import province_key, trim_spaces
from bondmarts.operators.order_index import OrderIndex, write_index
from bondmarts.operators.ranking import numbered


def province_slice(df: DataFrame, name: str) -> DataFrame:
    """Rows of one province, spelled with or without its kind (四川省 or 四川) on either side."""
    return df.filter(province_key("province") == province_key(F.lit(name)))


def matches(**wanted) -> Column:
    """column == value for every value given; empty or None means no condition."""
    conditions = [F.col(column) == value for column, value in wanted.items() if value]
    return reduce(and_, conditions, F.lit(True))


def filter_eq(df: DataFrame, **wanted) -> DataFrame:
    return df.filter(matches(**wanted))


def rated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rating").isNotNull() & (trim_spaces("rating") != ""))


def names_agency(agency: str) -> Column:
    """The issuer or the bond is rated by an agency whose name contains the text."""
    hit = F.col("issuer_agency").contains(agency) | F.col("bond_agency").contains(agency)
    return F.coalesce(hit, F.lit(False))


def agency_clients(bond: DataFrame, agency: str) -> DataFrame:
    """Issuers the agency rates, by issuer or bond rating."""
    return bond.filter(names_agency(agency) & F.col("issuer").isNotNull()).select("issuer").distinct()


def agency_client_counts(bond: DataFrame, agency: str) -> DataFrame:
    return (
        bond.filter(names_agency(agency)).groupBy("province").agg(F.count_distinct("issuer").alias("client_issuers"))
    )


def strongest_first(last: str) -> list[Column]:
    """The listing order: fiscal revenue, level, rating, then one more measure, all descending."""
    return [F.col(c).desc_nulls_last() for c in ("city_fiscal", "level_rank", "rating_rank", last)]


CASE_COLUMNS = [
    "issuer", "city", "city_fiscal", "admin_level", "rating", "security_code", "security_name", "underwriters", "bond_class", "issue_amount", "coupon",
]


def _case_order() -> list[Column]:
    return [*strongest_first("issue_amount"), F.col("security_code")]


def _issuer_order() -> list[Column]:
    return [*strongest_first("total_assets"), F.col("issuer")]


def case_list(bond_with_fiscal: DataFrame, agency: str, by=("province",), **wanted) -> DataFrame:
    """Bonds of issuers rated by the agency, in listing order, numbered per `by`."""
    cases = filter_eq(bond_with_fiscal.filter(F.col("issuer_agency").contains(agency)), **wanted)
    columns = [c for c in CASE_COLUMNS if c not in by]
    listed = numbered(cases.select(*by, *columns, "level_rank", "rating_rank"), _case_order(), by=by)
    return listed.select(*by, "seq", *columns)


def case_index(bond_with_fiscal: DataFrame, path: str | None = None) -> OrderIndex:
    """Bonds sorted once by province and listing order: the case lists of all agencies and filters, whole or by page, are read from it."""
    columns = [*CASE_COLUMNS, "issuer_agency", "level_rank", "rating_rank"]
    return write_index(bond_with_fiscal.select("province", *columns), _case_order(), ("province",), path)


def is_case(agency: str, **wanted) -> Column:
    """Condition of `case_list` on a row of its index."""
    return F.coalesce(F.col("issuer_agency").contains(agency) & matches(**wanted), F.lit(False))


def issuer_list(enriched: DataFrame, by=("province",), **wanted) -> DataFrame:
    """Rated issuers matching the filters, in listing order, numbered per `by`."""
    return numbered(filter_eq(enriched, **wanted), _issuer_order(), by=by)


def issuer_index(issuers: DataFrame, by=("province",), path: str | None = None) -> OrderIndex:
    """Issuers sorted once by `by` and listing order: every issuer list, whole or by page, is read from it."""
    return write_index(issuers, _issuer_order(), by, path)


def financial_coverage(enriched: DataFrame, by=("province",), **wanted) -> DataFrame:
    """Share of issuers with reported positive total assets, in percent."""
    covered = F.count_if(F.col("total_assets") > 0)
    return (
        filter_eq(enriched, **wanted)
        .groupBy(*by)
        .agg(
            F.count("*").alias("issuers"),
            covered.alias("with_financials"),
            F.coalesce(ratio(covered * 100, F.count("*")), F.lit(0.0)).alias("coverage_pct"),
        )
    )

"""One row per rated issuer, with its city's fiscal revenue and band."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from bondmarts.functions.numeric import fiscal_band
from bondmarts.operators.filters import rated, strongest_first
from bondmarts.operators.ranking import numbered
from bondmarts.schema import ISSUER_COLUMNS


def first_bond(bond: DataFrame, by: Sequence[str] = ("issuer",)) -> DataFrame:
    """The bond of highest administrative level per key, ties by security code.

    Spark keeps one row per key in every map task before the shuffle, so an issuer with very many bonds
    reaches the final task as one row per map task.
    """
    best = W.partitionBy(*by).orderBy(F.col("level_rank").desc_nulls_last(), F.col("security_code"))
    return bond.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def city_fiscal(fiscal: DataFrame, keys: Sequence[str] = ("city",), fiscal_year: str | None = None) -> DataFrame:
    """Highest revenue per city over all files read."""
    if fiscal_year:
        fiscal = fiscal.filter(F.col("fiscal_year") == fiscal_year)
    return fiscal.groupBy(*keys).agg(F.max("revenue").alias("city_fiscal"))


def with_city_fiscal(
    df: DataFrame, fiscal: DataFrame | None, keys: Sequence[str] = ("city",), fiscal_year: str | None = None
) -> DataFrame:
    """Left join on the city. Without fiscal data the column is null.

    No broadcast hint: the planner broadcasts the aggregate when its measured size is below the session's
    limit and else sort-merges, splitting a city that holds very many rows.
    """
    if fiscal is None or not {"city", "revenue"} <= set(fiscal.columns):
        return df.withColumn("city_fiscal", F.lit(None).cast("double"))
    return df.join(city_fiscal(fiscal, keys, fiscal_year), list(keys), "left")


def enriched(
    bond: DataFrame, fiscal: DataFrame | None, keys: Sequence[str] = ("city",), fiscal_year: str | None = None
) -> DataFrame:
    """Rated issuers, nation-wide, with fiscal revenue and band of their city."""
    issuers = first_bond(rated(bond).select(*ISSUER_COLUMNS, "security_code")).drop("security_code")
    return with_band(issuers, fiscal, keys, fiscal_year)


def with_band(issuers: DataFrame, fiscal: DataFrame | None, keys: Sequence[str] = ("city",), fiscal_year: str | None = None) -> DataFrame:
    """Issuers, one row each, with fiscal revenue and band of their city."""
    joined = with_city_fiscal(issuers, fiscal, keys, fiscal_year)
    return joined.select(*ISSUER_COLUMNS, "city_fiscal", fiscal_band("city_fiscal").alias("fiscal_band"))


def issuer_view(bond_with_fiscal: DataFrame) -> DataFrame:
    """Rated issuers of each province slice, in listing order and numbered.

    Unlike `enriched`, an issuer active in two provinces appears in both.
    """
    columns = [*ISSUER_COLUMNS, "city_fiscal"]
    issuers = first_bond(rated(bond_with_fiscal).select(*columns, "security_code"), ("province", "issuer"))
    order = [*strongest_first("total_assets"), F.col("issuer")]
    return numbered(issuers.select(*columns), order, by=["province"])


def issuer_profile(e: DataFrame) -> DataFrame:
    return e


def issuer_profile_listing(e: DataFrame) -> DataFrame:
    """The profile as served: richest city first, then level and rating."""
    return e.orderBy(*strongest_first("total_assets"), "issuer")

"""Province key figures."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts.functions.numeric import round_to
from bondmarts.functions.text import not_blank


def province_kpi(bond: DataFrame) -> DataFrame:
    """Issuers, rated issuers, bonds, amount, average coupon, cities and agencies per province.

    Bonds are first summed per province, issuer, city and agency, which spreads a large province over all
    tasks and leaves the four distinct counts a much smaller input.
    """
    cells = (
        bond.filter("province is not null")
        .groupBy("province", "issuer", "city", "issuer_agency", not_blank("rating").alias("is_rated"))
        .agg(
            F.count("*").alias("bonds"),
            F.sum("issue_amount").alias("amount"),
            F.sum("coupon").alias("coupon"),
            F.count("coupon").alias("coupons"),
        )
    )
    return cells.groupBy("province").agg(
        F.count_distinct("issuer").alias("issuers"),
        F.count_distinct(F.when(F.col("is_rated"), F.col("issuer"))).alias("rated_issuers"),
        F.sum("bonds").alias("bonds"),
        round_to(F.sum("amount"), 2).alias("issue_amount"),
        round_to(F.sum("coupon") / F.nullif(F.sum("coupons"), F.lit(0)), 4).alias("avg_coupon"),
        F.count_distinct("city").alias("cities"),
        F.count_distinct("issuer_agency").alias("agencies"),
    )


def kpi_order() -> list[Column]:
    """Largest amount first."""
    return [F.desc_nulls_last("issue_amount"), F.col("province")]


def kpi_listing(figures: DataFrame) -> DataFrame:
    return figures.orderBy(*kpi_order())


def median_sized_province(bond: DataFrame) -> DataFrame:
    """The province in the middle of all provinces ordered by number of issuers (row n // 2, from 0)."""
    sizes = bond.filter("province is not null").groupBy("province").agg(F.count_distinct("issuer").alias("issuers"))
    # One row per province in this window.
    whole = W.partitionBy(F.lit(1))
    ranked = sizes.select(
        "*",
        F.row_number().over(whole.orderBy("issuers", "province")).alias("_n"),
        F.count("*").over(whole).alias("_all"),
    )
    return ranked.filter(F.col("_n") == F.floor(F.col("_all") / 2) + 1).select("province", "issuers")

"""Underwriter statistics."""

from pyspark.sql import DataFrame, Window as W, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import ratio, round_to
from bondmarts.operators.lists import exploded
from bondmarts.operators.ranking import numbered


def with_band(rows: DataFrame, e: DataFrame) -> DataFrame:
    """Left join of bond rows to the enriched issuer for its fiscal band."""
    bands = e.select("issuer", "fiscal_band")
    return rows.join(bands, "issuer", "left").withColumn(
        "fiscal_band", F.coalesce("fiscal_band", F.lit(K.UNKNOWN_FISCAL_BAND))
    )


def underwriter_cells(bond: DataFrame, by, drop_blank: bool = False) -> DataFrame:
    """Bonds and amount per underwriter, issuer and slice.

    Summed in the map tasks already, so neither a very active issuer nor underwriter makes a hot key later.
    """
    listed = bond.filter("underwriters is not null and underwriters != ''")
    rows = exploded(listed.select("issuer", *by, "issue_amount", "underwriters"), "underwriters", "underwriter", drop_blank=drop_blank)
    return rows.groupBy("issuer", *by, "underwriter").agg(
        F.count("*").alias("bonds"), F.sum("issue_amount").alias("amount")
    )


def _stats(cells: DataFrame, by) -> DataFrame:
    """Cells are unique per issuer, so counting rows with an issuer counts distinct issuers."""
    found = cells.groupBy(*by, "underwriter").agg(
        F.count("issuer").alias("issuers"),
        F.sum("bonds").alias("bonds"),
        round_to(F.sum("amount"), 2).alias("issue_amount"),
    )
    return found.withColumn("bonds_per_issuer", round_to(ratio("bonds", "issuers"), 2))


def underwriter_slices(bond: DataFrame, e: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Unranked statistics per province, city, level, rating, fiscal band and underwriter."""
    by = ["province", "city", "admin_level", "rating", "fiscal_band"]
    # The band comes to the bonds, which are several times fewer than the cells of their underwriters.
    listed = bond.filter("underwriters is not null and underwriters != ''")
    found = _stats(underwriter_cells(with_band(listed, e), by, drop_blank), by)
    return found.withColumn("province", F.coalesce("province", F.lit(K.UNKNOWN_PROVINCE)))


def underwriter_stats(bond: DataFrame, e: DataFrame, drop_blank: bool = False, stored: bool = True) -> DataFrame:
    """Statistics per slice and underwriter, numbered within the slice by bonds.

    Without `stored` a plan that runs only when queried; a slice, of one row an underwriter, is then numbered in one task.
    """
    by = ["province", "city", "admin_level", "rating", "fiscal_band"]
    slices, order = underwriter_slices(bond, e, drop_blank), [F.desc("bonds"), F.col("underwriter")]
    if not stored:
        return slices.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    return numbered(slices, order, by=by)


def underwriter_province_totals(bond: DataFrame) -> DataFrame:
    """Statistics per province and underwriter; issuers are counted anew, blank names left out."""
    return _stats(underwriter_cells(bond, ["province"], drop_blank=True), ["province"])


def underwriter_province_stats(bond: DataFrame) -> DataFrame:
    totals = underwriter_province_totals(bond)
    return numbered(totals, [F.desc("bonds"), F.col("underwriter")], by=["province"])

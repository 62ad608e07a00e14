"""Rating agencies: market share, landscape, competition matrix."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import fiscal_band, ratio, round_to
from bondmarts.functions.text import strip_text, trim_spaces
from bondmarts.operators.issuers import first_bond
from bondmarts.operators.lists import exploded
from bondmarts.storage import store


def agency_market_share(bond: DataFrame, split: bool = False, drop_blank: bool = False) -> DataFrame:
    """Issuers, bonds, share of the province's issuers and bonds per issuer, by province and agency.

    Default as published: an agency list is one agency, and a cell of spaces is the agency ''. With split
    every name of a list counts; drop_blank leaves blank names out.
    """
    rows = bond.filter("issuer_agency is not null and issuer_agency != ''").select("province", "issuer", "issuer_agency")
    if split:
        rows = exploded(rows, "issuer_agency", "agency")
    else:
        rows = rows.select("province", "issuer", trim_spaces("issuer_agency").alias("agency"))
    if drop_blank:
        rows = rows.filter("agency != ''")
    stats = rows.groupBy("agency", "province").agg(
        F.count_distinct("issuer").alias("issuers"), F.count("*").alias("bonds")
    )
    # The window sees one row per agency of a province.
    total = F.sum("issuers").over(W.partitionBy("province"))
    return stats.select(
        "agency", "province", "issuers", "bonds",
        round_to(ratio(F.col("issuers") * 100, total), 1).alias("issuer_share_pct"),
        round_to(ratio("bonds", "issuers"), 2).alias("bonds_per_issuer"),
    )


def share_order() -> list[Column]:
    return [F.col("province"), F.desc("issuers"), F.col("agency")]


def market_share_listing(share: DataFrame) -> DataFrame:
    return share.orderBy(*share_order())


def agency_ranking(share: DataFrame) -> DataFrame:
    """Market share with a sequence number per province, most issuers first."""
    order = W.partitionBy("province").orderBy(F.desc("issuers"), "agency")
    return share.withColumn("seq", F.row_number().over(order).cast("bigint"))


def agency_landscape(e: DataFrame) -> DataFrame:
    return e.select(
        "issuer", "province", "city", "admin_level", "rating", "issuer_agency", "city_fiscal", "fiscal_band"
    )


def agency_list(bond: DataFrame, by=("province",)) -> DataFrame:
    """All agencies named for issuers or bonds, with the bonds they rate the issuer of, in that order."""

    # Only a cell equal to its stripped name counts as a bond of the agency.
    own = F.when(F.col("issuer_agency") == strip_text("issuer_agency"), 1).otherwise(0)
    cells = F.array(
        F.struct(strip_text("issuer_agency").alias("agency"), own.alias("n")),
        F.struct(strip_text("bond_agency").alias("agency"), F.lit(0).alias("n")),
    )
    named = bond.select(*by, F.explode(cells).alias("a")).select(*by, "a.agency", "a.n")
    return named.filter("agency is not null and agency != ''").groupBy(*by, "agency").agg(F.sum("n").alias("issuer_bonds"))


def agency_listing(agencies: DataFrame, by=("province",)) -> DataFrame:
    return agencies.orderBy(*by, F.desc("issuer_bonds"), "agency")


def served_agencies(e: DataFrame, by=("province",)) -> DataFrame:
    """Distinct issuer agencies of rated issuers."""
    return e.filter("issuer_agency is not null").select(*by, "issuer_agency").distinct()


# Category of a bond per dimension. Without revenue, or with a negative one, there is no fiscal category.
_CATEGORY = {
    "fiscal": lambda: F.when(F.col("city_fiscal") >= 0, fiscal_band("city_fiscal")),
    "level": lambda: F.col("admin_level"),
    "rating": lambda: F.when(F.col("rating").isin(list(K.RATING_RANK)), F.col("rating")),
    "city": lambda: F.col("city"),
}
_BANDS = [label for label, _ in K.FISCAL_BANDS] + [K.TOP_FISCAL_BAND]


def _position(c: str, labels) -> Column:
    """1-based place of a label in a fixed list, after its end for others."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c))
    return F.when(place > 0, place).otherwise(F.lit(len(labels) + 1)).cast("int")


def category_order(c: str, dimension: str) -> Column:
    """Sort key of categories: bands and ratings in their fixed order, levels by rank, cities by name."""
    labels = {"fiscal": _BANDS, "level": list(K.LEVEL_RANK), "rating": list(K.RATING_RANK), "city": []}[dimension]
    return _position(c, labels) if labels else F.lit(0)


def categories(bond_with_fiscal: DataFrame, dimension: str) -> DataFrame:
    """Categories of a province: all bands, else what its bonds show."""
    if dimension == "fiscal":
        provinces = bond_with_fiscal.select("province").distinct()
        return provinces.select("province", F.explode(F.array(*[F.lit(b) for b in _BANDS])).alias("category"))
    shown = bond_with_fiscal.select("province", _CATEGORY[dimension]().alias("category"))
    return shown.filter("category is not null").distinct()


def _category_counts(bond_with_fiscal: DataFrame, dimension: str) -> DataFrame:
    """Issuers per province, agency and category that have any: an issuer counts once per province, by its representative bond."""
    issuers = first_bond(
        bond_with_fiscal.select(
            "province", "issuer", "issuer_agency", "level_rank", "security_code",
            _CATEGORY[dimension]().alias("category"),
        ),
        ("province", "issuer"),
    )
    return (
        issuers.filter("issuer_agency is not null and category is not null and category != ''")
        .groupBy("province", F.col("issuer_agency").alias("agency"), "category")
        .agg(F.count("*").alias("issuers"))
    )


def _ordered_agencies(bond_with_fiscal: DataFrame, own: str | None) -> DataFrame:
    """Agencies of each province, the own one first, then by bonds."""
    by_size = W.partitionBy("province").orderBy(F.desc("is_own"), F.desc("issuer_bonds"), "agency")
    return (
        agency_list(bond_with_fiscal)
        .withColumn("is_own", F.col("agency") == F.lit(own or ""))
        .withColumn("agency_order", F.row_number().over(by_size))
    )


def competition_matrix(
    bond_with_fiscal: DataFrame, dimension: str, own: str | None = None, wide: bool = False
) -> DataFrame:
    """Issuers per province, agency and category, zeros included.

    Every issuer counts once per province, for the agency and category of its representative bond. Long form:
    province, agency, category, issuers, is_own, agency_order, category_order. Wide form: one column per category.
    """
    counts, agencies = _category_counts(bond_with_fiscal, dimension), _ordered_agencies(bond_with_fiscal, own)
    # Agencies x categories of the same province: the zero-filled result itself, no bond rows are paired.
    cells = agencies.join(categories(bond_with_fiscal, dimension), "province")
    matrix = cells.join(counts, ["province", "agency", "category"], "left").select(
        "province", "agency", "category",
        F.coalesce("issuers", F.lit(0)).alias("issuers"),
        "is_own", "agency_order",
        category_order("category", dimension).alias("category_order"),
    )
    return wide_matrix(matrix, dimension) if wide else matrix


def sparse_matrix(bond_with_fiscal: DataFrame, dimension: str, own: str | None = None) -> DataFrame:
    """The cells of `competition_matrix` that are not zero, and those of each province's first agency even if they are.

    As the own agency is the first where it is listed, these cells tell leader, total, own count and agencies above of
    every category; all other zeros follow from the lists of agencies and categories. The table grows with the
    counted cells and the categories, not with agencies times categories.
    """
    agencies = store(_ordered_agencies(bond_with_fiscal, own))
    counted = _category_counts(bond_with_fiscal, dimension).join(agencies.select("province", "agency"), ["province", "agency"], "left_semi")
    first = agencies.filter("agency_order = 1").select("province", "agency").join(categories(bond_with_fiscal, dimension), "province")
    cells = counted.unionByName(first.withColumn("issuers", F.lit(0).cast("long")))
    found = cells.groupBy("province", "agency", "category").agg(F.sum("issuers").alias("issuers"))
    return found.join(agencies, ["province", "agency"]).select(
        "province", "agency", "category", "issuers", "is_own", "agency_order", category_order("category", dimension).alias("category_order")
    )


def wide_matrix(matrix: DataFrame, dimension: str) -> DataFrame:
    """One row per province and agency, one column per fixed label, and one more for all other levels.

    Cities have no fixed labels; their matrix stays long.
    """
    labels = {"fiscal": _BANDS, "level": list(K.LEVEL_RANK), "rating": list(K.RATING_RANK)}.get(dimension)
    if labels is None:
        raise ValueError(f"no fixed labels for {dimension}; use the long form")
    columns = [F.sum(F.when(F.col("category") == x, F.col("issuers")).otherwise(0)).alias(x) for x in labels]
    if dimension == "level":
        columns.append(F.sum(F.when(~F.col("category").isin(labels), F.col("issuers")).otherwise(0)).alias(K.OTHER_CATEGORIES))
    return matrix.groupBy("province", "agency", "is_own", "agency_order").agg(*columns)

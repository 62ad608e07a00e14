"""Cities: credit overview, ranking, map data."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import round_to
from bondmarts.functions.text import city_short
from bondmarts.operators.filters import filter_eq, matches
from bondmarts.schema import CITY_COORDS

# All windows of this file run over tables of one row per city, or per city, rating and level.


def rating_levels(e: DataFrame) -> DataFrame:
    """Issuers per city, rating and level; the one pass over the issuers."""
    return e.groupBy("province", "city", "city_fiscal", "rating", "admin_level").agg(F.count("*").alias("issuers"))


def city_ranks(cells: DataFrame) -> DataFrame:
    """Dense rank of a city's revenue within its province, without revenue last, and the number of cities."""
    province = W.partitionBy("province")
    return cells.select("province", "city", "city_fiscal").distinct().select(
        "province", "city", "city_fiscal",
        F.dense_rank().over(province.orderBy(F.col("city_fiscal").desc_nulls_last())).cast("bigint").alias("fiscal_rank"),
        F.count("*").over(province).alias("cities"),
    )


def rating_totals(cells: DataFrame) -> DataFrame:
    """Issuers per city and rating, and per city."""
    totals = cells.groupBy("province", "city", "rating").agg(F.sum("issuers").alias("rating_issuers"))
    return totals.withColumn("city_issuers", F.sum("rating_issuers").over(W.partitionBy("province", "city")))


def city_credit_overview(e: DataFrame) -> DataFrame:
    """Rank of each city and its issuers by rating and level.

    The joins of detail, city rank and rating totals are expressed as windows over the counted cells, so the
    issuers are read once. Cities or provinces without name take part in ranks but are not listed.
    """
    cells = rating_levels(e)
    province, city = W.partitionBy("province"), W.partitionBy("province", "city")
    first_of_city = F.row_number().over(
        W.partitionBy("province", "city", "city_fiscal").orderBy("rating", "admin_level")
    ) == 1
    return (
        cells.withColumn("_city", first_of_city.cast("int"))
        .select(
            "province", "city", "city_fiscal",
            F.dense_rank().over(province.orderBy(F.col("city_fiscal").desc_nulls_last())).cast("bigint").alias("fiscal_rank"),
            F.sum("_city").over(province).alias("cities"),
            F.sum("issuers").over(city).alias("city_issuers"),
            "rating",
            F.sum("issuers").over(W.partitionBy("province", "city", "rating")).alias("rating_issuers"),
            "admin_level",
            F.col("issuers").alias("level_issuers"),
        )
        .filter("province is not null and city is not null")
    )


def city_overview_listing(overview: DataFrame, by_text: bool = False) -> DataFrame:
    """Overview as served: by rank, then rating from the best. by_text sorts ratings as text, descending."""
    rating: Column = F.col("rating").desc()
    if not by_text:
        rating = F.array_position(F.array(*[F.lit(r) for r in K.RATING_RANK]), F.col("rating"))
    return overview.orderBy("province", "fiscal_rank", "city", rating, "admin_level")


def cities_by_fiscal(e: DataFrame, by=("province",)) -> DataFrame:
    """Cities with their revenue, 0 where unknown; listed richest first by `cities_listing`."""
    return e.filter("city is not null").groupBy(*by, "city").agg(
        F.coalesce(F.max("city_fiscal"), F.lit(0.0)).alias("city_fiscal")
    )


def cities_listing(cities: DataFrame, by=("province",)) -> DataFrame:
    return cities.orderBy(*by, F.desc("city_fiscal"), "city")


def known_coords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *xy) for c, xy in K.CITY_COORDS.items()], CITY_COORDS)


def city_bubbles(e: DataFrame, coords: DataFrame, **wanted) -> DataFrame:
    """Map bubbles: issuers, best rating, revenue with rank, marker size and label per city with coordinates.

    Ranks count all cities of the province that match the filters and have revenue, shown or not.
    """
    # Counted per rating first, by hash; the text-valued max_by needs a sort and gets only those counts.
    ratings = filter_eq(e, **wanted).filter("city is not null").groupBy("province", "city", "rating", "rating_rank").agg(
        F.count("*").alias("issuers"), F.max("city_fiscal").alias("city_fiscal")
    )
    cities = ratings.groupBy("province", "city").agg(
        F.sum("issuers").alias("issuers"),
        F.max_by("rating", F.when(F.col("rating").isNotNull(), F.struct("rating_rank", "rating"))).alias("top_rating"),
        F.max("city_fiscal").alias("city_fiscal"),
    )
    province = W.partitionBy("province")
    known = F.col("city_fiscal").isNotNull()
    ranked = cities.select(
        "*",
        F.when(known, F.rank().over(province.orderBy(F.col("city_fiscal").desc_nulls_last()))).cast("bigint").alias("fiscal_rank"),
        F.count("city_fiscal").over(province).alias("ranked_cities"),
    )
    size = F.least(F.lit(40.0), F.greatest(F.lit(8.0), F.lit(8.0) + F.col("issuers") * F.lit(3.5)))
    return ranked.join(coords, "city").select(
        "province", "city", "lon", "lat", "issuers",
        F.coalesce("top_rating", F.lit(K.NO_RATING)).alias("top_rating"),
        "city_fiscal", "fiscal_rank", "ranked_cities",
        size.alias("marker_size"),
        city_short("city").alias("label"),
    )


def city_breakdown(e: DataFrame, **wanted) -> DataFrame:
    """Issuers per city, rating and level, numbered from the best rating and highest level."""
    cells = filter_eq(e, **wanted).filter("city is not null and rating is not null and admin_level is not null")
    cells = cells.groupBy("province", "city", "rating", "admin_level").agg(
        F.count("*").alias("issuers"), F.max("rating_rank").alias("rating_rank"), F.max("level_rank").alias("level_rank")
    )
    best = W.partitionBy("province", "city").orderBy(
        F.desc("rating_rank"), "rating", F.desc("level_rank"), "admin_level"
    )
    return cells.select(
        "province", "city", "rating", "admin_level", "issuers", F.row_number().over(best).cast("bigint").alias("seq")
    )


def empty_cities(e: DataFrame, fiscal: DataFrame | None, **wanted) -> DataFrame:
    """Cities of the issuers or the fiscal data without an issuer that matches the filters."""
    cities = e.select("city", F.coalesce(matches(**wanted), F.lit(False)).alias("active"))
    if fiscal is not None:
        cities = cities.unionByName(fiscal.select("city", F.lit(False).alias("active")))
    found = cities.filter("city is not null").groupBy("city").agg(F.max("active").alias("active"))
    return found.filter("not active").select("city")


def map_centre(cities: DataFrame, coords: DataFrame) -> DataFrame:
    """Mean coordinates of the distinct cities that have any, else the default centre."""
    lon, lat = K.DEFAULT_MAP_CENTRE
    located = cities.select("city").distinct().join(coords, "city")
    return located.agg(
        round_to(F.coalesce(F.avg("lon"), F.lit(lon)), 6).alias("lon"),
        round_to(F.coalesce(F.avg("lat"), F.lit(lat)), 6).alias("lat"),
    )

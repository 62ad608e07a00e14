"""Text lists as rows, and sets of keys."""

from pyspark.sql import DataFrame, functions as F

from bondmarts.constants import LIST_MARK
from bondmarts.functions.text import trim_spaces


def exploded(df: DataFrame, column: str, name: str, mark: str = ",", drop_blank: bool = False) -> DataFrame:
    """One row per trimmed list element in a new column; the list column goes, a null list gives no row.

    Empty elements stay unless drop_blank. Elements are trimmed after the explode, which keeps the whole
    step in generated code; an array function with a lambda would leave it.
    """
    others = [c for c in df.columns if c not in (column, name)]
    items = df.select(*others, F.explode(F.split(column, mark)).alias(name)).withColumn(name, trim_spaces(name))
    return items.filter(F.col(name) != "") if drop_blank else items


def list_names(df: DataFrame, column: str, by=(), name: str = "issuer") -> DataFrame:
    """Distinct non-blank names of a name list, per group."""
    return exploded(df.select(*by, column), column, name, LIST_MARK, drop_blank=True).distinct()


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the side it is on: both, a or b.

    Union, intersection, difference and symmetric difference are filters on `side`; one shuffle of
    pre-aggregated keys serves all four.
    """
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    found = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    side = F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "a").otherwise("b")
    return found.select(key, side.alias("side"))

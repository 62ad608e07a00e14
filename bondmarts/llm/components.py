"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame, functions as F

from bondmarts.storage import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.toDF("hi", "lo").union(moved).filter("hi <> lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `edges` (two columns of longs) that are not their root, the least node of the component.

    Null ends, loops and repeated edges do not matter; no edges give no rows. Only counts and checksums reach the driver. Every
    step is written, so a lost executor costs only tasks of one step.
    """
    a, b = edges.columns
    edges = store(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )
    before = None
    while True:
        edges = store(_small_star(store(_large_star(edges))))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == before or now[0] == 0:
            return edges.toDF("node", "root")
        before = now

"""Own market position, and batch scoring of candidate issuers."""

from pyspark.sql import DataFrame, Window as W, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import ratio, round_to
from bondmarts.functions.text import not_blank


def _positions(matrix: DataFrame) -> DataFrame:
    """Own count against all others, one row per province and category. The dense and the sparse matrix give the same."""
    by = W.partitionBy("province", "category")
    own = F.max(F.when(F.col("is_own"), F.col("issuers"))).over(by)
    leader = F.max_by("agency", F.struct("issuers", (-F.col("agency_order")).alias("o")))
    above = ~F.col("is_own") & (F.col("issuers") > F.coalesce("own_issuers", F.lit(0)))
    return (
        matrix.withColumn("own_issuers", own)
        .groupBy("province", "category", "category_order", "own_issuers")
        .agg(
            F.sum("issuers").alias("total"),
            leader.alias("leader"),
            F.max("issuers").alias("leader_issuers"),
            F.count_if(above).alias("agencies_above"),
        )
    )


def rank_in_category(matrix: DataFrame) -> DataFrame:
    """Leader, own count, own rank (own agency wins ties) and own share of each non-empty category."""
    own = F.coalesce("own_issuers", F.lit(0))
    return (
        _positions(matrix)
        .filter("total > 0")
        .select(
            "province", "category", "category_order", "total", "leader", "leader_issuers",
            own.alias("own_issuers"),
            F.when(F.col("own_issuers").isNotNull(), F.col("agencies_above") + 1).alias("own_rank"),
            round_to(ratio(own * 100, F.col("total")), 0).alias("own_share_pct"),
        )
    )


def classify_positions(matrix: DataFrame) -> DataFrame:
    """Strong: no agency above. Weak: two or more above. Blank: no issuer. Strong and weak may both be false."""
    own = F.coalesce("own_issuers", F.lit(0))
    return _positions(matrix).select(
        "province", "category", "category_order",
        own.alias("own_issuers"), "agencies_above",
        ((own > 0) & (F.col("agencies_above") == 0)).alias("strong"),
        ((own > 0) & (F.col("agencies_above") >= 2)).alias("weak"),
        (own == 0).alias("blank"),
    )


def with_leverage(candidates: DataFrame) -> DataFrame:
    """Leverage in percent, one decimal, derived from assets and net assets unless it is given."""
    usable = F.col("total_assets") > 0
    derived = round_to((F.col("total_assets") - F.col("net_assets")) / F.when(usable, F.col("total_assets")) * 100, 1)
    return candidates.withColumn("leverage", F.coalesce("leverage", F.when(usable, derived)))


def score_candidates(candidates: DataFrame, bench: DataFrame) -> DataFrame:
    """Score 3, 2, 1 or 0 per candidate and metric against the quartiles of the target slice.

    A blank city, level or rating targets all. High is good, except for leverage. Inputs that are null or
    0 and metrics without benchmark give no row. `bench` is the long form of `bench_cube`; pass it stored, so
    that the planner knows its size when it joins the candidates.
    """
    target = {c: F.when(not_blank(c), F.col(c)).otherwise(F.lit(K.ALL)) for c in ("city", "admin_level", "rating")}
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in K.METRICS]
    inputs = (
        with_leverage(candidates)
        .withColumns(target)
        .select("candidate_id", "province", *target, F.explode(F.array(*pairs)).alias("m"))
        .select("candidate_id", "province", *target, "m.metric", "m.value")
        .filter("value is not null and value != 0")
    )
    value = F.col("value")
    high = F.when(value >= F.col("q3"), 3).when(value >= F.col("median"), 2).when(value >= F.col("q1"), 1).otherwise(0)
    low = F.when(value <= F.col("q1"), 3).when(value <= F.col("median"), 2).when(value <= F.col("q3"), 1).otherwise(0)
    key = ["province", *target, "metric"]
    return (
        inputs.join(bench.filter("n > 0").select(*key, "q1", "median", "q3"), key)
        .select(
            "candidate_id", "metric", "value", F.col("median").alias("market_median"),
            F.when(F.col("metric") == "leverage", low).otherwise(high).alias("score"),
        )
    )


def verdict(scores: DataFrame) -> DataFrame:
    """Sum of scores over the best possible sum, and the advice that follows from it."""
    share = ratio(F.sum("score"), F.count("*") * 3)
    label = (
        F.when(F.col("ratio") >= K.ACCEPT_AT, K.ACCEPT).when(F.col("ratio") >= K.CAUTION_AT, K.CAUTION).otherwise(F.lit(K.DECLINE))
    )
    found = scores.groupBy("candidate_id").agg(F.count("*").alias("metrics"), share.alias("ratio"))
    return found.select(
        "candidate_id", "metrics", "ratio", F.floor(F.col("ratio") * 100).alias("score_pct"), label.alias("verdict")
    )

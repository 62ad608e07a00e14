"""Row numbers and quantiles over groups of any size."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts.operators.histogram import counted_quantiles, counted_values, planned_quantiles
from bondmarts.storage import store


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "seq",
    totals: dict[str, Column] | None = None,
    order_only: Sequence[str] = (),
) -> DataFrame:
    """row_number() over (partition by `by` order by `order`), with a group free to span many tasks.

    A window would bring a whole group into one task. Here the rows are range-sorted, so a hot group is
    cut into several sorted blocks, and the number is the count of rows in earlier blocks of the group
    plus the position in the own block. The sorted table is written once, which fixes the block
    borders; only one row per block and group is summed in a window. Those rows are written too, so that the
    planner knows their size: it broadcasts them below the session's limit and else sort-merges.

    `order` should end in a unique key. `totals` adds group-wide counts (aggregates that sum over blocks)
    to every row. Columns in `order_only` are not part of the result.
    """
    by, totals = list(by), totals or {}
    ordered = df.orderBy(*by, *order).withColumn("_pos", F.monotonically_increasing_id()).drop(*order_only)
    ordered = store(ordered).withColumn("_block", F.shiftright("_pos", 33))
    blocks = ordered.groupBy(*by, "_block").agg(
        F.min("_pos").alias("_first"),
        F.count("*").alias("_rows"),
        *[total.alias(t) for t, total in totals.items()],
    )
    group = W.partitionBy(*by)
    earlier = group.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_block").alias("_b"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.sum(t).over(group).alias(t) for t in totals],
    )
    same = F.col("_block") == F.col("_b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    kept = [c for c in df.columns if c not in order_only]
    return ordered.join(store(blocks), same).select(*kept, (F.col("_pos") + F.col("_shift")).alias(name), *totals)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str],
    key: str,
    probs: dict[str, float],
    stored: bool = True,
) -> DataFrame:
    """Exact linear-interpolated quantiles, nulls ignored: one row per group and metric.

    Columns: by, metric, n_rows, n, min, max, mean and one per entry of probs. Equal values are counted, not ranked
    one by one, so rows need not be told apart: `key`, which names a row, is not read. Without `stored` nothing runs until the
    result is queried.
    """
    counted = counted_values(df, by, metrics)
    return counted_quantiles(store(counted), by, probs) if stored else planned_quantiles(counted, by, probs)


def top_rows(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first k rows of the whole table or of each group. Every map task keeps at most k rows per group."""
    if not by:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")

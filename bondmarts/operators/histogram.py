"""Exact quantiles of groups of any size from counted values, without sorting the values.

Equal values of a group are counted in the map tasks, so a value that a third of all rows hold is a few rows. Groups of few different
values are answered by the running count over these. Where groups are larger, counted values are summed in cells of a
fixed logarithmic grid, a few hundred for a group whatever its size; the running count over the cells says which hold the wanted
ranks. Only values in such cells are looked at again, cut into finer cells until a cell has few values, which are counted one by one.

Counts and sums of cells add up over groups: coarser groups are merged from the cells of finer ones.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts.storage import store

#: Cells of the grid for a factor of e, and cells into which one that is still too full is cut.
GRID, CUTS = 16, 4096
#: Different values of a group or cell over which one task keeps a running count.
FEW = 500_000


def counted_values(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, value, rows): how often a group has each value of each metric, null too. Counted in the map tasks first."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = df.select(*by, F.explode(F.array(*pairs)).alias("_m")).select(*by, "_m.metric", "_m.value")
    return long.groupBy(*by, "metric", "value").agg(F.count("*").alias("rows"))


def _grid(value: Column) -> Column:
    """Number of the cell of a value; grows with the value, and cells hold values of one order of magnitude."""
    return F.signum(value) * F.floor(F.log1p(F.abs(value)) * GRID)


def _same(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_open_{c}")) for c in names))


@dataclass
class _Ranks:
    """Wanted ranks of a group: for each probability the two whole ranks between which it lies."""

    probs: dict[str, float]

    @property
    def names(self) -> list[str]:
        return [f"_{p}_{end}" for p in self.probs for end in ("lo", "hi")]

    def of(self, n: Column) -> dict[str, Column]:
        spots = {p: (n - 1) * F.lit(float(q)) for p, q in self.probs.items()}
        return {f"_{p}_{end}": near(spots[p]) + 1 for p in self.probs for end, near in (("lo", F.floor), ("hi", F.ceil))}

    def between(self) -> list[Column]:
        """The statistics from a group's n and the values at its ranks."""
        at = {p: (F.col("n") - 1) * F.lit(float(q)) for p, q in self.probs.items()}
        return [(F.col(f"_{p}_lo") + (s - F.floor(s)) * (F.col(f"_{p}_hi") - F.col(f"_{p}_lo"))).alias(p) for p, s in at.items()]


def counted_quantiles(
    counted: DataFrame,
    by: Sequence[str],
    probs: dict[str, float],
    within: Sequence[str] | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
    few: int = FEW,
) -> DataFrame:
    """Linear-interpolated quantiles of counted values, nulls ignored: one row per group and metric.

    Columns: by, metric, n_rows, n, min, max, mean and one per entry of probs. `counted` are rows as of `counted_values`, which
    must be stored, as they are read several times. With `within` and `spread` they are counted by the finer groups
    `within`, and `spread` turns a row of such a group into a row for each of its groups `by`. A group of nulls only has n 0 and
    null statistics.
    """
    by, ranks = [*by, "metric"], _Ranks(probs)
    spread = spread or (lambda rows: rows)
    # No group has more values than there are in all, which the files' footers tell.
    if counted.count() <= few or spread(counted).groupBy(*by).count().agg(F.max("count")).first()[0] <= few:
        found = _by_value(counted, by, ranks, spread if within else None)
    else:
        found = _by_cells(counted, by, ranks, [*within, "metric"] if within else None, spread, few)
    return _statistics(found, by, ranks)


def planned_quantiles(counted: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """As `counted_quantiles`, but a plan that runs only when queried, and `counted` need not be stored. The values of a group are in one task."""
    by, ranks = [*by, "metric"], _Ranks(probs)
    return _statistics(_by_value(counted, by, ranks, None), by, ranks)


def _statistics(found: DataFrame, by: list[str], ranks: _Ranks) -> DataFrame:
    mean = (F.col("_total") / F.nullif(F.col("n"), F.lit(0))).alias("mean")
    return found.select(*by, "n_rows", "n", "min", "max", mean, *ranks.between())


def _by_value(counted: DataFrame, by: list[str], ranks: _Ranks, spread: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Values at the ranks by a running count over the values of each group, in their order; finer groups may share a value."""
    counted = spread(counted) if spread else counted
    group = W.partitionBy(*by)
    value, known = F.col("value"), F.when(F.col("value").isNotNull(), F.col("rows"))
    # Nulls come last, so they do not shift the ranks.
    upto = F.sum("rows").over(group.orderBy(value.asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = counted.withColumns({"_n": F.sum(known).over(group), "_upto": upto})
    at = ranks.of(F.col("_n"))
    return rows.groupBy(*by).agg(
        F.sum("rows").alias("n_rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(value * F.col("rows")).alias("_total"),
        # The least value whose running count reaches the rank.
        *[F.min(F.when(F.col("_upto") >= at[r], value)).alias(r) for r in ranks.names],
    )


def _by_cells(counted: DataFrame, by: list[str], ranks: _Ranks, within: list[str] | None, spread: Callable[[DataFrame], DataFrame], few: int) -> DataFrame:
    """Values at the ranks by running counts over cells of values, refined where a rank lies."""
    names, value = ranks.names, F.col("value")
    sums = [F.sum("_rows").alias("_rows"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_total").alias("_total")]
    one = counted.withColumns({"_cell": _grid(value), "_rows": F.col("rows"), "_lo": value, "_hi": value, "_total": value * F.col("rows")})
    cells = one.groupBy(*(within or by), "_cell").agg(*sums)
    cells = store(spread(cells).groupBy(*by, "_cell").agg(*sums) if within else cells)

    def reached(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
        """Rows that hold a wanted rank, with it counted from the row's first one."""
        before = F.coalesce(F.sum("_rows").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_before", before)
        inside = {r: F.when((F.col(r) > F.col("_before")) & (F.col(r) <= F.col("_before") + F.col("_rows")), F.col(r) - F.col("_before")) for r in names}
        return rows.withColumns(inside).filter(F.coalesce(*names).isNotNull())

    found = []

    def close(rows: DataFrame) -> DataFrame:
        """Keep apart the cells of one value, which answers their ranks, and return the others."""
        rows = store(rows.select(*by, "_lo", "_hi", "_rows", *names))
        found.append(rows.filter("_lo = _hi").select(*by, *[F.when(F.col(r).isNotNull(), F.col("_lo")).alias(r) for r in names]))
        return rows.filter("_lo < _hi")

    known = cells.filter("_cell IS NOT NULL")
    known = known.withColumns(ranks.of(F.sum("_rows").over(W.partitionBy(*by))))
    left = close(reached(known, by, "_cell"))
    while (most := left.agg(F.max("_rows")).first()[0]) is not None:
        spans = left.drop("_rows").withColumnsRenamed({c: f"_open_{c}" for c in by})
        inside = spread(counted).join(spans, _same(by) & (value >= F.col("_lo")) & (value <= F.col("_hi")))
        carried = [F.max(r).alias(r) for r in names]
        if most <= few:
            values = inside.groupBy(*by, "_lo", "value").agg(F.sum("rows").alias("_rows"), *carried)
            values = reached(values, [*by, "_lo"], "value")
            found.append(values.select(*by, *[F.when(F.col(r).isNotNull(), value).alias(r) for r in names]))
            break
        part = F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS)
        parts = inside.withColumn("_part", part).groupBy(*by, F.col("_lo").alias("_from"), "_part")
        parts = parts.agg(F.sum("rows").alias("_rows"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), *carried)
        left = close(reached(parts, [*by, "_from"], "_part"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cells, *found])
    return rows.groupBy(*by).agg(
        F.sum("_rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_cell").isNotNull(), F.col("_rows"))), F.lit(0)).alias("n"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
        F.sum("_total").alias("_total"),
        *[F.max(r).alias(r) for r in names],
    )

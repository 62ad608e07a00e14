"""One sorted table from which any filtered listing or page of a group is numbered."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bondmarts.storage import store

#: Rows of one block of an index at most; a page opens only the blocks that it lies in.
BLOCK_ROWS = 65_536


@dataclass(frozen=True)
class OrderIndex:
    """Rows in the order of the groups `by` and of the listing, and how many rows of each group every block has.

    `rows` has the columns of the source and `_pos`, which rises in listing order; `blocks` has by, `_block`, `_low` and `_high` (least and largest
    `_pos`) and `_rows`. Both are written, so a listing costs no sort, and a page reads by `_pos` what its blocks hold.
    """

    rows: DataFrame
    blocks: DataFrame
    by: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("_pos", "_block")]

    def listing(self, where: Column | None = None, name: str = "seq") -> DataFrame:
        """All rows that meet a condition, numbered in their group from 1.

        The place in a block comes from a window over that block, which has at most BLOCK_ROWS rows; the rows before
        it from the counts of the group's earlier blocks. A group of any size is numbered by as many tasks as it has blocks.
        """
        kept = self.rows if where is None else self.rows.filter(where)
        counts = self.blocks.select(*self.by, "_block", "_rows")
        if where is not None:
            counts = store(kept.groupBy(*self.by, "_block").agg(F.count("*").alias("_rows")))
        group = W.partitionBy(*self.by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        shifts = counts.select(
            F.col("_block").alias("_b"),
            *[F.col(c).alias(f"_by_{c}") for c in self.by],
            F.coalesce(F.sum("_rows").over(group), F.lit(0)).alias("_earlier"),
        )
        same = F.col("_block") == F.col("_b")
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        place = F.row_number().over(W.partitionBy("_block", *self.by).orderBy("_pos"))
        numbers = kept.withColumn("_place", place).join(store(shifts), same)
        return numbers.select(*self.columns, (F.col("_place") + F.col("_earlier")).alias(name))

    def page(self, first: int, size: int, group: dict | None = None, where: Column | None = None, name: str = "seq") -> DataFrame:
        """Rows first to first + size - 1 of a group's listing.

        Without a condition the counts written with the index tell the blocks; with one, they are counted over the columns that it reads.
        The driver sees one count per block of one group, a number that is BLOCK_ROWS times smaller than the group.
        """
        if first < 1 or size < 1:
            raise ValueError(f"no page of {size} rows from row {first}")
        if set(group or {}) != set(self.by):
            raise ValueError(f"a page needs a value for {', '.join(self.by)}")
        own = F.lit(True)
        for c, value in (group or {}).items():
            own &= F.col(c) == value if value is not None else F.col(c).isNull()
        if where is None:
            counts = self.blocks.filter(own).select("_low", "_high", "_rows")
        else:
            counts = self.rows.filter(own & where).groupBy("_block").agg(
                F.min("_pos").alias("_low"), F.max("_pos").alias("_high"), F.count("*").alias("_rows")
            )
        earlier, low, high, skipped = 0, 0, -1, 0
        for r in sorted(counts.collect(), key=lambda r: r["_low"]):
            if earlier < first - 1 + size and earlier + r["_rows"] >= first:
                if high < low:
                    low, skipped = r["_low"], earlier
                high = r["_high"]
            earlier += r["_rows"]
        # The bounds reach the scan, which skips all files and row groups of other positions.
        touched = self.rows.filter((F.col("_pos") >= low) & (F.col("_pos") <= high) & own & (F.lit(True) if where is None else where))
        place = F.row_number().over(W.orderBy("_pos")) + skipped  # one page and the rest of its first and last block
        return touched.select(*self.columns, place.cast("long").alias(name)).filter(F.col(name).between(first, first + size - 1))


def _open(spark: SparkSession, path: str, by: Sequence[str]) -> OrderIndex:
    return OrderIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), tuple(by))


def open_index(spark: SparkSession, path: str, by: Sequence[str]) -> OrderIndex:
    """An index that `write_index` left in a folder."""
    return _open(spark, path, by)


def write_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), path: str | None = None, block_rows: int = BLOCK_ROWS) -> OrderIndex:
    """Sort df by `by` and `order` once and count its blocks; `order` should end in a unique key.

    With a path the index stays there for `open_index`; else it is a temporary table. The range sort cuts a hot group
    into several tasks, and each task into blocks of at most `block_rows` rows.
    """
    position = F.monotonically_increasing_id()
    ordered = df.orderBy(*by, *order).withColumn("_pos", position)
    # The upper bits are the task of the sort, the lower ones the row in it.
    task, row = F.shiftright("_pos", 33), F.col("_pos") % (1 << 33)
    ordered = ordered.withColumn("_block", task * (1 << 33) + F.floor(row / block_rows))

    def written(table: DataFrame, part: str) -> DataFrame:
        if path is None:
            return store(table)
        table.write.parquet(f"{path}/{part}")
        return df.sparkSession.read.schema(table.schema).parquet(f"{path}/{part}")

    rows = written(ordered, "rows")
    counted = rows.groupBy(*by, "_block").agg(F.min("_pos").alias("_low"), F.max("_pos").alias("_high"), F.count("*").alias("_rows"))
    return OrderIndex(rows, written(counted, "blocks"), tuple(by))

"""Order-free digests of the rows of key buckets: which parts of two tables differ, without joining or sorting them.

A digest is a row count, an exclusive-or and a sum of row hashes. Map tasks combine them, so a table of any size reaches the
shuffle as one row per bucket and map task, and the driver as one number per differing bucket.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of keys. Those that differ are at most this many numbers.
BUCKETS = 1024
#: Bucket of rows without a key.
NO_KEY = -1
DIGEST = ["rows", "mixed", "total"]


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.when(F.col(key).isNull(), F.lit(NO_KEY)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def _row_hash(columns: Sequence[Column], seed: int) -> Column:
    """A hash passes over nulls, so which columns are null goes into it, too."""
    return F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns])


def bucket_digests(df: DataFrame, key: str, columns: Sequence[Column], buckets: int = BUCKETS) -> DataFrame:
    """bucket and DIGEST of the key and the given columns, one row per bucket that has rows."""
    columns = [F.col(key), *columns]
    hashes = df.select(bucket(key, buckets).alias("bucket"), _row_hash(columns, 1).alias("x"), _row_hash(columns, 2).alias("y"))
    return hashes.groupBy("bucket").agg(F.count("*").alias("rows"), F.bit_xor("x").alias("mixed"), F.sum(F.col("y").cast("decimal(20,0)")).alias("total"))


def differing(a: DataFrame, b: DataFrame, key: str, columns: Sequence[Column] = (), buckets: int = BUCKETS) -> list[int]:
    """Buckets in which two tables hold different rows, and that of rows without a key if there are any, as null equals no null."""
    digests = [bucket_digests(df, key, columns, buckets) for df in (a, b)]
    left, right = (d.select("bucket", F.struct(*DIGEST).alias(side)) for d, side in zip(digests, "ab"))
    apart = left.join(right, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b")) | (F.col("bucket") == NO_KEY))
    return sorted(r.bucket for r in apart.select("bucket").collect())

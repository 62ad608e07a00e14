"""Small helpers on DataFrames shared by the operators."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bondmarts.storage import store

#: Bits of the filter that keeps rows out of joins they have no part in: 4 MB, whatever the size of the corpus.
FILTER_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that a batch of very long texts still fits into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with _file and _row, which tell every row apart: the place of the row in its Parquet file.

    Rows that do not come straight from Parquet files are written first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        return store(docs.select(*columns)).select(*columns, *place)


def ascii_lower(column) -> Column:
    """Lower case of A-Z only; null is empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def crc32_mod(column, n: int):
    """crc32 of the value as text, mod n. A null gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_place"))


def _place(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.struct(F.col("_file").alias("file_path"), F.col("_row").alias("row_index")).alias("_other"), *more)


def place_bits(places: DataFrame) -> DataFrame:
    """Bit filter of (_file, _row): at most FILTER_BITS / 32768 rows (bucket, bits) of 4 KB."""
    number = place_number("_file", "_row")
    return places.select(number.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def place_number(file, row) -> Column:
    return F.pmod(F.xxhash64(file, row), F.lit(FILTER_BITS)) + 1


def has_bit(bits: str, number: str) -> Column:
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs, read straight from Parquet files, whose place is not among `rows` (_file, _row); all columns stay.

    Only rows that a bit filter of fixed size finds among them are joined, so few texts are shuffled while few rows go.
    """
    rows = store(rows)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    marked = packed.withColumn("_x", place_number("_file", "_row"))
    marked = marked.join(F.broadcast(place_bits(rows)), F.bitmap_bucket_number("_x") == F.col("bucket"), "left")
    unpacked = [F.col("_docs").getField(c).alias(c) for c in docs.columns]
    hit = has_bit("bits", "_x")
    left = marked.filter(hit).select("_docs", "_file", "_row").join(rows.select("_file", "_row"), ["_file", "_row"], "left_anti")
    return marked.filter(~hit).select(*unpacked).union(left.select(*unpacked))


def with_values(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows of docs, read straight from Parquet files, that `rows` (_file, _row, name) has, with its value as a further column.

    A column of docs with that name gives way to it.
    """
    other = _place(rows, F.col(name).alias("_value"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return _placed(docs).join(other, F.col("_place") == F.col("_other")).select(*kept, F.col("_value").alias(name))

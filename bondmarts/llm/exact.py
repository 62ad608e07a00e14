"""Exact deduplication with a streaming state that never expires.

A stream over the digests of all texts keeps a state keyed by digest on shared disk: how many texts had it, and the identifier and
content locator (file and row) of the one that stays. Every batch combines its equal digests in the map tasks before the
shuffle, so copies of one text that make up a third of all rows are a few rows, and writes the states it touched; the state of
a digest is the sum of what all batches wrote, and nothing expires. A batch that is run again after a failure replaces
what it wrote. Digest hits are then checked on the full bytes: the text of every row with a hit is compared with the text at the
locator, and rows that differ in spite of the digest are grouped by their bytes.
"""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.llm.tables import ascii_lower, has_bit, located, place_bits, place_number
from bondmarts.storage import exists, shared_dir, store

def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_states(digests: DataFrame, folder: str) -> DataFrame:
    """State per digest of a streaming table of (digest, _file, _row, id): n, and `kept`, the largest (id, _file, _row).

    The stream runs until all that is there is read. Started again with the same folder it goes on where it was, and later rows
    meet the states of all earlier ones.
    """
    spark = digests.sparkSession
    place = F.struct("id", "_file", "_row")

    def keep(batch: DataFrame, number: int) -> None:
        touched = batch.groupBy("digest").agg(F.count("*").alias("n"), F.max(place).alias("kept"))
        touched.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    query = digests.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = digests.groupBy("digest").agg(F.count("*").alias("n"), F.max(place).alias("kept")).schema.add("batch", "integer")
    written = spark.read.schema(schema).parquet(f"{folder}/states") if exists(spark, f"{folder}/states") else spark.createDataFrame([], schema)
    return written.groupBy("digest").agg(F.sum("n").alias("n"), F.max("kept").alias("kept"))


def _maybe_among(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows whose (_file, _row) may be among `places`: all that are, and few others while places are few against the bits."""
    marked = rows.withColumn("_x", place_number("_file", "_row")).join(F.broadcast(place_bits(places)), F.bitmap_bucket_number("_x") == F.col("bucket"))
    return marked.filter(has_bit("bits", "_x")).select(*rows.columns)


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row per row of docs: _file, _row, id, keep_id, group_size, kept and digest.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and empty texts are equal. Of equal
    texts the largest id stays (null ids are the smallest; of equal ids the last place in the files), so exactly one row of
    each group is kept. An empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    docs = located(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("_text")), "id", "_text")
    docs = docs.select("id", "_file", "_row", ascii_lower(F.col("_text")).alias("norm"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    digests = docs.select("id", "_file", "_row", digest(F.col("norm")).alias("digest"))
    digests.write.parquet(f"{base}/digests")
    written = spark.read.schema(digests.schema).parquet(f"{base}/digests")
    stream = spark.readStream.schema(digests.schema).parquet(f"{base}/digests")
    states = store(digest_states(stream, base))
    hits = states.filter("n > 1").select("digest", F.col("kept._file").alias("kept_file"), F.col("kept._row").alias("kept_row"))
    places = store(written.join(hits, "digest").select("digest", "_file", "_row", "kept_file", "kept_row"))
    # Full bytes: every text with a hit against the one at the locator.
    with_text = store(places.join(_maybe_among(docs.select("_file", "_row", "norm"), places), ["_file", "_row"]))
    stays = with_text.filter("_file = kept_file AND _row = kept_row").select("digest", F.col("norm").alias("kept_norm"))
    differ = store(with_text.join(stays, "digest").filter("norm <> kept_norm").select("_file", "_row", "digest", "norm"))
    clean = written.join(states, "digest")
    columns = ["_file", "_row", "id", F.col("kept.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "digest"]
    if differ.isEmpty():
        return _marked(clean.select(*columns), id)
    # Different texts of one digest: those unlike the kept one leave its group and are grouped by their bytes.
    gone = differ.groupBy("digest").agg(F.count("*").alias("gone"))
    rest = clean.join(differ.select("_file", "_row"), ["_file", "_row"], "left_anti").join(gone, "digest", "left")
    rest = rest.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    others = differ.join(written.select("_file", "_row", "id"), ["_file", "_row"])
    groups = others.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max(F.struct("id", "_file", "_row")).alias("kept"))
    return _marked(rest.select(*columns).unionByName(others.join(groups, ["digest", "norm"]).select(*columns)), id)


def _marked(rows: DataFrame, id: str) -> DataFrame:
    kept = (F.col("kept._file") == F.col("_file")) & (F.col("kept._row") == F.col("_row"))
    return rows.select("_file", "_row", F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), "digest")

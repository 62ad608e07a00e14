"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a target of words. Whole epochs of the source come first; what is then left of the target is filled with
documents in the order of exponential keys, -ln(u) / w, where w grows with the document's quality and u is a hash of
the document, so reruns agree. The last document that fits only in part gives just the words that are missing.

The running sum over the keys of a source does not bring a source into one task. The distribution of its keys is known from
the counts of its quality levels, so a key's quantile deals the source into about sqrt(documents) blocks of equal expected
size in key order; blocks are summed first, then every block adds the sum of the earlier ones to its own running sum.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts.llm.tables import located, with_values
from bondmarts.storage import store

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeated.
WEIGHTS = (3, 1, 2)
#: The mix holds SHARE of all words (a fraction), and at most CAP times the words of a source.
SHARE, CAP = (3, 2), 2
#: Quality is a whole number of 1 to LEVELS.
LEVELS = 20
MARKS = "#$%&*|!"
#: Sources whose cuts are broadcast, some 300 bytes each.
SOURCES = 50_000


def plain_quality(text: Column) -> Column:
    """LEVELS for a text without marks such as # or |, one less for every 1 / (4 * LEVELS) of its characters that is one, at least 1."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    share = F.floor(marks * (4 * LEVELS) / F.greatest(F.length(text), F.lit(1)))
    return F.greatest(F.lit(1).cast("long"), LEVELS - share.cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """Per source (one row each: source, source_size) its number `sid`, weight and target in words.

    Shares by weight; a source whose share is above cap times its size gets that, and the others share the excess by weight
    until none is above. In the order of cap / weight, the first sources are the capped ones, so prefix sums say which.
    """
    num, den = share
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(by_name).cast("long")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(sid - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("sid", sid).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    everything = W.partitionBy(F.lit(0))
    rank = everything.orderBy(F.col("most") / F.col("weight"), "sid")
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.sum("source_size").over(everything).alias("all_words"),
    )
    left = F.col("all_words") * num - F.col("most_before") * den
    rows = rows.withColumn("capped", F.col("most") * F.col("weight_left") * den <= F.col("weight") * left)
    taken = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything)
    weight_left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    shared = (F.col("weight") * (F.col("all_words") * num - taken * den)).cast("double") / F.nullif(weight_left * den, F.lit(0))
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(shared)).select("source", "source_size", "sid", "weight", "target")


def _measures(id: str, text: str, quality) -> list[Column]:
    """size, level and key of a document, from its identifier and non-null text."""
    name = F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), text)
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    level = quality(F.col(text))
    return [F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), level.alias("level"), (-F.log(u) * LEVELS / level).alias("key")]


def _named(id: str, source: str, text: str) -> list[Column]:
    return [F.col(id).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")]


def _running(docs: DataFrame, id: str, source: str, text: str, quality, **options) -> tuple[DataFrame, DataFrame]:
    """The plan, one row per source, and every row with its source's plan and `before`, the words of its source that come first."""
    rows = located(docs.select(*_named(id, source, text)), "id", "source", "_text")
    sized = store(rows.select("_file", "_row", "id", "source", *_measures("id", "_text", quality)))
    counts = [F.count(F.when(F.col("level") == c, 1)).alias(f"level_{c}") for c in range(1, LEVELS + 1)]
    sources = store(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"), *counts))
    plan = targets(sources.select("source", "source_size"), **options)
    words = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    more = sources.drop("source_size").withColumnRenamed("source", "_source")
    plan = plan.join(more, F.col("source").eqNullSafe(F.col("_source")))
    shares = F.array(*[F.col(f"level_{c}") / F.col("documents") for c in range(1, LEVELS + 1)]).alias("shares")
    plan = plan.select("source", "source_size", "sid", "target", epochs.alias("epochs"), (words - epochs * F.col("source_size")).cast("long").alias("rest"), F.ceil(F.sqrt("documents")).alias("blocks"), shares)
    plan = store(plan).withColumnRenamed("source", "plan_source")
    above = F.lit(0.0)
    for c in range(LEVELS):
        above = above + F.col("shares")[c] * F.exp(-F.col("key") * (c + 1) / LEVELS)
    block = F.least(F.floor(F.col("blocks") * (1 - above)), F.col("blocks") - 1).alias("block")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        "_file", "_row", "id", "size", "key", "source_size", "target", "epochs", "rest", "sid", block
    )
    dealt = store(dealt)
    sums = dealt.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("sid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = store(sums.select("sid", "block", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before")))
    inside = W.partitionBy("sid", "block").orderBy("key", F.col("id").asc_nulls_first(), "size", "_file", "_row").rowsBetween(W.unboundedPreceding, -1)
    running = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    running = running.join(sums, ["sid", "block"]).withColumn("before", F.col("words_before") + F.col("inside"))
    return plan, running


def mixed(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", quality=plain_quality, **options) -> DataFrame:
    """One row per row of docs: _file, _row, id, size, source_size, target (its source's) and taken, the words that the mix takes.

    Null texts have size 0 and a null source is a source of its own, the last. taken is at most CAP times size. Equal rows
    are rows of their own, which of them comes first does not matter. An empty table gives no rows.
    """
    _, running = _running(docs, id, source, text, quality, **options)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return running.select("_file", "_row", F.col("id").alias(id), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, name: str = "mix_words", id: str = "doc_id", source: str = "source", text: str = "text", quality=plain_quality, sources: int = SOURCES, **options
) -> DataFrame:
    """The rows of docs, read straight from Parquet files, that the mix takes words of, with their number as column `name`.

    All other columns stay; one of that name gives way. The amounts are those of `mixed`. What a source gives is said by its epochs and
    the last document that fits in part, so texts are not joined to amounts: every row compares its own key with the cut of
    its source, one row per source, broadcast up to `sources` of them. With more sources the amounts are joined to the rows by place.
    """
    plan, running = _running(docs, id, source, text, quality, **options)
    order = F.struct("key", "id", "size", "_file", "_row")
    last = running.filter("before < rest AND before + size >= rest").select("sid", order.alias("cut"), (F.col("rest") - F.col("before")).alias("words_left"))
    cuts = store(plan.select("plan_source", "sid", "epochs").join(last, "sid", "left"))
    if cuts.count() > sources:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
        amounts = running.select("_file", "_row", (F.col("epochs") * F.col("size") + part).cast("long").alias(name))
        return with_values(docs, store(amounts.filter(F.col(name) > 0)), name)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), *_named(id, source, text), *place)
    measured = packed.select("_docs", "id", "source", "_file", "_row", *_measures("id", "_text", quality))
    measured = measured.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("plan_source")))
    part = F.when(order < F.col("cut"), F.col("size")).when(order.eqNullSafe(F.col("cut")), F.col("words_left")).otherwise(0)
    amounts = measured.select("_docs", (F.col("epochs") * F.col("size") + part).cast("long").alias("_words")).filter("_words > 0")
    return amounts.select(*[F.col("_docs").getField(c).alias(c) for c in docs.columns if c != name], F.col("_words").alias(name))

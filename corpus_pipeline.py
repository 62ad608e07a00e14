"""A corpus through the stages of the llm operators, each written and read again before the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from bondmarts.llm import exact, jaccard, mixing, rules, tiling
from bondmarts.llm.tables import table, without
from bondmarts.storage import delete, shared_dir, temporary

#: No SQL: the classifier and the tiling are not expressible in it.
ORACLE_SQL = None
#: Documents with a lower score go.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, rejects go."""
    model = rules.train(docs, table(spark, sf_dir, "labels"), "quality")
    return rules.scored(docs, model, name="_score").filter(F.col("_score") >= QUALITY).drop("_score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return without(docs, exact.duplicates(docs).filter("NOT kept").select("_file", "_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the least doc_id stays (of equal ids, the first row)."""
    return without(docs, jaccard.surplus(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with `mix_words`, the words that it takes of each, at least one."""
    return mixing.mixed_documents(docs, "mix_words")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after all stages. Intermediate tables go once their stage is written, and what a stage wrote once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

import random
import zlib

import pytest
from pyspark.sql import functions as F

from bondmarts.llm import rules, toxicity
from bondmarts.llm.tables import crc32_mod

SF_DIR = "/root/testdata/sf0.1"
EXTRA = "doc_id bigint, text string, score double, words string, log_words string, _text string"


def labelled(spark, n=300, seed=1):
    """Good prose against shouting and junk, and some insults."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(8, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zzidiot", "zzscum", "Zzidiots!"])
        text = " ".join(words) if good else rng.choice([" | ".join(words), " ".join(w + "!!" for w in words).upper(), " ".join(words[:1] * 50)])
        docs.append((i, text, 0.5, "clash", "clash", "clash"))
        labels.append((i, int(good), int(toxic)))
    odd = [(n, None, 0.0, "", "", ""), (n + 1, "", 0.0, "", "", ""), (n + 2, "word " * 200_000, 0.0, "", "", ""), (0, docs[0][1], 0.0, "", "", ""), (None, "q", 0.0, "", "", "")]
    return spark.createDataFrame(docs + odd, EXTRA), spark.createDataFrame([*labels, (n, None, None), (None, 1, 1), (0, labels[0][1], labels[0][2])], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_labels_are_found(spark, kind):
    docs, labels = labelled(spark)
    module = rules if kind == "quality" else toxicity
    model = module.train(docs, labels, kind, learn=crc32_mod("doc_id", 3) != 0)
    scored = module.scored(docs, model, name="p")
    assert scored.columns == [*docs.columns, "p"] and scored.count() == docs.count()
    assert scored.filter("p is null or p < 0 or p > 1").count() == 0
    held = scored.join(labels.dropna().distinct(), "doc_id").filter(crc32_mod("doc_id", 3) == 0).select(kind, "p").collect()
    right = sum((r.p >= 0.5) == bool(r[kind]) for r in held)
    assert len(held) > 60 and right / len(held) > 0.93


def test_no_labels_no_rows_one_label(spark):
    docs, labels = labelled(spark, 40)
    for module, kind in ((rules, "quality"), (toxicity, "toxic")):
        blind = module.train(docs, labels.limit(0), kind)
        assert {round(r.p, 6) for r in module.scored(docs, blind, name="p").collect()} == {0.5}
        assert module.scored(docs.limit(0), blind, name="p").count() == 0
    ones = rules.train(docs, labels.filter("quality = 1"), "quality")
    assert rules.scored(docs, ones, name="p").agg(F.min("p")).first()[0] > 0.9


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    few = rules.train(docs, labels, "quality", max_rows=80)
    assert few.rules
    assert len(toxicity.train(docs, labels, "toxic", max_rows=150).hashes) > 0


def test_statistics_of_empty_text_are_zero_or_one(spark):
    row = spark.createDataFrame([("",), (None,)], "t string").select(*[c.alias(n) for n, c in rules.statistics(F.col("t")).items()]).collect()
    assert row[0] == row[1] and all(v in (0.0, 1.0) for v in row[0])


def test_weights_are_sparse_and_rules_are_conjunctions(spark):
    docs, labels = labelled(spark)
    model = rules.train(docs, labels, "quality")
    assert 0 < len(model.rules) < 100 and all(1 <= len(r.splits) <= 2 * rules.DEPTH for r, _ in model.rules)
    weights = toxicity.train(docs, labels, "toxic")
    assert 0 < len(weights.hashes) < 500


@pytest.mark.parametrize("name, label, keep", [("op1_quality_rules", "quality", 0.98), ("op5_toxicity_ftrl", "toxic", 0.97)])
def test_held_out_accuracy_on_given_tables(spark, name, label, keep):
    from bondmarts.llm.queries import QUERIES

    rows = QUERIES[name](spark, SF_DIR)
    known = rows.filter("held_out").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").select(label, "predicted", "doc_id").collect()
    assert sum(r[label] == r.predicted for r in known) / len(known) > keep
    mod, rest = (5, 0) if label == "quality" else (3, 1)
    assert all(zlib.crc32(str(r.doc_id).encode()) % mod == rest for r in known)

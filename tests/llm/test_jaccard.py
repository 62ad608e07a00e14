import random

import pytest
from pyspark.sql import functions as F

from bondmarts.llm import jaccard
from bondmarts.llm.components import components
from bondmarts.storage import store

SCHEMA = "doc_id bigint, text string, _file string, n bigint, _id string"


def brute(docs):
    """doc -> (set size, least id reachable) by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def corpus(seed=3, families=6, copies=40):
    """Families of near copies around the threshold, exact copies, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    texts = ["", None, "  ", "one", "ONE", "one two", "one two three four", "one two three four five", "One two three four five six"]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 25, 80]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    texts += [" ".join([word() for _ in range(rng.randint(3, 60))] + passage) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 8])
def test_all_links_are_found(spark, monkeypatch, block):
    """Small blocks, so that tiles and cells are cut into parts."""
    docs = corpus()
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TASK", 4 * block)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df).collect()}
    assert got == brute(docs)


def test_hot_tile_flush(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 10)
    docs = corpus(seed=4, families=2, copies=25)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df).collect()} == brute(docs)


def test_empty_table_repeated_and_null_ids(spark):
    assert jaccard.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "q"), (7, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7)], key=repr)


def test_one_row_of_each_group_stays(spark):
    docs = store(spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (1, "A B c d e f"), (3, ""), (4, None), (9, "z")], "doc_id bigint, text string"))
    gone = jaccard.surplus(docs)
    assert gone.count() == 2
    from bondmarts.llm.tables import without

    assert sorted(r.doc_id for r in without(docs, gone).collect()) == [1, 3, 4, 9]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (2, 1), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {2: 1, 3: 1, 9: 5, 8: 5, 7: 5, 6: 5, **{i: 100 for i in range(101, 141)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_links_without_shared_shingles(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdefg"]).alias("text"))
    assert jaccard.similarity_classes(df).filter("doc_id <> component_id").count() == 0

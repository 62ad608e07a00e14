import math

import pytest

from bondmarts.llm import mixing
from bondmarts.storage import store

SCHEMA = "doc_id bigint, source string, text string, size string, target int"


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share by weight, cut what is above twice the size, share the excess again, until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] >= 2 * sizes[s]]
        if not above:
            return {**fixed, **share}
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize(
    "sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "Z": 5, None: 50}, {"x": 7}, {"a": 0, "b": 9, "c": 0, "d": 400, "e": 3}, {f"s{i:02d}": (i * 37) % 91 + 1 for i in range(30)}]
)
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    expected = brute_targets(sizes)
    assert {r.source for r in rows} == set(sizes) and all(math.isclose(r.target, expected[r.source], abs_tol=1e-6) for r in rows)


def corpus(spark, n=400):
    texts = ["", None, "one", "#### || !!"] + [" ".join(["word"] * (i * 7 % 50 + 1)) for i in range(n)]
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}", t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[10:20], (None, "hot", "a b c", "x", 2)], SCHEMA)


def test_mix(spark):
    docs = corpus(spark)
    rows = mixing.mixed(docs.repartition(7)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_source = {}
    for r in rows:
        total = by_source.setdefault((r.source_size, r.target), [0, 0])
        total[0] += r.size
        total[1] += r.taken
    assert all(size == words and abs(taken - target) < 1 for (size, target), (words, taken) in by_source.items())
    # Whole epochs first, and at most one document of a source only in part.
    for (size, target) in by_source:
        epochs = int(target + 0.5) // size
        own = [r for r in rows if (r.source_size, r.target) == (size, target) and r.size]
        assert all(r.taken >= epochs * r.size for r in own)
        assert sum(r.taken not in (epochs * r.size, (epochs + 1) * r.size) for r in own) <= 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "a" if i < 2000 else "b", ("plain words here " if i % 2 else "#|#|#| ||| ### ") * 3) for i in range(4000)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), share=(1, 4), weights=(1, 1)).collect()
    taken = [sum(r.taken for r in found if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert taken[1] > 3 * taken[0]


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = mixing.mixed(spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id bigint, source string, text string")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = mixing.mixed(store(corpus(spark, 20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("sources", [mixing.SOURCES, 0])
def test_documents_of_the_mix_carry_the_amounts(spark, sources):
    docs = store(corpus(spark).repartition(5).withColumn("words", mixing.F.lit("old")).withColumn("key", mixing.F.lit(1)))
    wanted = mixing.mixed(docs).filter("taken > 0").select("_file", "_row", "doc_id", "taken")
    found = mixing.mixed_documents(docs, "words", sources=sources)
    assert found.columns == [*[c for c in docs.columns if c != "words"], "words"]
    key = lambda rows: sorted((tuple(r) for r in rows.collect()), key=repr)
    assert key(found.select("doc_id", "words")) == key(wanted.select("doc_id", "taken"))
    # Equal rows are told apart by place, so texts and amounts belong together.
    assert key(found.selectExpr("doc_id", "text", "source", "key")) == key(
        docs.select("*", "_metadata.file_path", "_metadata.row_index").join(wanted.toDF("file_path", "row_index", "i", "t"), ["file_path", "row_index"]).select("doc_id", "text", "source", "key")
    )
    assert mixing.mixed_documents(store(docs.limit(0)), sources=sources).count() == 0


def test_amounts_are_not_joined_to_texts(spark):
    """With few sources the plan that reads the texts has a broadcast join only, and no shuffle."""
    docs = store(corpus(spark))
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan

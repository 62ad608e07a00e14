import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from bondmarts.llm import tiling
from bondmarts.llm.tables import without
from bondmarts.storage import store

U = np.uint64


def brute_tiles(a, b, least):
    """Greedy string tiling as published: mark the longest unmarked common run again and again; ties by place."""
    used_a, used_b, found = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return found
        n, i, j = best
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        found.append((i, j, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=22), st.lists(st.integers(0, 2), max_size=26))
def test_tiles_are_the_greedy_ones(a, b):
    x, y = np.array(a, U), np.array(b, U)
    want = brute_tiles(a, b, tiling.SEED)
    assert tiling.tiles(x, tiling._grams(x), y, tiling._grams(y)) == want
    assert tiling.tiles(x, tiling._grams(x), y, tiling._grams(y), max_pairs=0) == want


def test_both_ways_agree_on_longer_texts():
    rng = np.random.default_rng(3)
    for letters in (2, 3, 8):
        x, y = (rng.integers(0, letters, n).astype(U) for n in (300, 900))
        one, other = (tiling.tiles(x, tiling._grams(x), y, tiling._grams(y), max_pairs=p) for p in (10**9, 0))
        assert one == other and len(one) > 5


def test_repeated_words_take_bounded_memory():
    x, y = np.full(2_000, 7, U), np.full(1_000_000, 7, U)
    a, b = tiling._grams(x), tiling._grams(y)
    tracemalloc.start()
    found = tiling.tiles(x, a, y, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 2_000)] and peak < 200 << 20


ITEM = "the quick brown fox jumps over the lazy dog while seven grey herons watch from the cold river bank at dawn"
HALVES = (ITEM[: len(ITEM) // 2].rsplit(" ", 1)[0], ITEM[len(ITEM) // 2 :].split(" ", 1)[1])


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, "too short"), (3, None), (4, ""), (5, "entirely other words stand here for nobody to find again"), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("klmn") for _ in range(4)) for _ in range(300))
    rows = [
        (1, f"{noise} {ITEM.upper()} {noise}"),  # whole
        (2, f"{HALVES[1]} {noise} {HALVES[0]}"),  # moved about
        (3, "the quick brown fox jumps and that is all there is to it"),  # a little of it
        (4, noise), (5, None), (6, ""), (7, "too short"), (8, ITEM.replace(" ", "\n\t ")), (8, ITEM),
    ]
    return store(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, item_id int, coverage string"))


@pytest.mark.parametrize("max_words", [tiling.MAX_WORDS, 1])
def test_contamination(docs, benchmark, max_words):
    """The same rows with the benchmark in every task and by a join on seeds."""
    rows = tiling.contamination(docs, benchmark, max_words=max_words).collect()
    got = sorted((r.doc_id, r.item_id, r.contaminated) for r in rows if r.doc_id != 3)
    assert got == [(1, 1, True), (2, 1, True), (4, None, False), (5, None, False), (6, None, False), (7, 2, True), (8, 1, True), (8, 1, True)]
    part = next(r for r in rows if r.doc_id == 3)
    assert (part.item_id, part.contaminated) == (1, False) and 0.2 < part.coverage < 0.3
    kept = tiling.decontaminated(docs, benchmark, max_words=max_words)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(spark, docs, benchmark):
    none = store(docs.limit(0))
    assert tiling.contamination(none, benchmark).count() == 0
    assert tiling.decontaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert without(docs, tiling.matches(docs, benchmark.limit(0))).count() == docs.count()


@pytest.mark.parametrize("max_words", [tiling.MAX_WORDS, 1])
def test_contamination_of_rows_not_from_files(spark, benchmark, max_words):
    docs = spark.createDataFrame([(1, f"so it is said {ITEM} and no more"), (2, "nothing of it")], "doc_id bigint, text string")
    for frame in (docs, docs.union(docs.limit(0))):
        got = sorted((r.doc_id, r.item_id, r.coverage, r.contaminated) for r in tiling.contamination(frame, benchmark, max_words=max_words).collect())
        assert got == [(1, 1, 1.0, True), (2, None, 0.0, False)]


@pytest.mark.parametrize("max_words", [tiling.MAX_WORDS, 1])
def test_long_quotations_and_changed_punctuation(spark, max_words):
    words = [f"w{i}" for i in range(200)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, ITEM)], "item_id bigint, text string")
    dotted = " ".join(f'"{w},' if i % 3 == 0 else w for i, w in enumerate(ITEM.split()))
    rows = [(1, " ".join(words[40:70])), (2, " ".join(words[40:60])), (3, dotted), (4, "- , ; . ! ? - , ;")]
    docs = store(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.doc_id, r.item_id, r.coverage, r.contaminated) for r in tiling.contamination(docs, items, max_words=max_words).collect())
    assert got == [(1, 1, 0.15, True), (2, 1, 0.1, False), (3, 2, 1.0, True), (4, None, 0.0, False)]
    assert sorted(r.doc_id for r in tiling.decontaminated(docs, items, max_words=max_words).collect()) == [2, 4]


@pytest.mark.parametrize("max_words", [tiling.MAX_WORDS, 1])
def test_short_items_are_whole_sequences(spark, max_words):
    texts = ["alpha", "alpha beta", "beta gamma delta", "one two three four", None, "", " "]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = [(1, "so Alpha, beta"), (2, "gamma beta alphabeta"), (3, "x (beta) gamma, delta. beta gamma delta"), (4, "one two three"), (5, "one two three four"), (6, "")]
    docs = store(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    found = tiling.matches(docs, items, max_words=max_words).collect()
    got = sorted((r["_row"], r.item_id, r.coverage, [tuple(t) for t in r.tiles]) for r in found)
    assert got == [(0, 0, 1.0, [(0, 1, 1)]), (0, 1, 1.0, [(0, 1, 2)]), (2, 2, 1.0, [(0, 1, 3)]), (4, 3, 1.0, [(0, 0, 4)])]
    assert sorted(r.doc_id for r in tiling.decontaminated(docs, items, max_words=max_words).collect()) == [2, 4, 6]

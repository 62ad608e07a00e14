from collections import Counter
from itertools import combinations
import random
import re
import zlib

import pytest

from bondmarts.llm import variants
from tests.llm.test_exact import SCHEMA


def near(a, b):
    """One inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_counts(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain(counts):
    found = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            found[a].append(b)
            found[b].append(a)
    forms = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(found[w]), counts.get(forms[w])))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).withColumnsRenamed({"digest": "word", "n": "n"})
    found = variants.variants(docs.repartition(3))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(plain_counts(rows))


def words_of(rng, n):
    """Random words of few letters and their misspellings, so that there are many near ones."""
    found = set()
    while len(found) < n:
        word = "".join(rng.choices("abé", k=rng.randrange(6, 10)))
        found.add(word)
        i = rng.randrange(len(word))
        found.add(rng.choice((word[:i] + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i:], word[:i] + "c" + word[i + 1 :])))
    return sorted(w for w in found if len(w) >= 6)


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (None, "Colour " * 30 + "colours colours colours colours colours"), (3, "12 % ... 5"), (4, "a" * 100_000), (4, ("b" * 3000 + " ") * 6)])
    check(spark, [(i, "naïveté ÉCOLES écoles Écoles école×s") for i in range(20)] * 2)
    check(spark, [])


def test_documents_against_all_pairs(spark):
    rng = random.Random(3)
    words = words_of(rng, 300)
    weights = [rng.choice((1, 6, 40, 250)) for _ in words]
    rows = [(i, rng.choice((" ", ", ", "-")).join(w.title() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=200))) for i in range(120)]
    check(spark, rows)


def test_the_chain_of_forms_is_followed_to_its_end(spark):
    counts = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(counts, counts[1:])], "word string, form string")
    assert {r.root for r in variants.roots(forms).collect()} == {"abbbbb"}
    assert variants.roots(forms.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 4])
def test_near_words_against_all_pairs(spark, block):
    """Also with buckets that are dealt over many cells."""
    rng = random.Random(block)
    counts = {w: rng.randrange(5, 60) for w in words_of(rng, 400)}
    rows = variants.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint"), block).collect()
    found = {r.word: (r.n_near, r.best, r.best_n) for r in rows}
    for w in counts:
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        assert found.get(w) == ((len(others), best, counts[best]) if others else None)


def test_index_against_plain_comparison():
    rng = random.Random(8)
    words = list({"".join(rng.choices("ab", k=rng.randrange(0, 6))) for _ in range(80)})
    index = variants.Index(words)
    for w in [*words, "", "abababab"]:
        found = index.near(w)
        assert {o for i, o in enumerate(words) if found >> i & 1} == {o for o in words if near(w, o)}
        apart = index.near(w, 1) if w else 0
        assert {o for i, o in enumerate(words) if apart >> i & 1} == {o for o in words if w and near(w, o) and o[:1] != w[:1]}


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(f"{'x' * (i % 9)}abcdef" for i in range(500))
    whole = variants._runs(text)
    monkeypatch.setattr(variants, "PIECE", 10)
    assert variants._runs(text) == whole


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = variants.variants(docs)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(plain_counts(rows))

from itertools import combinations
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bondmarts.llm import simhash
from tests.llm.test_exact import SCHEMA


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    """Fingerprint and least reachable id of every row, by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least[find(i)] = min(id, least.get(find(i), id))
    return sorted(((id, f"{fps[i]:016x}", least.get(find(i))) for i, (id, _) in enumerate(rows)), key=repr)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).withColumnsRenamed({"digest": "fp", "n": "tile"})
    found = simhash.near_duplicates(docs.repartition(3), **options)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def copies(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(n):
        base = rng.choices(words, k=rng.choice((3, 30, 300)))
        for _ in range(rng.choice((1, 2, 6))):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, (" " if group % 2 else "\n ").join(text)))
    return rows


def test_edge_cases(spark):
    check(spark, [
        (5, None), (3, ""), (9, " \t\r"), (2, "one"), (1, "ONE"), (4, "one two"), (6, "one  two\x0b"), (7, "one two three"), (7, "One Two\nThree"),
        (None, "one two three"), (None, "alone in here"), (8, "É é one"), (10, "é É one"), (11, "a\x1fb c d e"), (12, "x " * 50_000), (13, "X\n" * 50_000 + "x"),
    ])
    check(spark, [])


def test_copies_against_all_pairs(spark):
    check(spark, copies(60))


def test_long_texts_are_cut_into_words_piece_by_piece(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 40)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_spark_hashes_alike(spark):
    """XXH64 with seed 42 is what xxhash64 gives for one string column."""
    found = spark.createDataFrame([("one two three",)], "s string").select(F.xxhash64("s")).first()[0]
    assert found % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def groups_by(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    found = {}
    for x in nodes:
        found.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("pieces, block", [(1, 8), (2, 2048), (4, 5), (8, 64), (None, 3)])
def test_links_join_what_all_pairs_join(spark, pieces, block):
    """Random fingerprints, a dense ball of them, and those at the edge of the radius; blocks smaller than tiles."""
    rng = random.Random(pieces)
    nodes = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63, 3, 7}
    centre = rng.getrandbits(64)
    nodes |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    nodes |= {x ^ sum(1 << rng.randrange(64) for _ in range(rng.choice((2, 3, 4)))) for x in rng.sample(sorted(nodes), 100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    wanted = [(a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 2]
    classes = spark.createDataFrame([(signed(x),) for x in nodes], "fp bigint")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(classes, 2, pieces, block).collect()]
    assert all((a ^ b).bit_count() <= 2 or groups_by(wanted, nodes) for a, b in found)
    assert groups_by(found, nodes) == groups_by(wanted, nodes)


def test_a_dense_block_gives_few_links():
    a = np.arange(50, dtype=np.uint64)
    x, y = simhash._spanning(a, a, np.ones((50, 50), bool))
    assert len(x) <= 100
    assert groups_by(zip(x.tolist(), y.tolist()), a.tolist()) == [a.tolist()]


def test_only_near_tiles():
    assert simhash.near_tiles(1, 2) == [0, 1, 2]
    assert len(simhash.near_tiles(4, 2)) == (1 + 8 + 8 + 6 * 4 - 1) // 2 + 1

from fractions import Fraction
from itertools import permutations
from math import factorial
import random

import pytest

from bondmarts.llm import audit

LONG = " ".join(f"w{i}" for i in range(250))
SCHEMA = "doc_id bigint, text string, source string, n int, cell string, part int, id string"
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG.upper(), "b"), (4, "x x x x", None), (5, None, ""), (6, "", "a"), (7, "50% off", "a"),
    (8, "B", "b"), (None, LONG, "a"), (None, LONG, "b"), (9, LONG + " |", "a"), (0, "50% off", "b"), (10, LONG + " É", "é"), (11, "a\x1fb " * 200, "é"), (11, "q", "q"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, 1), (9, 1, 1), (99, 1, 1)]


def frames(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def split(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows):
    """(part, order, step) to the counts, by going through all rows for every order."""
    labels = {}
    for i, q, t in LABELS:
        if i is not None:
            old = labels.get(i, (0, 0))
            labels[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = split(text)
        smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": smaller,
        }
        docs.append((source or "", {f for f in fails if fails[f]}, *labels.get(i, (0, 0))))
    found = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(out)
                redundant = sum(f in d[1] for d in own) - len(out)
                unique = sum(d[1] == {f} for d in own)
                found[part, "".join(order), step] = [len(left), len(out), redundant, unique, sum(d[2] for d in out), sum(d[3] for d in out)]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return found


def counted(df):
    return {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.bad_lost, r.shapley] for r in df.collect()
    }


def test_against_going_through_all_rows(spark):
    docs, labels = frames(spark)
    found = audit.audit(docs.repartition(3), labels)
    assert counted(found) == plain(ROWS)
    assert found.count() == 600 * len({r[2] or "" for r in ROWS})


def test_random_rows(spark):
    rng = random.Random(5)
    texts = [LONG, LONG.title(), "a a a a a", "# one", "", LONG + " $", "a " * 300]
    rows = [(rng.randrange(40), rng.choice(texts), rng.choice("ab")) for _ in range(120)]
    assert counted(audit.audit(*frames(spark, rows))) == plain(rows)


def test_empty_tables(spark):
    docs, labels = frames(spark, [])
    assert audit.audit(docs, labels).count() == 0
    docs, labels = frames(spark)
    none = audit.audit(docs, labels.limit(0)).collect()
    assert len(none) == 600 * 5 and all(r.good_lost == r.bad_lost == 0 for r in none)


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_least_squares_give_the_mean_over_all_orders(n):
    rng = random.Random(n)
    game = [rng.randrange(100) for _ in range(1 << n)]
    wanted = [0] * n
    for order in permutations(range(n)):
        coalition = 0
        for player in order:
            wanted[player] += game[coalition | 1 << player] - game[coalition]
            coalition |= 1 << player
    found = [sum(w * v for w, v in zip(row, game)) for row in audit.shapley_coefficients(n)]
    assert found == wanted
    assert sum(Fraction(x, factorial(n)) for x in found) == game[-1] - game[0]


def test_hot_text_is_not_shuffled_by_its_digest_alone(spark):
    """The join that finds first copies has the identifier in its key, so copies of one text go to many tasks."""
    docs, labels = frames(spark, [(i, LONG, "a") for i in range(300)])
    found = {(r.cell, r.n) for r in audit.cells(docs, labels).collect()}
    assert found == {(0, 1), (16, 299)}

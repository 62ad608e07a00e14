"""Audit of how text filters interact: what each removes in every order, and its exact Shapley share.

A text fails some of the filters, which makes it a member of one of 32 cells (for five filters). The cells of a part, counted, give the
removals of all 32 coalitions: a set of filters removes the texts of every cell that shares a filter with it. Then

- a step of an order removes what its coalition removes beyond the coalition of the steps before it;
- the Shapley values are the efficiency-constrained least squares fit of an additive game to the coalitions under the Shapley kernel.
  The normal equations depend on the number of filters only, so they are solved once, in rationals, for all 32 unit games; a
  part's values are then whole-number combinations of its coalition removals.

Only rows of identifier, part, digest and cell are shuffled, never texts. Copies are told apart from the first of them by a join on digest
and identifier, so a text that a third of all rows hold is no hot key.
"""

from collections.abc import Callable
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.storage import store

SPACE = r"[\x20\x09-\x0D]+"

#: Failure by what the text has: words, distinct words, capitals A-Z, characters (code points) and the text itself.
CONDITIONS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("words") < 200,
    "B": lambda: 100 * F.col("distinct") < 50 * F.col("words"),
    "C": lambda: 100 * F.col("capitals") > 2 * F.col("chars"),
    "D": lambda: F.col("marks"),
}
#: The filter of repeated texts: identical to the text of a smaller identifier.
REPEATED = "E"


def shapley_coefficients(n: int) -> list[list[int]]:
    """n! times the Shapley value of each of n players, as whole-number weights of the 2^n coalition values.

    Least squares of v(S) against the sum over S of the values, weighted by the Shapley kernel (n - 1) / (C(n, |S|) |S| (n - |S|)), under the
    constraint that all values add up to v(N) - v(no one). The normal equations with the multiplier of the constraint are
    solved by elimination in rationals, for every coalition's unit game at once.
    """
    full, size = (1 << n) - 1, 1 << n
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    inside = lambda i, s: s >> i & 1
    rows = []
    for i in range(n):
        gram = [sum((k for s, k in kernel.items() if inside(i, s) and inside(j, s)), Fraction(0)) for j in range(n)]
        right = [kernel.get(s, Fraction(0)) if inside(i, s) else Fraction(0) for s in range(size)]
        right[0] = -sum(right)  # values count from that of the empty coalition
        rows.append([*gram, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction((s == full) - (s == 0)) for s in range(size)]])
    for at in range(n + 1):
        pivot = next(r for r in range(at, n + 1) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(n + 1):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at])]
    values = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in values for x in row):
        raise ArithmeticError("a Shapley value of n players is a whole number of n!-ths")
    return [[int(x) for x in row] for row in values]


def cells(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", bad: str = "toxic", conditions=CONDITIONS) -> DataFrame:
    """(part, cell, n, good, bad): rows of each part by the set of filters they fail, bit i for the i-th condition, the last for repeats.

    Null texts and parts count as empty. A null identifier is not larger than any, so its row never counts as repeated; rows
    with equal identifiers and texts are repeated by smaller identifiers only. Labels of one identifier are taken together: good or bad if
    any says so. An empty table gives no rows.
    """
    last = 1 << len(conditions)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", SPACE), "").alias("split"))
    rows = rows.select(
        "id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.size("split").alias("words"),
        F.size(F.array_distinct("split")).alias("distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"),
        F.length("text").alias("chars"),
        F.col("text").rlike("[#$%&*|]").alias("marks"),
    )
    fails = sum((F.when(c(), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    # Rows without identifier have no label; their digest deals them over the tasks of the join.
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("id", "part", "digest", fails.alias("cell"), salt.alias("salt"))
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.max(F.when(F.col(good) == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col(bad) == 1, 1).otherwise(0)).alias("bad")
    )
    marks = marks.withColumn("salt", F.lit(0).cast("long"))
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    rows = rows.join(marks, ["id", "salt"], "left").select("*", F.lit(1).cast("long").alias("n")).fillna(0, ["good", "bad"])
    rows = store(rows.groupBy("id", "salt", "digest", "part", "cell").agg(*sums()).drop("salt"))
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    firsts = rows.join(first, ["digest", "id"]).select("part", "cell", "n", "good", "bad")
    firsts = firsts.union(rows.filter("id IS NULL").select("part", "cell", "n", "good", "bad"))
    firsts = store(firsts.groupBy("part", "cell").agg(*sums()))
    everything = rows.groupBy("part", "cell").agg(*sums())
    repeated = everything.union(firsts.select("part", "cell", -F.col("n"), -F.col("good"), -F.col("bad")))
    found = firsts.union(repeated.select("part", F.col("cell") + last, "n", "good", "bad")).groupBy("part", "cell").agg(*sums())
    return found.filter("n > 0")


def interactions(found: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step, of the counted cells of `cells`.

    Columns: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, bad_lost, shapley (n! times the
    filter's Shapley value of removals, a whole number).
    """
    n = len(filters)
    full = (1 << n) - 1
    counted = F.collect_list(F.struct("cell", "n", "good", "bad")).alias("cells")  # at most 2^n
    parts = found.groupBy("part").agg(F.sum("n").alias("rows"), counted)
    coalitions = F.sequence(F.lit(0), F.lit(full))

    def removals(measure: str) -> Column:
        of = lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(c["cell"].bitwiseAND(s) != 0, c[measure]).otherwise(0))
        return F.transform(coalitions, of)

    parts = parts.select("part", "rows", *[removals(m).alias(f"{m}_of") for m in ("n", "good", "bad")])
    weights = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in shapley_coefficients(n)])
    values = F.transform(weights, lambda w: F.aggregate(F.zip_with(w, F.col("n_of"), lambda x, y: x * y), F.lit(0).cast("long"), lambda a, b: a + b))
    parts = parts.withColumn("values", values)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = [F.instr("filter_order", f) for f in filters]
    coalition = lambda taken: sum((F.when(taken(p), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    steps = steps.select(
        "*",
        F.expr("substring(filter_order, step, 1)").alias("filter"),
        coalition(lambda p: p < F.col("step")).alias("before"),
        coalition(lambda p: p <= F.col("step")).alias("after"),
    )
    bit = F.col("after") - F.col("before")
    at = lambda measure, s: F.col(f"{measure}_of")[s]
    gain = lambda measure: at(measure, F.col("after")) - at(measure, F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (F.col("rows") - at("n", F.col("after"))).alias("kept"),
        gain("n").alias("removed"),
        (at("n", bit) - gain("n")).alias("redundant"),
        (at("n", F.lit(full)) - at("n", full - bit)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("bad").alias("bad_lost"),
        F.col("values")[F.instr(F.lit(filters), F.col("filter")) - 1].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions=CONDITIONS, **columns) -> DataFrame:
    """`interactions` of the filters of `conditions` and the repeats of a table of documents."""
    return interactions(cells(docs, labels, conditions=conditions, **columns), "".join(conditions) + REPEATED)

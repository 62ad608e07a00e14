"""Quality classifier: a sparse ensemble of rules over text statistics (RuleFit, Friedman and Popescu 2008).

Shallow trees are grown over statistics of the labelled texts; every path from a root to a node is a rule, the conjunction of
its splits. A logistic regression with a lasso penalty keeps the few rules that matter, and these become one Spark column expression,
so scoring is a projection over the scan.
"""

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.llm.tables import UPPER
from bondmarts.storage import store

#: Labelled rows that are learnt from, at most: those with the least hash of their id.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 16, 3, 0.002, 7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as doubles; an empty or null text has zeros."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    length = F.length(text)
    count = lambda chars: length - F.length(F.translate(text, chars, ""))
    share = lambda a, b: a.cast("double") / F.greatest(b, F.lit(1))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = count("\n") + 1
    distinct = lambda pattern: F.size(F.array_distinct(F.split(text, pattern)))
    return {
        "log_words": F.log1p(words.cast("double")),
        "mean_word": share(length, words),
        "marks": share(count("#$%&*"), length),
        "pipes": share(count("|"), words),
        "shouts": share(count("!"), words),
        "capitals": share(count(UPPER), length),
        "digits": share(count("0123456789"), length),
        "brackets": share(count("{}<>[]()=/\\"), length),
        "stops": share(count(".?"), words),
        "commas": share(count(",;:"), words),
        "line_length": share(length, lines),
        "short_words": share(F.regexp_count(text, F.lit(r"\b\p{L}{1,3}\b")), words),
        "distinct_words": share(distinct(r"\s+"), words),
        "distinct_lines": share(distinct("\n"), lines),
    }


@dataclass(frozen=True)
class Rule:
    """All of `splits` (statistic, is above, threshold) hold; with no split, always."""

    splits: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        sides = [F.col(name) > t if above else F.col(name) <= t for name, above, t in self.splits]
        return reduce(and_, sides, F.lit(True))


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1, over columns with the names of the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def paths(trees, names: list[str]) -> list[Rule]:
    """The rules of all nodes below the roots, each once; a statistic that is split twice the same way keeps the narrower split."""
    found: dict[Rule, None] = {}

    def walk(node, limits: dict[tuple[str, bool], float]):
        if limits:
            found[Rule(tuple(sorted((n, above, t) for (n, above), t in limits.items())))] = None
        if node.numDescendants() == 0:
            return
        name, threshold = names[node.split().featureIndex()], float(node.split().threshold())
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            old = limits.get((name, above), threshold)
            walk(child, {**limits, (name, above): max(old, threshold) if above else min(old, threshold)})

    for tree in trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(rows: DataFrame, names: list[str], label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Learn from rows of statistics and a 0/1 label. With one label only, or no rows, the score is constant: that label's share, or 0.5."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        one = next(iter(counts), None)
        return Ensemble({None: 0.0, 0: -5.0, 1: 5.0}[one])
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select(F.col(label).cast("double").alias("_y"), "_x", *names)
    forest = RandomForestClassifier(
        labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED
    ).fit(data)
    rules = paths(forest.trees, names)
    flags = [r.column().cast("double").alias(f"_r{i}") for i, r in enumerate(rules)]
    matrix = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_z").transform(data.select("_y", *flags)).select("_y", "_z")
    model = LogisticRegression(labelCol="_y", featuresCol="_z", elasticNetParam=1.0, regParam=lasso, maxIter=100).fit(matrix)
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def train(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", learn: Column | None = None, max_rows: int = MAX_ROWS) -> Ensemble:
    """Learn `label` of `labels` (0/1 per id) from the texts of docs. `learn` says which labels may be used.

    Null labels are left out; an id with different labels counts with the lower one. Only ids, labels and texts are read.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy(F.col(id).alias("_id")).agg(F.min(label).cast("int").alias("label"))
    sample = store(known.select("_id", "label", F.xxhash64(F.col("_id").cast("string")).alias("_order")).orderBy("_order", "_id").limit(max_rows))
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(sample, "_id")
    measured = statistics(F.col("_text"))
    rows = texts.select("label", "_order", *[c.alias(n) for n, c in measured.items()])
    return fit(store(rows.orderBy("_order", *measured)), list(measured))


def scored(docs: DataFrame, model: Ensemble, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as a further last column, 0 to 1. The statistics get names of their own, so no column clashes."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stats = statistics(F.col(f"`{text}`"))
    # A filter on the score would otherwise be pushed below the statistics, and every rule would compute its own again.
    once = F.monotonically_increasing_id().alias("_once")
    row = docs.select(F.struct(*columns).alias("_docs"), *[c.alias(n) for n, c in stats.items()], once)
    return row.select(*[F.col("_docs").getField(c).alias(c) for c in docs.columns], F.when(F.col("_once") >= 0, model.score()).alias(name))

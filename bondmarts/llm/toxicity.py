"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (McMahan et al., 2013).

A text's features are its distinct words and their stems (the first STEM bytes, so that inflected forms share one), pairs of
neighbours and pairs with one word between, words being runs of letters, digits and non-ASCII characters. Every coordinate has its own learning rate, and the L1 penalty leaves few weights, which go to all tasks.
Learning is one sequence over a bounded sample of labelled texts; texts stream through it, only the coordinates are held.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bondmarts.llm.tables import small_batches
from bondmarts.llm.words import PUNCTUATION, U, Words, chunks, mix
from bondmarts.storage import store

#: Labelled rows that are learnt from, at most: those with the least hash of their id. Weights kept, at most.
MAX_ROWS, MAX_WEIGHTS = 16_000, 100_000
#: Coordinates of the hashed space as a power of two.
BITS = 22
EPOCHS, STEM = 4, 5
ALPHA, BETA, L1, L2 = 4.0, 1.0, 5.0, 0.0
#: Value of a pair as a feature; that of a word is 1.
PAIR = 0.3


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature hash, is a pair) of all features of a chunk, not yet distinct."""
    h, n = words.hashes, len(words.hashes)
    text = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    parts = [(text, h, False), (text, words.stems(STEM), False)]
    for gap, (a, b) in ((1, (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))), (2, (U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)))):
        if n > gap:
            same = text[gap:] == text[:-gap]
            parts.append((text[gap:][same], mix(h[:-gap] * a + h[gap:] * b)[same], True))
    pair = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pair


class Ftrl:
    """State of the learner: z and n of every coordinate, and of the intercept, which has no penalty."""

    def __init__(self, bits: int = BITS):
        self.mask = U((1 << bits) - 1)
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.z0 = self.n0 = 0.0

    def intercept(self) -> float:
        return -self.z0 / ((BETA + self.n0**0.5) / ALPHA)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, hashes: np.ndarray, values: np.ndarray, label: int) -> None:
        """One text with its distinct feature hashes and their values."""
        at, first = np.unique((hashes & self.mask).astype(np.int64), return_index=True)
        x = values[first]
        w, w0 = self.weights(at), self.intercept()
        error = 1 / (1 + np.exp(-np.clip((w * x).sum() + w0, -35, 35))) - label
        g = error * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g
        self.z0 += error - ((self.n0 + error * error) ** 0.5 - self.n0**0.5) / ALPHA * w0
        self.n0 += error * error


def _train(epochs: int):
    """Rows (pass, text, label) in order to rows (feature hash, weight); a null hash has the intercept.

    In the pass after the last epoch the hashes behind every coordinate with a weight are counted, so that a feature that
    only shares the coordinate by chance gets none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        owners: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            rounds, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for start, part in chunks(batch.column(1)):
                text, hashes, pair = features(Words(part, PUNCTUATION))
                order = np.argsort(text, kind="stable")
                hashes, pair, edges = hashes[order], pair[order], np.searchsorted(text[order], np.arange(len(part) + 1))
                for d in range(len(part)):
                    own, first = np.unique(hashes[edges[d] : edges[d + 1]], return_index=True)
                    values = np.where(pair[edges[d] : edges[d + 1]][first], PAIR, 1.0)
                    if rounds[start + d] < epochs:
                        model.learn(own, values, int(labels[start + d]))
                    else:
                        used = model.weights((own & model.mask).astype(np.int64)) != 0
                        for h, x in zip(own[used].tolist(), values[used].tolist()):
                            owners[h & int(model.mask)][h, x] += 1
        found = {}
        for at, counts in owners.items():
            w, most = float(model.weights(np.array([at]))[0]), max(counts.values())
            found.update({h: w * x for (h, x), c in counts.items() if 2 * c >= most})
        kept = sorted(found, key=lambda h: (-abs(found[h]), h))[:MAX_WEIGHTS]
        hashes = np.array(kept, U).view(np.int64)
        yield pa.record_batch(
            [pa.array([None, *hashes.tolist()], pa.int64()), pa.array([model.intercept(), *[found[h] for h in kept]], pa.float64())], names=["hash", "weight"]
        )

    return run


@dataclass
class Weights:
    """Sorted feature hashes and their weights."""

    intercept: float
    hashes: np.ndarray
    values: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        for start, part in chunks(texts):
            if not len(self.hashes):
                continue
            text, hashes, _ = features(Words(part, PUNCTUATION))
            near = self.near[(hashes & U(0xFFFFF)).astype(np.int64)]
            text, hashes = text[near], hashes[near]
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(np.stack([text[hit], at[hit]], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
            np.add.at(total, start + pairs[:, 0], self.values[pairs[:, 1]])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    @property
    def near(self) -> np.ndarray:
        """Which low bits occur, to pass over most features at once."""
        if not hasattr(self, "_near"):
            self._near = np.zeros(1 << 20, bool)
            self._near[(self.hashes & U(0xFFFFF)).astype(np.int64)] = True
        return self._near


def train(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", learn: Column | None = None, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Weights:
    """Learn `label` of `labels` (0/1 per id) from the texts of docs. `learn` says which labels may be used.

    Null labels and ids are left out; an id with different labels counts with the higher one. Without labelled rows the score is 0.5.
    Only ids, labels and texts are read.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    sample = store(known.select("_id", "label", F.xxhash64(F.col("_id").cast("string")).alias("_order")).orderBy("_order", "_id").limit(max_rows))
    texts = store(docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).join(sample, "_id"))
    rounds = texts.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
    ordered = rounds.repartition(1).sortWithinPartitions("round", "_order", "_id", "_text").select("round", "_text", "label")
    rows = store(ordered.mapInArrow(_train(epochs), "hash long, weight double")).collect()  # at most MAX_WEIGHTS rows
    intercept = next((r.weight for r in rows if r.hash is None), 0.0)
    hashes = np.array([r.hash for r in rows if r.hash is not None], np.int64).view(U)
    values = np.array([r.weight for r in rows if r.hash is not None], float)
    order = np.argsort(hashes)
    return Weights(intercept, hashes[order], values[order])


def scored(docs: DataFrame, model: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as a further last column, 0 to 1; a null text counts as empty."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(weights.value.score(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[str(i) for i in range(batch.num_columns + 1)])

    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(run, schema).toDF(*docs.columns, name)

"""Near duplicates by SimHash: tiles of fingerprints compared exactly with exclusive-or and bit counts.

A fingerprint of 64 bits says for each bit whether more than half of the text's word shingles, repeats included, have it in their hash.
Fingerprints within RADIUS differing bits are linked. Equal fingerprints are one class. The classes are tiled by their population
counts, taken over equal pieces of the fingerprint: two of them differ in at least as many bits as their counts differ, summed over the
pieces, so only pairs of tiles within the radius of each other are compared and all others are skipped. More pieces make more and
smaller tiles; a large tile is cut into blocks of bounded size, and each pair of blocks is a row of its own, free to go to any task.
A pair of blocks gives as many links as join what it links, never all pairs of a dense group.
"""

from collections.abc import Iterator
from itertools import product
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bondmarts.llm.components import components
from bondmarts.llm.tables import UPPER, LOWER, small_batches
from bondmarts.storage import store

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a block, about; a pair of blocks is one comparison.
BLOCK = 2048
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Fingerprints up to which four pieces make tiles small enough; beyond it eight.
FEW = 100_000_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of about PIECE bytes. bytes.split cuts at \\x20 and \\x09-\\x0D, and nowhere else."""
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + PIECE)
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text. Fewer words than a shingle has are one shingle; no words give 0."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _word_lists(data.translate(_LOWER)):
        words = tail + words
        if len(words) >= shingle:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[: -shingle] + 1).tolist()]
            joined = b" ".join(words)
            hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
            bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            words = words[-(shingle - 1) :]
        tail = words
    if not total and tail:
        return digest(b" ".join(tail), seed)
    return int((2 * ones > total).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))) if total else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "fp"])


def fingerprinted(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long, of every row; written once. Null texts count as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text).cast("string").alias("_simhash_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return store(rows.mapInArrow(_fingerprints, schema))


def _tile(fp: str, pieces: int) -> Column:
    """Bit counts of the pieces of a fingerprint, seven bits each."""
    width = 64 // pieces
    piece = lambda i: F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)) if pieces > 1 else F.col(fp)
    return sum((F.shiftleft(F.bit_count(piece(i)).cast("long"), 7 * i) for i in range(pieces)), F.lit(0).cast("long"))


def near_tiles(pieces: int, radius: int) -> list[int]:
    """What to add to a tile for each tile at most `radius` counts away, its own included, the one of each pair with the larger number."""
    steps = (d for d in product(range(-radius, radius + 1), repeat=pieces) if sum(map(abs, d)) <= radius)
    return sorted(x for x in (sum(d << 7 * i for i, d in enumerate(step)) for step in steps) if x >= 0)


def _spanning(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that `ok` (rows a, columns b) links: its own while they are few, else at most one a fingerprint."""
    if np.count_nonzero(ok) <= len(a) + len(b):
        i, j = np.nonzero(ok)
        return a[i], b[j]
    far = len(a)
    of_a = np.arange(far)
    while True:
        of_b = np.where(ok, of_a[:, None], far).min(axis=0)
        least = np.minimum(of_a, np.where(ok, of_b[None, :], far).min(axis=1))
        if (least == of_a).all():
            break
        of_a = least
    hit = of_b < far
    return np.concatenate([a[of_a], a[of_b[hit]]]), np.concatenate([a, b[hit]])


def _near(radius: int):
    """Pairs of blocks to links; only a band of rows of the comparison is held at a time unless the blocks are dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
                band = max(1, (1 << 20) // len(b))
                ok = np.concatenate([np.bitwise_count(a[i : i + band, None] ^ b[None, :]) <= radius for i in range(0, len(a), band)])
                if ok.any():
                    links.append(_spanning(a, b, ok))
            x, y = (np.concatenate([p[k] for p in links] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            differ = x != y
            yield pa.RecordBatch.from_arrays([pa.array(x[differ]), pa.array(y[differ])], names=["a", "b"])

    return run


def links(classes: DataFrame, radius: int = RADIUS, pieces: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) between fingerprints of `classes` (distinct, column fp) that join all those within the radius of each other."""
    pieces = pieces or (4 if classes.count() <= FEW else 8)
    tiled = store(classes.select("fp", _tile("fp", pieces).alias("tile")))
    sizes = store(tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).alias("blocks")))
    blocks = tiled.join(sizes, "tile").groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block")).agg(F.collect_list("fp").alias("fps"))
    blocks = store(blocks)
    steps = F.array(*[F.lit(x).cast("long") for x in near_tiles(pieces, radius)])
    left = blocks.select("fps", "block", F.explode(steps).alias("step"), (F.col("tile") + F.col("step")).alias("tile"))
    left = left.select(F.col("fps").alias("left"), F.col("block").alias("left_block"), "step", "tile").join(sizes, "tile")
    left = left.select("left", "left_block", "step", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left = left.filter("step > 0 OR block >= left_block").select("left", "tile", "block")
    pairs = left.join(blocks, ["tile", "block"]).select("left", F.col("fps").alias("right"))
    return pairs.mapInArrow(_near(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 lowercase hex digits) and component_id, the least id that links reach.

    Texts without words, empty and null ones have fingerprint 0 and are linked like any other. Rows with equal ids are rows of their own;
    null ids are never the least, so a component of null ids only has a null component_id. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    rows = fingerprinted(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), ["_id"], "_text")
    classes = store(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = components(links(classes.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    rooted = store(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = store(rooted.join(ids, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(by_class, "fp").select(F.col("_id").alias(id), hexed, "component_id")

"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of `SEED` words are joined. For each such pair the longest common run of words
not yet covered is marked in both, again and again, until no run of `SEED` words is left (Wise, 1993); runs are found from
Karp-Rabin hashes of all word n-grams. The covered share of the item's words decides, so an item is found also where its
passages were moved about. Words are compared without ASCII punctuation around them. Items of fewer than `SEED` words are found as
whole word sequences.

Two texts that repeat a few words have very many seed pairs. Beyond `PAIRS` of them the longest free run is found by halving on
its length, with hashes of all runs of one length, which takes memory in proportion to the two texts; the tiles are the same.

The words of the benchmark go to every task while there are at most `max_words` of them, which bounds that copy to 8 bytes
each; a larger benchmark is joined with the documents on the seeds. Both ways give the same rows.
"""

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.llm.tables import located, small_batches, without
from bondmarts.llm.words import U, Words, chunks, mix
from bondmarts.storage import store

SEED = 5
#: Share of an item's words that must be covered, or words that one run must have: of a long item a long quotation is a leak, too.
COVERAGE = 0.5
LONG_RUN = 25
MAX_WORDS = 4_000_000
#: Seed pairs of an item and a document that are held at once.
PAIRS = 1_000_000

Tile = tuple[int, int, int]


def _grams(hashes: np.ndarray, size: int = SEED) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` words; runs of different sizes have different ones."""
    m = len(hashes) - size + 1
    total = np.zeros(max(m, 0), U)
    for i in range(size):
        total = total * U(0x9E3779B97F4A7C15) + hashes[i : i + len(total)]
    return mix(total + U(size))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: a run is two runs of the power of two below n, which may overlap."""
    join = lambda h, gap: mix(h[: max(len(h) - gap, 0)] * U(0xC2B2AE3D27D4EB4F) + h[gap:] * U(0x165667B19E3779F9))
    size = 1
    while 2 * size <= n:
        hashes, size = join(hashes, size), 2 * size
    return join(hashes, n - size) if n > size else hashes


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n words of which none is marked."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[n:] == sums[:-n])


def _tiles_by_length(item: np.ndarray, doc: np.ndarray) -> list[Tile]:
    """The same tiles as `tiles`, one length after the other, in memory proportional to the texts."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[Tile] = []

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free runs of n words in both: item places and their hashes, document places by hash and place, and their hashes."""
        i, j = _free(in_item, n), _free(in_doc, n)
        a, b = _runs(item, n)[i], _runs(doc, n)[j]
        j, b = (x[np.isin(b, a)] for x in (j, b))
        own = np.isin(a, b)
        order = np.argsort(b, kind="stable")
        return i[own], a[own], j[order], b[order]

    # A common run of n words holds one of each lesser length, so the longest is found by halving.
    longest = min(len(item), len(doc))
    while longest >= SEED:
        least, most = SEED - 1, longest
        while least < most:
            middle = (least + most + 1) // 2
            least, most = (middle, most) if len(shared(middle)[0]) else (least, middle - 1)
        n = longest = least
        if n < SEED:
            break
        i, a, j, b = shared(n)
        low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        for place, x, y in zip(i.tolist(), low.tolist(), high.tolist()):
            if in_item[place : place + n].any():
                continue
            # Runs were free before this length, so what covers one now is a tile of n words: go on behind it.
            while x < y and (taken := np.flatnonzero(in_doc[j[x] : j[x] + n])).size:
                x += int(np.searchsorted(j[x:y], j[x] + taken[-1] + 1))
            if x < y:
                in_item[place : place + n] = in_doc[j[x] : j[x] + n] = True
                found.append((place, int(j[x]), n))
        longest = n - 1
    return found


def tiles(item: np.ndarray, item_grams: np.ndarray, doc: np.ndarray, doc_grams: np.ndarray, max_pairs: int = PAIRS) -> list[Tile]:
    """(start in item, start in doc, words), longest first; ties go to the earlier place in the item, then in the document."""
    order = np.argsort(doc_grams, kind="stable")
    ranked = doc_grams[order]
    low, high = np.searchsorted(ranked, item_grams, "left"), np.searchsorted(ranked, item_grams, "right")
    times = high - low
    if not times.any():
        return []
    if times.sum() > max_pairs:
        return _tiles_by_length(item, doc)
    i = np.repeat(np.arange(len(item_grams)), times)
    within = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    j = order[np.repeat(low, times) + within]
    # Seeds that follow each other on a diagonal are one run.
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(i))) + SEED - 1
    heap = [(-int(n), int(i[s]), int(j[s])) for s, n in zip(starts, lengths)]
    heapify(heap)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found = []
    while heap:
        n, a, b = heappop(heap)
        n = -n
        free = ~(in_item[a : a + n] | in_doc[b : b + n])
        if free.all():
            in_item[a : a + n] = in_doc[b : b + n] = True
            found.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= SEED:
                heappush(heap, (x - y, a + x, b + x))
    return found


class Benchmark:
    """Word hashes of all items, and the items that have each seed. The seed of an item of fewer words is the whole of it."""

    def __init__(self, ids: list, hashes: list[np.ndarray]):
        self.ids, self.hashes = ids, hashes
        sizes = [min(len(h), SEED) for h in hashes]
        self.sizes = sorted(set(sizes))
        self.grams = [_grams(h, n) for h, n in zip(hashes, sizes)]
        flat = np.concatenate(self.grams) if self.grams else np.zeros(0, U)
        owner = np.repeat(np.arange(len(ids)), [len(g) for g in self.grams])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def candidates(self, grams: np.ndarray) -> list[int]:
        if not len(self.seeds):
            return []
        at = np.searchsorted(self.seeds, grams)
        hit = np.unique(grams[self.seeds[np.minimum(at, len(self.seeds) - 1)] == grams])
        low, high = np.searchsorted(self.seeds, hit, "left"), np.searchsorted(self.seeds, hit, "right")
        return sorted({int(o) for a, b in zip(low, high) for o in self.owner[a:b]})

    def compare(self, k: int, doc: np.ndarray, grams: dict[int, np.ndarray]) -> tuple[float, list[Tile]]:
        """Of item k and a document with its grams by size; of a short item the first place counts."""
        item = self.hashes[k]
        if len(item) < SEED:
            at = np.flatnonzero(grams[len(item)] == self.grams[k][0])
            return (1.0, [(0, int(at[0]), len(item))]) if len(at) else (0.0, [])
        found = tiles(item, self.grams[k], doc, grams[SEED])
        return sum(t[2] for t in found) / len(item), found


def _within(all_grams: dict[int, np.ndarray], x: int, y: int) -> dict[int, np.ndarray]:
    """Of grams by size those of the words x to y."""
    return {n: g[x : max(y - n + 1, x)] for n, g in all_grams.items()}


_MATCH = "_file string, _row long, item_id {id}, coverage double, tiles array<struct<item_start:int,doc_start:int,words:int>>"
_TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))


def _out(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    file, row, item, coverage, found = zip(*rows) if rows else ((), (), (), (), ())
    found = [[{"item_start": a, "doc_start": b, "words": n} for a, b, n in f] for f in found]
    return pa.record_batch(
        [pa.array(file, pa.string()), pa.array(row, pa.int64()), pa.array(item, id_type), pa.array(coverage, pa.float64()), pa.array(found, _TILES)],
        names=["_file", "_row", "item_id", "coverage", "tiles"],
    )


def _search(bench, id_type: pa.DataType):
    """(_file, _row, text) to a row for each item that shares a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = bench.value
        for batch in batches:
            file, row = batch.column(0), batch.column(1)
            for start, part in chunks(batch.column(2)):
                words = Words(part)
                hashes = words.bare()
                all_grams = {n: _grams(hashes, n) for n in b.sizes}
                rows = []
                for d, (x, y) in enumerate(zip(words.at[:-1], words.at[1:])):
                    grams = _within(all_grams, x, y)
                    for k in b.candidates(np.concatenate([*grams.values(), np.zeros(0, U)])):
                        rows.append((file[start + d].as_py(), row[start + d].as_py(), b.ids[k], *b.compare(k, hashes[x:y], grams)))
                yield _out(rows, id_type)

    return run


def _seeds(keep: int, sizes: list[int] | None = None):
    """(key columns, text) to (key columns, seed), one row for each distinct seed: runs of the given sizes, or the seeds of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch.column(keep)):
                words = Words(part)
                hashes = words.bare()
                all_grams = {n: _grams(hashes, n) for n in sizes or range(1, SEED + 1)}
                sets = []
                for x, y in zip(words.at[:-1], words.at[1:]):
                    grams = _within(all_grams, x, y)
                    sets.append(np.unique(np.concatenate(list(grams.values())) if sizes else grams[min(max(y - x, 1), SEED)]))
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]) + start)
                seeds = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.record_batch([*[batch.column(i).take(at) for i in range(keep)], pa.array(seeds.view(np.int64))], names=[str(i) for i in range(keep + 1)])

    return run


def _compare(id_type: pa.DataType):
    """(_file, _row, item_id, item, text) to the same rows as `_search`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, row, id, item, text in zip(*(batch.column(i) for i in range(5))):
                a, d = (Words(pa.array([t.as_py()], pa.string()).cast(pa.large_binary())).bare() for t in (item, text))
                b = Benchmark([id.as_py()], [a])
                rows.append((file.as_py(), row.as_py(), id.as_py(), *b.compare(0, d, {n: _grams(d, n) for n in b.sizes})))
            yield _out(rows, id_type)

    return run


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("item"), words.alias("size")).filter("size > 0")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Every (row of docs, item) that shares a seed: _file, _row, item_id, coverage and the tiles (places in words).

    Null texts are empty. An item of fewer than SEED words matches where its whole word sequence occurs; an item without words
    matches nothing; empty tables give no rows; repeated items and documents give a row each. Only the named columns are read.

    For docs that do not come straight from Parquet files, _file and _row are places in a table that this call writes: to join
    on them, take rows of `located` and `matches_of`.
    """
    texts = located(docs.select(F.col(text).cast("string").alias("_text")), "_text")
    return matches_of(texts, benchmark, item_id, item_text, max_words)


def matches_of(texts: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """As `matches`, for rows of `located`: _file, _row and _text."""
    spark = texts.sparkSession
    small_batches(spark)
    items = store(_items(benchmark, item_id, item_text))
    id_field = items.schema["item_id"].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_field.simpleString()]
    schema = _MATCH.format(id=id_field.simpleString())
    texts = texts.select("_file", "_row", "_text")
    if (items.agg(F.sum("size")).first()[0] or 0) <= max_words:
        rows = items.orderBy("item_id", "item").collect()  # at most max_words words
        hashes = [Words(pa.array([r.item], pa.string()).cast(pa.large_binary())).bare() for r in rows]
        bench = spark.sparkContext.broadcast(Benchmark([r.item_id for r in rows], hashes))
        return texts.mapInArrow(_search(bench, id_type), schema)
    items = store(items.withColumn("copy", F.monotonically_increasing_id()))
    wanted = items.select("copy", "item").mapInArrow(_seeds(1), "copy long, seed long")
    sizes = sorted(r.size for r in items.select(F.least("size", F.lit(SEED)).alias("size")).distinct().collect())  # at most SEED
    have = texts.mapInArrow(_seeds(2, sizes), "_file string, _row long, seed long")
    pairs = store(have.join(wanted, "seed").select("_file", "_row", "copy").distinct())
    both = pairs.join(items, "copy").join(texts, ["_file", "_row"]).select("_file", "_row", "item_id", "item", "_text")
    return both.mapInArrow(_compare(id_type), schema)


def leaked(coverage: float = COVERAGE) -> Column:
    """Of rows of `matches`; the first tile is the longest."""
    return (F.col("coverage") >= coverage) | F.coalesce(F.get("tiles", F.lit(0))["words"] >= LONG_RUN, F.lit(False))


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", coverage: float = COVERAGE, text: str = "text", **options) -> DataFrame:
    """One row per row of docs: the id, item_id of the best covered item (ties: the least; null if none), coverage (0 if none) and contaminated, by that item or another."""
    rows = located(docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")), "_id", "_text")  # once: another call may write another table
    found = store(matches_of(rows, benchmark, **options))
    best = found.groupBy("_file", "_row").agg(F.min(F.struct((-F.col("coverage")).alias("less"), "item_id")).alias("best"), F.max(leaked(coverage)).alias("leaked"))
    rows = rows.select("_id", "_file", "_row").join(best, ["_file", "_row"], "left")
    share = F.coalesce(-F.col("best.less"), F.lit(0.0))
    return rows.select("_file", "_row", F.col("_id").alias(id), F.col("best.item_id").alias("item_id"), share.alias("coverage"), F.coalesce("leaked", share >= coverage).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is covered to that share or quoted in a long run."""
    bad = matches(docs, benchmark, **options).filter(leaked(coverage)).select("_file", "_row").distinct()
    return without(docs, store(bad))


"""Similarity join of whole texts on distinct word shingles, and the groups it links.

Two texts link when |A & B| / |A | B| of their 5-word shingle sets is at least 75 %. The way to all links, none lost:

1. One pass measures every text: set size, set fingerprint, a hashed bitmap signature of 1.5 to 3 bits a shingle, and
   a fixed-size count sketch of all shingles of the corpus. Equal sets are one class from here on.
2. Prefix filter: linked sets share a shingle among the first n - ceil(0.75 n) + 1 of each, in any order that is the same for
   all. The order puts shingles that the sketch finds frequent last, so that a passage of many texts makes no hot key.
3. Classes that share such a shingle are a tile; tiles with the same classes count once.
4. In each tile and size band, every class is compared with one leader of the band, which costs a row per class. The links
   are contracted to components, then only classes of different components are compared any more.
5. Tiles are cut into size bands and blocks of bounded size. In a block, bit counts of the signatures bound the overlap from
   above: |A & B| <= (|A| + |B| - bits(a xor b)) / 2. Classes that may link are grouped, and the groups go to cells, again of
   bounded size, for the exact intersection of sorted arrays.

A whole text is never cut. Signatures, keys and sets are 64-bit hashes of words (see `words`).
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bondmarts.llm.components import components
from bondmarts.llm.tables import located, small_batches
from bondmarts.llm.words import CHUNK, U, Words, chunks, mix
from bondmarts.storage import store

SHINGLE = 5
#: A link needs 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
#: Cells of each of the two rows of the count sketch, and cells in one piece of it.
CELLS, PIECE = 1 << 19, 1 << 13
#: Classes of a tile that meet in one block; a larger tile is dealt over more blocks.
BLOCK = 512
#: Rows of blocks that a task is given because they share their least class, about.
TASK = 4_000
#: Rows of one key held at a time.
HELD = 1 << 20


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % U(CELLS)).astype(np.int64), ((h >> U(24)) % U(CELLS)).astype(np.int64)


def _signature(s: np.ndarray) -> bytes:
    """Bits of 1.5 to 3 times the set size, each the parity of how many shingles fall on it, so that common ones cancel in an xor."""
    width = max(64, 1 << (3 * len(s) // 2 - 1).bit_length())
    return np.packbits(np.bincount(((s >> U(13)) % U(width)).astype(np.int64), minlength=width) & 1).tobytes()


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([len(s)], U) + mix(s).sum(dtype=U)).view(np.int64)[0]) if len(s) else 0


def _measure(keep: int):
    """Carried columns and text to n, set fingerprint and signature; the sketch of the task comes as further rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, CELLS), np.int64)
        carried = None
        for batch in batches:
            for start, part in chunks(batch.column(keep)):
                sets = list(Words(part).shingles(SHINGLE))
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                for row, cells in zip(sketch, _cells(flat)):
                    row += np.bincount(cells, minlength=CELLS)
                carried = [batch.column(i).slice(start, len(part)) for i in range(keep)]
                rows = len(part)
                yield pa.record_batch(
                    [
                        *carried,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) for s in sets], pa.int64()),
                        pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=[str(i) for i in range(keep + 5)],
                )
        if carried is None:
            return
        flat = sketch.reshape(-1, PIECE)
        used = np.flatnonzero(flat.any(axis=1))
        none = [pa.nulls(len(used), c.type) for c in carried]
        pieces = [
            *none, pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()),
            pa.array(used, pa.int32()), pa.array([flat[i].astype("<u4").tobytes() for i in used], pa.binary()),
        ]
        yield pa.record_batch(pieces, names=[str(i) for i in range(keep + 5)])

    return run


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pieces of the sketch that came to this task, one at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[piece] = total.get(piece, 0) + np.frombuffer(counts.as_buffer(), "<u4").astype(U)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["piece", "counts"])


def measured(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """One row per document: the carried columns, n, fp, signature; and rows with a piece of the sketch."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry])
    schema = schema.add("n", "long").add("fp", "long").add("signature", "binary").add("piece", "integer").add("counts", "binary")
    return store(docs.select(*carry, F.col(text).cast("string")).mapInArrow(_measure(len(carry)), schema))


def _levels(measures: DataFrame) -> np.ndarray:
    """Order class of every cell of the sketch: 0, or the logarithm of a count that stands out. Always 2 * CELLS bytes."""
    pieces = measures.filter("piece IS NOT NULL").select("piece", "counts")
    sums = pieces.repartition("piece").mapInArrow(_sum_pieces, "piece int, counts binary").collect()
    counts = np.zeros((2 * CELLS // PIECE, PIECE), np.uint64)
    for r in sums:
        counts[r.piece] = np.frombuffer(r.counts, "<u8")
    counts = counts.reshape(2, CELLS).astype(np.float64)
    usual = 2 * counts[0].mean() + 64
    return np.where(counts < usual, 0, np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    n = len(s)
    size = n - -(-PERCENT * n // 100) + 1
    a, b = _cells(s)
    order = np.minimum(levels[0][a], levels[1][b])
    return s[np.argsort(order, kind="stable")[:size]] if order.any() else s[:size]


def _keys(levels):
    """Text to (key, fp, n), a row for each shingle of the prefix; a set that a task has seen before gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, part in chunks(batch.column(0), CHUNK):
                keys, fps, sizes = [], [], []
                for s in Words(part).shingles(SHINGLE):
                    fp = _fingerprint(s)
                    if len(s) and fp not in seen:
                        seen.add(fp)
                        keys.append(_prefix(s, levels.value))
                        fps.append(fp)
                        sizes.append(len(s))
                if keys:
                    times = [len(k) for k in keys]
                    yield pa.record_batch(
                        [np.concatenate(keys).view(np.int64), np.repeat(np.array(fps, np.int64), times), np.repeat(np.array(sizes, np.int64), times)],
                        names=["key", "fp", "n"],
                    )

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, n and fp to the classes of each key that several classes have; equal member sets come once a task."""
    seen: set[int] = set()
    held = [np.zeros(0, np.int64)] * 3
    hot = None  # the key whose first rows have gone out already

    def out(tile, fp, n):
        return pa.record_batch([tile.astype(U).view(np.int64), fp, n], names=["tile", "fp", "n"])

    def emit(key, fp, n):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp, n = key[new], fp[new], n[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        tile = mix(np.bitwise_xor.reduceat(mix(fp.view(U) + U(1)), starts) + sizes.astype(U))
        take = np.zeros(len(starts), bool)
        for i in np.flatnonzero(sizes > 1):
            if (t := int(tile[i])) not in seen:
                seen.add(t)
                take[i] = True
        rows = np.repeat(take, sizes)
        return out(np.repeat(tile, sizes)[rows], fp[rows], n[rows])

    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        key = held[0]
        if not len(key):
            continue
        if hot is not None:  # the rest of a very large group goes out under a name taken from its key
            end = int(np.searchsorted(key != hot, True)) if key[0] == hot else 0
            end = len(key) if end == 0 and (key == hot).all() else end
            if end:
                yield out(np.full(end, mix(np.array([hot]).view(U))[0], U), held[1][:end], held[2][:end])
            held = [h[end:] for h in held]
            key = held[0]
            if not len(key):
                continue
            hot = None
        last = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
        if last:
            yield emit(*[h[:last] for h in held])
            held = [h[last:] for h in held]
        if len(held[0]) > HELD:
            hot = held[0][0]
            yield out(np.full(len(held[0]), mix(np.array([hot]).view(U))[0], U), held[1], held[2])
            held = [np.zeros(0, np.int64)] * 3
    if len(held[0]) and hot is None:
        yield emit(*held)
    elif len(held[0]):
        yield out(np.full(len(held[0]), mix(np.array([hot]).view(U))[0], U), held[1], held[2])


def _folded(signatures: list[bytes], width: int) -> np.ndarray:
    rows = np.empty((len(signatures), width), np.uint8)
    for i, s in enumerate(signatures):
        bits = np.frombuffer(s, np.uint8)
        while len(bits) > width:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        rows[i] = bits
    return rows


def _may_link(n_a, n_b, bits):
    """Does the bound on the overlap leave room for a link? bits: of the xor of the two signatures."""
    return (100 + PERCENT) * ((n_a + n_b - bits) // 2) >= PERCENT * (n_a + n_b)


class _Groups:
    """Union-find over a few values; every value starts on its own."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        above = self.above
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)
        self.above.setdefault(min(x, y), min(x, y))

    def pairs(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.above if (r := self.find(x)) != x]


def _by_name(column: str, pairs, names=("a", "b")):
    """Rows sorted by `column` to the (a, b) that `pairs` gives for the table of each value, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            values = table.column(column).to_numpy()
            edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            done = len(edges) - 1 if last else len(edges) - 2
            held[:] = table.slice(edges[done]).to_batches()
            new: list[tuple[int, int]] = []
            for x, y in zip(edges[:done], edges[1 : done + 1]):
                for pair in pairs(table.slice(x, y - x)):
                    if pair not in seen:
                        seen.add(pair)
                        new.append(pair)
            return pa.record_batch([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=list(names))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if len(held) >= 8:
                yield cut(False)
        if held:
            yield cut(True)

    return run


def _may(n, comp, bits, rows) -> np.ndarray:
    """Which of `rows` (first axis) and all may link, going by size, component and the parity bits."""
    ones = bits.sum(axis=1)
    xor = (ones[rows][:, None] + ones[None, :] - 2 * (bits[rows] @ bits.T)).astype(np.int64)
    ok = _may_link(n[rows][:, None], n[None, :], xor) & (comp[rows][:, None] != comp[None, :])
    return ok & (PERCENT * np.maximum(n[rows][:, None], n[None, :]) <= 100 * np.minimum(n[rows][:, None], n[None, :]))


def _near(block: pa.Table) -> list[tuple[int, int]]:
    """Classes of a block with a partner in another component that they may link with, as (class, least class of its group)."""
    n, fp, comp, side = (block.column(c).to_numpy() for c in ("n", "fp", "comp", "side"))
    high = block.column("high").to_numpy(zero_copy_only=False)
    low = np.flatnonzero(~high)
    if not len(low):
        return []
    signatures = block.column("signature").to_pylist()
    bits = np.unpackbits(_folded(signatures, min(map(len, signatures))), axis=1).astype(np.float32)
    # A class of the lower band meets its own band and the next; of two dealt parts only classes of different ones meet here.
    ok = _may(n, comp, bits, low)
    ok &= high[None, :] | (low[:, None] < np.arange(len(n))[None, :])
    if (side != side[0]).any():
        ok &= side[low][:, None] != side[None, :]
    groups = _Groups()
    for i, j in zip(*np.nonzero(ok)):
        groups.union(int(fp[low[i]]), int(fp[j]))
    return groups.pairs()


def _linked(cell: pa.Table) -> list[tuple[int, int]]:
    """Links of a cell that join different components, by exact intersection, as (class, least class of its group)."""
    fp, comp, side = (cell.column(c).to_numpy() for c in ("fp", "comp", "side"))
    sets = [x.values.to_numpy() for x in cell.column("shingles").combine_chunks()]
    n = np.array([len(s) for s in sets])
    width = min(1 << (8 * int(n.max()) - 1).bit_length(), 1 << 16)
    bits = np.stack([np.bincount(((s.view(U) >> U(13)) % U(width)).astype(np.int64), minlength=width) & 1 for s in sets]).astype(np.float32)
    ok = _may(n, comp, bits, np.arange(len(n)))
    ok &= np.arange(len(n))[:, None] < np.arange(len(n))[None, :]
    if (side != side[0]).any():
        ok &= side[:, None] != side[None, :]
    joined, groups = _Groups(), _Groups()
    for i, j in zip(*np.nonzero(ok)):
        x, y = int(comp[i]), int(comp[j])
        if joined.find(x) == joined.find(y):
            continue
        same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * same >= PERCENT * (n[i] + n[j] - same):
            joined.union(x, y)
            groups.union(int(fp[i]), int(fp[j]))
    return groups.pairs()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sorted arrays to the pairs that link."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        left, right = batch.column(2), batch.column(3)
        ok = np.zeros(len(a), bool)
        for i in range(len(a)):
            x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
            same = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * same >= PERCENT * (len(x) + len(y) - same)
        yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to (fp, sorted array of shingle hashes)."""
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            sets = list(Words(part).shingles(SHINGLE))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["fp", "shingles"])


class _Join:
    def __init__(self, docs: DataFrame, text: str, measures: DataFrame):
        self.texts = docs.select("_file", "_row", F.col(text).cast("string").alias("text"))
        sets = measures.filter("n > 0")
        one = F.min(F.struct("_file", "_row")).alias("at")
        self.classes = store(sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), one).select("fp", "n", "signature", "at.*"))
        self.levels = docs.sparkSession.sparkContext.broadcast(_levels(measures))
        self.links: DataFrame | None = None

    def tiles(self) -> DataFrame:
        keys = self.texts.select("text").mapInArrow(_keys(self.levels), "key long, fp long, n long")
        sorted_keys = keys.repartition("key").sortWithinPartitions("key", "n", "fp")
        tiles = sorted_keys.mapInArrow(_tiles, "tile long, fp long, n long").distinct()
        return store(tiles.withColumn("band", F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9)))

    def shingles(self, needed: DataFrame) -> DataFrame:
        """(fp, sorted shingle hashes) of the classes in `needed` (fp), from the text of one document each."""
        rows = store(self.classes.join(needed, "fp").select("_file", "_row"))
        return self.texts.join(rows, ["_file", "_row"]).select("text").mapInArrow(_arrays, "fp long, shingles array<long>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of classes those that link."""
        pairs = store(pairs)
        sets = store(self.shingles(store(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())))
        left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_exact, "a long, b long")

    def contract(self, links: DataFrame) -> DataFrame:
        """Add links and return the components of all so far."""
        found = store(links)
        self.links = found if self.links is None else store(self.links.union(found))
        return components(self.links)

    def cells(self, near: DataFrame, roots: DataFrame) -> DataFrame:
        """Links that join components, among classes that `near` groups (a, b: may link, directly or by others).

        Of each group the classes outside its largest component meet each other and all classes of that one, dealt into cells of
        bounded size, on their exact sets. The links left out join nothing that the cell has not joined.
        """
        near = store(near)
        groups = components(near)
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left")
        nodes = nodes.select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("grp"))
        nodes = store(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "grp", F.coalesce("root", "fp").alias("comp")))
        counts = nodes.groupBy("grp", "comp").agg(F.count("*").alias("rows"))
        main = counts.groupBy("grp").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("all"), F.count("*").alias("comps")).filter("comps > 1")
        parts = lambda rows: F.ceil(rows / (BLOCK // 2))
        main = store(main.select("grp", F.col("main.comp").alias("main"), parts(F.col("main.rows")).alias("main_parts"), parts(F.col("all") - F.col("main.rows")).alias("other_parts")))
        rows = nodes.join(main, "grp").withColumn("in_main", F.col("comp") == F.col("main"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.when(F.col("in_main"), F.col("main_parts")).otherwise(F.col("other_parts"))))
        upto = lambda parts: F.sequence(F.lit(0).cast("long"), parts - 1)
        with_others = F.transform(upto(F.col("other_parts")), lambda q: F.struct(F.lit(False).alias("main"), F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
        with_main = F.transform(upto(F.col("main_parts")), lambda q: F.struct(F.lit(True).alias("main"), F.col("part").alias("i"), q.alias("j")))
        of_main = F.transform(upto(F.col("other_parts")), lambda q: F.struct(F.lit(True).alias("main"), q.alias("i"), F.col("part").alias("j")))
        rows = rows.select("grp", "fp", "comp", "in_main", "part", F.explode(F.when(F.col("in_main"), of_main).otherwise(F.concat(with_others, with_main))).alias("c"))
        cell = F.xxhash64("grp", "c.main", "c.i", "c.j").alias("cell")
        # Sides keep apart the two parts of a cell; within one part of the others all meet.
        side = F.when(F.col("c.main"), F.col("in_main").cast("long")).otherwise(F.col("part"))
        rows = rows.select(cell, "fp", "comp", side.alias("side")).join(self.shingles(store(nodes.join(main, "grp").select("fp"))), "fp")
        rows = rows.select("cell", "fp", "comp", "side", "shingles").repartition("cell").sortWithinPartitions("cell", "fp")
        return rows.mapInArrow(_by_name("cell", _linked), "a long, b long")

    def star(self, tiles: DataFrame) -> DataFrame:
        """Every class against one of its tile and band, where the signatures leave room for a link."""
        leaders = tiles.groupBy("tile", "band").agg(F.min("fp").alias("a"))
        pairs = tiles.join(leaders, ["tile", "band"]).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        signed = self.classes.select("fp", "n", "signature")
        for x in "ab":
            pairs = pairs.join(signed.toDF(x, f"n_{x}", f"s_{x}"), x)
        return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_bounded, "a long, b long")

    def blocks(self, tiles: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of different components of a tile that may link."""
        comp = F.coalesce("root", "fp").alias("comp")
        rows = store(tiles.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("tile", "fp", "n", "band", comp))
        open_tiles = rows.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("fp").alias("near")).filter("x <> y").select("tile", "near")
        # A class belongs to the block of its band and, as the larger one, to that of the band below.
        own = F.struct(F.col("band").alias("band"), F.lit(False).alias("high"))
        below = F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("high"))
        rows = rows.join(open_tiles, "tile").select("tile", "near", "fp", "n", "comp", F.explode(F.array(own, below)).alias("x")).select("tile", "near", "fp", "n", "comp", "x.*")
        key = ["tile", "band"]
        sizes = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.min("near").alias("near"), F.min("high").alias("none_low"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        sizes = store(sizes.filter("NOT none_low AND x <> y").select(*key, "near", "rows", F.ceil(F.col("rows") / BLOCK).alias("parts")))
        # Tiles with the same least class mostly have the same pairs: they go to one task, or a few if they have many rows, among
        # which the blocks of a large tile are dealt, too.
        tasks = store(sizes.groupBy("near").agg(F.ceil(F.sum(F.col("rows") * F.col("parts")) / TASK).alias("tasks")))
        rows = rows.drop("near").join(sizes.drop("rows").join(tasks, "near"), key)
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        rows = rows.select("*", part).select("*", each)
        sides = F.least("part", "other"), F.greatest("part", "other")
        block = F.xxhash64("tile", "band", *sides).alias("block")
        task = F.xxhash64("near", F.pmod(F.col("tile").bitwiseXOR(F.xxhash64("band", *sides)), "tasks")).alias("task")
        rows = rows.select(task, block, "n", "fp", "comp", F.col("part").cast("long").alias("side"), "high")
        rows = rows.join(self.classes.select("fp", "signature"), "fp").repartition("task").select("block", "n", "fp", "comp", "side", "high", "signature")
        return rows.sortWithinPartitions("block", "n", "fp").mapInArrow(_by_name("block", _near), "a long, b long").distinct()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
        ok = PERCENT * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b)
        for i in np.flatnonzero(ok):
            x, y = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
            x, y = _folded([x, y], min(len(x), len(y)))
            ok[i] = _may_link(n_a[i], n_b[i], int(np.bitwise_count(x ^ y).sum()))
        yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def similarity_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: _file, _row, the id, n_shingles, class and component_id.

    component_id is the least id that links reach, the own one included. Null or empty texts have no shingles and link with
    nothing; so do rows of an empty table, which give no rows. Rows with equal ids are rows of their own; a component whose
    ids are all null has a null component_id. Other columns of `docs` are not read, whatever their names.
    """
    docs = located(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_id", "_text")
    measures = measured(docs, ["_file", "_row", "_id"], "_text")
    join = _Join(docs, "_text", measures)
    tiles = join.tiles()
    roots = join.contract(join.verified(join.star(tiles)))
    roots = join.contract(join.cells(join.blocks(tiles, roots), roots))
    least = measures.filter("n > 0").groupBy("fp").agg(F.min("_id").alias("least"))
    labelled = store(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = store(labelled.join(ids, "root").select("fp", "root", "component_id"))
    rows = measures.filter("piece IS NULL").select("_file", "_row", F.col("_id").alias(id), F.col("n").alias("n_shingles"), "fp")
    alone = rows.filter("n_shingles = 0").select("_file", "_row", id, "n_shingles", F.lit(None).cast("long").alias("class"), F.col(id).alias("component_id"))
    linked = rows.filter("n_shingles > 0").join(by_class, "fp").select("_file", "_row", id, "n_shingles", F.col("root").alias("class"), "component_id")
    return linked.unionByName(alone)



def surplus(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_file, _row) of every row that a row of the same group stands for: all but the first of the least id.

    Rows without shingles are no group and never surplus.
    """
    rows = store(similarity_classes(docs, id, text).filter("n_shingles > 0"))
    first = F.min(F.struct(F.col(id).isNull().alias("null_id"), F.col(id).alias("id"), "_file", "_row")).alias("first")
    firsts = rows.groupBy("class").agg(first).select("class", "first._file", "first._row")
    kept = firsts.select(F.col("_file").alias("kept_file"), F.col("_row").alias("kept_row"), "class")
    return rows.join(kept, "class").filter("NOT (_file = kept_file AND _row = kept_row)").select("_file", "_row")

"""Grouping of spelling variants by a bit-sliced position index.

Words one inserted, deleted or replaced letter apart are near. Of two near words with L letters and L or L + 1, either the first L // 2 letters
agree or the last L - L // 2, as there is one error only. So every word joins the buckets of its first and of its last letters, for L its own
length and one less, and each near pair meets in a bucket.

A bucket is a vocabulary with one bitset for every (position, letter), a bit for each word that has that letter there. For a word, four
bitsets over the vocabulary run along its letters, all words of the bucket at once: those without error so far, and those with one
replaced, one missing or one additional letter, the latter two reading the index at the position before or after. The vocabulary
is in the order of counts, so that the number of near words and the most frequent one are read off the bitset; pairs are never made. A
bucket above BLOCK words is dealt over several cells, each a part of the words against a part of the vocabulary.
"""

from collections import Counter
from collections.abc import Iterator
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bondmarts.llm.tables import UPPER, LOWER, small_batches
from bondmarts.storage import store

#: Words have at least so many letters and occurrences; a form has at least FACTOR times the occurrences of its variant.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One of so many runs of a document loses a letter.
EVERY = 199
#: Words of a bucket that are one cell.
BLOCK = 8192
#: Characters of a text that are cut into runs at a time, and words counted before a task passes them on.
PIECE, HELD = 1 << 20, 400_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LETTERS)  # shorter runs make no word
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str) -> Counter:
    """Maximal runs of LETTERS letters or more and how often they occur."""
    if len(text) <= PIECE:
        return Counter(_RUN.findall(text))
    found, start = Counter(), 0
    while start < len(text):
        end = _NO_LETTER.search(text, start + PIECE)
        end = end.start() if end else len(text)
        found.update(_RUN.findall(text[start:end]))
        start = end
    return found


def _dropped(run: str, crc: int) -> str:
    """The run, less one letter where EVERY divides the checksum."""
    if crc % EVERY:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id as text, text) to counts of words, combined over many documents of the task."""
    total: dict[str, int] = {}
    record = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            start = zlib.crc32(f"{id or ''}:".encode())
            for run, n in _runs((text.as_py() or b"").translate(_LOWER).decode("utf-8", "replace")).items():
                word = _dropped(run, zlib.crc32(run.encode(), start))
                if len(word) >= LETTERS:
                    total[word] = total.get(word, 0) + n
            if len(total) >= HELD:
                yield record()
                total.clear()
    yield record()


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with at least OCCURRENCES occurrences in the whole texts; written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return store(counts.filter(F.col("n") >= OCCURRENCES))


class Index:
    """Bitsets over a vocabulary in its order: per (position, letter), and per length."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        self.lengths: dict[int, int] = {}
        self.at: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 2)]
        for number, word in enumerate(words):
            bit = 1 << number
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            for letters, letter in zip(self.at, word):
                letters[letter] = letters.get(letter, 0) | bit

    def near(self, word: str, apart: int = -1) -> int:
        """Bitset of the words that differ from `word` by exactly one inserted, deleted or replaced letter.

        With `apart`, those that agree with the first `apart` letters of the word are left out.
        """
        same, replaced, shorter, longer, out = self.all, 0, 0, 0, 0
        none: dict[str, int] = {}
        before = none
        for i, letter in enumerate(word):
            if i == apart:
                out = same
            here = self.at[i].get(letter, 0) if i < len(self.at) else 0
            after = self.at[i + 1].get(letter, 0) if i + 1 < len(self.at) else 0
            # The word has a letter more from here on: read one position back. It lacks one: read one ahead.
            replaced = replaced & here | same & ~here
            shorter = shorter & before.get(letter, 0) | same
            longer = (longer | same) & after
            same &= here
            before = self.at[i] if i < len(self.at) else none
        if len(word) == apart:
            out = same
        size = self.lengths.get
        found = replaced & size(len(word), 0) | shorter & size(len(word) - 1, 0) | (longer | same) & size(len(word) + 1, 0)
        return found & ~out


def _cell_rows(words: list[str], counts: list[int], asks: list[bool], answers: list[bool], group: int, front: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, n_near, nearest, its n) for the asking words of a cell, sorted by count, against the answering ones.

    `group` is L. In a bucket of first letters these are left out of the comparison, as all have them; in one of last letters those are, and
    pairs that agree in the first letters too were found there.
    """
    half = group // 2
    cut = (lambda w: w[half:]) if front else (lambda w: w[: len(w) - (group - half)])
    index = [i for i, answer in enumerate(answers) if answer]
    found = Index([cut(words[i]) for i in index])
    for i, ask in enumerate(asks):
        if ask:
            near = found.near(cut(words[i]), -1 if front else half)
            # Words of L + 1 letters meet each other in the buckets of L + 1.
            if len(words[i]) > group:
                near &= found.lengths.get(len(cut(words[i])) - 1, 0)
            if near:
                best = index[(near & -near).bit_length() - 1]
                yield words[i], near.bit_count(), words[best], counts[best]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, count and word to what `_cell_rows` gives; the rows of one cell are held at a time."""
    names = ["word", "n_near", "best", "best_n"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    held: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        if len(held) > 1:
            cells, words, counts, asks, answers = zip(*held)
            size, side = cells[0].split(":", 2)[:2]
            out.extend(_cell_rows(words, counts, asks, answers, int(size), side == "front"))
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                close()
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def near_words(words: DataFrame, block: int = BLOCK, letters: int = LETTERS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of `words` (word, n; distinct) that have near ones.

    best is the near word of largest n, of those the smallest in code-point order. Words have at least `letters` letters.
    """
    size = F.length("word")
    keys = []
    for less in (0, 1):
        group = size - less
        half = F.floor(group / 2).cast("int")
        front = F.concat_ws(":", group.cast("string"), F.lit("front"), F.left("word", half))
        back = F.concat_ws(":", group.cast("string"), F.lit("back"), F.right("word", group - half))
        keys += [F.when(group >= letters, key) for key in (front, back)]
    rows = words.select("word", "n", F.explode(F.array_compact(F.array(*keys))).alias("bucket"))
    # Buckets above a block are few: no more than 4 / block of the words.
    large = store(rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("parts")).filter("parts > 1"))
    rows = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).alias("part")
    upto = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    rows = rows.select("word", "n", "bucket", "parts", part, F.explode(upto).alias("other"))
    asks = F.struct(F.concat_ws(":", "bucket", "part", "other").alias("cell"), F.lit(True).alias("asks"), (F.col("part") == F.col("other")).alias("answers"))
    answers = F.struct(F.concat_ws(":", "bucket", "other", "part").alias("cell"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    rows = rows.select("word", "n", F.explode(F.array_compact(F.array(asks, F.when(F.col("part") != F.col("other"), answers)))).alias("x"))
    rows = rows.select("x.cell", "word", "n", "x.asks", "x.answers").repartition("cell").sortWithinPartitions("cell", F.col("n").desc(), "word")
    found = rows.mapInArrow(_nearest, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way from word to form (columns of `forms`, without cycles), each step of which doubles."""
    at = store(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = store(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near and form_n.

    Null texts have no words, a null id is empty text in the checksum; repeated rows count each. A word without near words, or whose most
    frequent near word has less than FACTOR times its occurrences, has a null form and form_n and is its own root. Texts without
    words or an empty table give no rows. Other columns are not read.
    """
    words = vocabulary(docs, id, text)
    near = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= FACTOR * F.col("n")
    near = store(near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")))
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Chat formatting of logged conversations, after snapshots of the same conversation are collapsed.

A conversation that was logged again and again as it grew is there several times, each one a prefix of the next. Every turn gets
the hash of all turns up to it, so a conversation is a snapshot of a longer one if its last hash is among the inner hashes of
another. An anti-join keeps the maximal ones, of equal ones that with the least id, and these are rendered.

The hash of a prefix is the xor of the hashes of its turns, each with its turn number, in two independent 64-bit parts. So it can
be summed in blocks of BLOCK turn numbers, and a conversation of any length is dealt over many tasks.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts.storage import store

#: Turn numbers in one block, and in one part of a rendered conversation.
BLOCK = 512
_LAST = (1 << 62) - 1


def _turns(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    named = rows.select(F.col(id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    named = named.filter("conv IS NOT NULL").withColumn("place", F.coalesce("turn", F.lit(_LAST)))
    parts = [F.col("place"), F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    return named.select("*", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("h2"), F.floor(F.col("place") / BLOCK).alias("block"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Per distinct turn its conversation, n turns up to it, their two hashes, and whether it is the last."""
    turns = turns.select("conv", "block", "place", "h1", "h2").distinct()
    inside = W.partitionBy("conv", "block").orderBy("place", "h1", "h2").rowsBetween(W.unboundedPreceding, 0)
    running = turns.select("conv", "block", F.count("*").over(inside).alias("n"), F.bit_xor("h1").over(inside).alias("p1"), F.bit_xor("h2").over(inside).alias("p2"))
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    whole = W.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    blocks = blocks.select(
        "conv", "block", F.sum("rows").over(whole).alias("all"), F.coalesce(F.sum("rows").over(earlier), none).alias("n0"),
        F.coalesce(F.bit_xor("x1").over(earlier), none).alias("q1"), F.coalesce(F.bit_xor("x2").over(earlier), none).alias("q2"),
    )
    n = F.col("n") + F.col("n0")
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    return running.join(blocks, ["conv", "block"]).select("conv", n.alias("n"), xor("p1", "q1").alias("p1"), xor("p2", "q2").alias("p2"), (n == F.col("all")).alias("last"))


def maximal(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv) of the conversations that are no prefix of a longer one, the least id of equal ones."""
    found = store(prefixes(_turns(rows, id, turn, role, text)))
    key = ["n", "p1", "p2"]
    whole = found.filter("last").groupBy(*key).agg(F.min("conv").alias("conv"))
    return whole.join(found.filter("NOT last").select(*key).distinct(), key, "left_anti").select("conv")


def turn_text(role: Column, text: Column) -> Column:
    """One rendered turn. Marks within the text are broken up, so that a text can't pose as a turn."""
    clean = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), clean(role, "unknown"), F.lit("\n"), clean(text, ""), F.lit("<|im_end|>\n"))


def rendered(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations as chat text: id, part, n_turns and text, a row for every BLOCK turn numbers (mostly one, part 0).

    Turns come by number, null numbers last, and turns of one number by their hash. Equal rows are one turn; a null role is
    "unknown", a null text empty; rows without conversation id belong to none and are left out. No rows give no rows.
    """
    turns = _turns(rows, id, turn, role, text)
    kept = store(maximal(rows, id, turn, role, text))
    piece = F.struct("place", "h1", "h2", turn_text(F.col("role"), F.col("text")).alias("piece"))
    parts = turns.join(kept, "conv").groupBy("conv", "block").agg(F.array_sort(F.collect_set(piece)).alias("turns"))
    return parts.select(
        F.col("conv").alias(id), F.col("block").alias("part"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"),
    )

from pyspark.sql import functions as F

from bondmarts.llm import exact
from bondmarts.storage import shared_dir, store

SCHEMA = "doc_id bigint, text string, digest string, n int"
ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (None, "X"), (8, "y" * 100_000), (9, "Y" * 100_000), (10, "abd")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, best(groups[lower(t)]), len(groups[lower(t)])) for i, t in rows), key=repr)


def check(found, rows=ROWS):
    found = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == brute(rows)
    kept = {}
    for r in found:
        kept.setdefault((r.keep_id, r.group_size, r.digest), []).append(r.kept)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert sum(r.kept for r in found) == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in rows})


def test_groups(spark):
    check(exact.duplicates(frame(spark).repartition(3)))


def test_bytes_decide_where_digests_collide(spark):
    """A digest with few values, so that most hits are different texts."""
    check(exact.duplicates(frame(spark), digest=lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(2))))
    check(exact.duplicates(frame(spark), digest=lambda t: F.lit(0)))


def test_empty_table(spark):
    assert exact.duplicates(frame(spark, [])).count() == 0


def test_filter_lets_all_hits_through(spark):
    rows = store(spark.range(3000).select(F.concat(F.lit("file:/x/"), F.col("id").cast("string")).alias("_file"), F.col("id").alias("_row")))
    wanted = rows.filter("_row % 7 = 0")
    passed = exact._maybe_among(rows, wanted)
    assert passed.join(wanted, ["_file", "_row"]).count() == wanted.count()
    assert passed.count() < 1.1 * wanted.count()


def test_state_goes_on_after_a_restart(spark):
    """A second run with the same folder sees the states of the first, and each row once."""
    folder = f"{shared_dir(spark)}/restart"
    columns = "digest string, _file string, _row bigint, id bigint"
    first = spark.createDataFrame([("a", "f", 0, 1), ("a", "f", 1, 2), ("b", "f", 2, 3)], columns)
    first.write.parquet(f"{folder}/in")
    states = lambda: {(r.digest, r.n, r.kept.id) for r in exact.digest_states(spark.readStream.schema(first.schema).parquet(f"{folder}/in"), folder).collect()}
    assert states() == {("a", 2, 2), ("b", 1, 3)}
    assert states() == {("a", 2, 2), ("b", 1, 3)}
    spark.createDataFrame([("a", "g", 0, 9), ("c", "g", 1, 4)], columns).write.mode("append").parquet(f"{folder}/in")
    assert states() == {("a", 3, 9), ("b", 1, 3), ("c", 1, 4)}

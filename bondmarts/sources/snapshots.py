"""Dated bond snapshots and fiscal partitions in Parquet, and which of them is served.

Layout: <root>/bond/snapshot_date=YYYYMMDD, <root>/fiscal/province=…/fiscal_year=… with <root>/fiscal_complete, <root>/builds,
<root>/active.
"""

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from bondmarts import storage
from bondmarts.operators.quality import drop_critical_nulls, fiscal_problems, notes_on_nulls, null_counts, require_columns
from bondmarts.schema import BOND, FISCAL
from bondmarts.sources.staging import province_of, source_label, stage_fiscal, to_fiscal

_FISCAL_KEY = "province string, fiscal_year string"
_STAGED_FISCAL = "city string, revenue string, province string, fiscal_year string, missing_columns string"
_BUILDS = "active_snapshot string, fiscal_year string, updated_at timestamp, snapshots array<string>, notes array<string>"


def _snapshot_path(root: str, date: str) -> str:
    return f"{root}/bond/snapshot_date={date}"


def _write(df: DataFrame, path: str) -> None:
    others = [F.col(f"`{c}`") for c in df.columns if c not in BOND.names]
    df.select(*BOND.names, *others).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_snapshot(df: DataFrame, root: str, date: str) -> bool:
    """Write the bonds of one date with all their columns, unless that snapshot is already complete. True if written.

    A snapshot counts only with its _SUCCESS mark, so what a failed job left behind is written anew.
    """
    path = _snapshot_path(root, date)
    if storage.exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    _write(df, path)
    return True


def build_snapshot(staged: DataFrame, root: str, date: str) -> list[str]:
    """Check staged bonds and write them as a snapshot; returns the notes of the checks.

    One pass over the source: nulls are counted while a draft is written, which the verdict on them publishes or drops.
    """
    spark, path = staged.sparkSession, _snapshot_path(root, date)
    if storage.exists(spark, f"{path}/_SUCCESS"):
        return []
    require_columns(staged)
    seen, draft = Observation(), f"{root}/_draft/{uuid.uuid4().hex}"
    _write(drop_critical_nulls(staged.observe(seen, *null_counts())), draft)
    try:
        notes = notes_on_nulls(seen.get)
    except ValueError:
        storage.delete(spark, draft)
        raise
    storage.publish(spark, draft, path)
    return notes


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    """Dates of complete snapshots in order. Reads folder names only, no data."""
    names = [n.partition("=")[2] for n in storage.list_names(spark, f"{root}/bond") if n.startswith("snapshot_date=")]
    return sorted(d for d in names if storage.exists(spark, f"{_snapshot_path(root, d)}/_SUCCESS"))


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    return max(list_snapshots(spark, root), default=None)


def bond(spark: SparkSession, root: str, snapshot: str, other: str = "") -> DataFrame:
    """Bonds of one snapshot. The date is a partition, so other snapshots are not opened.

    `other` names source columns outside the schema to read too, as in "`备注` string".
    """
    more = T.StructType.fromDDL(other).fields if other else []
    schema = T.StructType([*BOND.fields, *more, T.StructField("snapshot_date", T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/bond").where(F.col("snapshot_date") == snapshot)


def _complete(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/fiscal_complete"
    return spark.read.schema(_FISCAL_KEY).parquet(path) if storage.exists(spark, path) else None


def fiscal(spark: SparkSession, root: str, province: str | None = None) -> DataFrame:
    """City revenues of all complete provinces and years, or of one province (partition pruning)."""
    complete = _complete(spark, root)
    if complete is None:
        return spark.createDataFrame([], FISCAL)
    table = spark.read.schema(FISCAL).parquet(f"{root}/fiscal")
    table = table.where(F.col("province") == province) if province else table
    return table.join(complete, complete.columns, "left_semi").select(*FISCAL.names)


def read_fiscal_files(spark: SparkSession, folder: str, fiscal_year: str) -> DataFrame:
    """All fiscal CSV files of a year as one staged table; the province is in the file name.

    Files may name their columns differently, so there is one scan per spelling of the header; one job reads all headers.
    """
    names = [n for n in storage.list_names(spark, folder) if n.startswith(f"{fiscal_year}年") and n.endswith("财力.csv")]
    if not names:
        return spark.createDataFrame([], _STAGED_FISCAL)
    paths = [f"{folder}/{n}" for n in names]
    # A file has a row per city; its first line says how the columns are named.
    header = F.regexp_extract(F.decode("content", "UTF-8"), "^\\ufeff?([^\\r\\n]*)", 1)
    files = spark.read.format("binaryFile").load(paths).select("path", header.alias("header"))
    by_header: dict[str, list[str]] = {}
    for r in files.groupBy("header").agg(F.sort_array(F.collect_set("path")).alias("paths")).collect():
        by_header[r.header] = r.paths
    province = province_of(source_label(), fiscal_year)
    tables = [stage_fiscal(spark.read.option("header", True).csv(found), province, fiscal_year) for _, found in sorted(by_header.items())]
    return reduce(DataFrame.unionByName, tables)


def written_fiscal(spark: SparkSession, root: str) -> set[tuple[str, str]]:
    """(province, fiscal year) pairs that are complete in the lake."""
    complete = _complete(spark, root)
    return {(r.province, r.fiscal_year) for r in complete.distinct().collect()} if complete is not None else set()


def available_provinces(spark: SparkSession, root: str, fiscal_year: str) -> list[str]:
    return sorted(p for p, year in written_fiscal(spark, root) if year == fiscal_year)


def write_fiscal(staged: DataFrame, root: str) -> DataFrame:
    """Write provinces that are not complete yet and pass their checks; returns the problems found.

    A failing province is left out, the others go on. A province counts once it is marked, which happens after its files
    are committed; what a failed job left of one is replaced by the next.
    """
    spark = staged.sparkSession
    key = ["province", "fiscal_year"]
    complete = _complete(spark, root)
    if complete is not None:
        staged = staged.join(complete, key, "left_anti")
    problems = storage.store(fiscal_problems(staged))
    good = storage.store(to_fiscal(staged.join(problems.select(*key).distinct(), key, "left_anti")))
    rows = good.select("city", "revenue", *key).repartition(*key)
    files = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key)
    files.option("compression", "snappy").parquet(f"{root}/fiscal")
    good.select(*key).distinct().coalesce(1).write.mode("append").parquet(f"{root}/fiscal_complete")
    return problems


def record_build(spark: SparkSession, root: str, active: str, fiscal_year: str, notes=()) -> DataFrame:
    """Append one row about this build to the audit table and return the row."""
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    row = spark.range(1).select(
        F.lit(active).alias("active_snapshot"),
        F.lit(fiscal_year).alias("fiscal_year"),
        F.date_trunc("second", F.current_timestamp()).alias("updated_at"),
        texts(list_snapshots(spark, root)).alias("snapshots"),
        texts(notes).alias("notes"),
    )
    row.write.mode("append").parquet(f"{root}/builds")
    return row


def builds(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_BUILDS).parquet(f"{root}/builds")


def set_active(spark: SparkSession, root: str, date: str, fiscal_year: str | None = None) -> int:
    """Note which snapshot is served from now on and return the number of the note; the notes of all switches stay.

    A note is a file named by its number, which only one switch can create. A switch that comes second takes the next
    number, so of two at once both are noted and the one with the larger number holds.
    """
    text = json.dumps({"date": date, "fiscal_year": fiscal_year}) + "\n"
    number = max(_active_numbers(spark, root), default=0) + 1
    while not storage.create(spark, f"{root}/active/{number:012d}.json", text):
        number += 1
    return number


def _active_numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in storage.list_names(spark, f"{root}/active") if n.endswith(".json")]


def active(spark: SparkSession, root: str) -> tuple[str, str | None] | None:
    """(date, fiscal year) of the snapshot that was made active last, in this session or an earlier one.

    Names are listed and one note is read. A note without its end is of a switch that died while writing it and does not count.
    """
    for number in sorted(_active_numbers(spark, root), reverse=True):
        text = storage.read_text(spark, f"{root}/active/{number:012d}.json")
        if text.endswith("\n"):
            note = json.loads(text)
            return note["date"], note["fiscal_year"]
    return None


def require_snapshot(spark: SparkSession, root: str, date: str) -> None:
    available = list_snapshots(spark, root)
    if date not in available:
        raise ValueError(f"no snapshot {date}; available: {', '.join(available) or 'none'}")

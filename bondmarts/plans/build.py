"""From raw files to a served snapshot."""

import re

from pyspark.sql import DataFrame, SparkSession

from bondmarts import storage
from bondmarts.plans import serving
from bondmarts.sources import snapshots
from bondmarts.sources.staging import stage_bond

_DATE = re.compile(r"20\d{6}")


def newest_bond_file(spark: SparkSession, folder: str) -> str:
    """Name of the Parquet or CSV file (or folder of files) with the latest date in its name; names without a date come last."""
    names = [n for n in storage.list_names(spark, folder) if n.endswith((".parquet", ".csv"))]
    if not names:
        raise ValueError(f"no bond file in {folder}")
    return max(names, key=lambda n: ((m[0] if (m := _DATE.search(n)) else ""), n))


def read_bond_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)


def build(spark: SparkSession, root: str, bond_folder: str, fiscal_folder: str, fiscal_year: str) -> str:
    """Stage, check and write the newest bond file and the fiscal files of a year, write the marts, serve and record them.

    Returns the snapshot date. What is complete already, from an earlier or a failed run, is not written again.
    """
    name = newest_bond_file(spark, bond_folder)
    found = _DATE.search(name)
    if not found:
        raise ValueError(f"no snapshot date 20YYMMDD in file name {name}")
    date = found[0]
    notes = snapshots.build_snapshot(stage_bond(read_bond_file(spark, f"{bond_folder}/{name}"), date, name), root, date)
    with storage.temporary(spark):
        problems = snapshots.write_fiscal(snapshots.read_fiscal_files(spark, fiscal_folder, fiscal_year), root)
        kinds = problems.groupBy("problem").count().collect()  # three kinds at most
        notes += [f"fiscal: {r['problem']} ({r['count']})" for r in sorted(kinds)]
    serving.write_marts(spark, root, date, fiscal_year)
    serving.activate(spark, root, date, fiscal_year)
    snapshots.record_build(spark, root, date, fiscal_year, notes)
    return date

"""Marts of a snapshot, written by province, which follow the fiscal lake.

Layout below <root>/marts/snapshot_date=…/fiscal_year=…: <view>/inputs=<key>/part=<province>, and manifest/inputs=<key>. The key stands for the
fiscal provinces that were complete when the marts were computed; a manifest says for each view under which key every province
was written. When provinces join the lake, only cities whose revenue changes are looked at: the provinces that hold issuers or
bonds of such cities are computed again, the next manifest points to the old files for all others. Files that a manifest
points to are never changed, and a manifest counts only once it is complete, so a lost run leaves the earlier marts as they were.
A view that was wanted by itself before has a manifest of its own, manifest_of/<view>/inputs=<key>; the marts take it over as it is.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bondmarts import storage
from bondmarts.functions.numeric import fiscal_band
from bondmarts.operators import agency, city, issuers, underwriter
from bondmarts.schema import ISSUER_COLUMNS
from bondmarts.sources import snapshots

_MANIFEST = "view string, schema string, parts map<string, string>, covered array<string>"
#: Views with a city's revenue or band in them; the others depend on bonds only.
ENRICHED = "int_v_issuer_enriched"


def _part(province: Column) -> Column:
    """Name of the folder of a province: letters and digits whatever the name holds, null apart from empty."""
    return F.coalesce(F.concat(F.lit("p"), F.hex(F.encode(province, "UTF-8"))), F.lit("null"))


def covered(spark: SparkSession, root: str, fiscal_year: str | None) -> list[str]:
    """Fiscal partitions that marts of now are computed from, as province and year. They never change once complete."""
    return sorted(f"{year}/{province}" for province, year in snapshots.written_fiscal(spark, root) if fiscal_year in (None, year))


def _key(names: list[str]) -> str:
    return hashlib.md5("\n".join(names).encode()).hexdigest()[:16]


class MartStore:
    """The written marts of one snapshot and fiscal year (all years if None)."""

    def __init__(self, spark: SparkSession, root: str, date: str, fiscal_year: str | None = None):
        self.spark, self.root, self.date, self.fiscal_year = spark, root, date, fiscal_year
        self.path = f"{root}/marts/snapshot_date={date}/fiscal_year={fiscal_year or 'all'}"

    def _fiscal(self, names: list[str]) -> DataFrame:
        """City revenues of the named partitions."""
        rows = snapshots.fiscal(self.spark, self.root)
        wanted = self.spark.createDataFrame([tuple(n.split("/", 1)) for n in names], "fiscal_year string, province string")
        return rows.join(wanted, ["province", "fiscal_year"], "left_semi").select(*rows.columns)

    def _manifest_path(self, key: str, view: str | None) -> str:
        return f"{self.path}/{f'manifest_of/{view}' if view else 'manifest'}/inputs={key}"

    def manifest(self, key: str, view: str | None = None) -> dict[str, T.Row] | None:
        """One row a view; none if marts of that key are not complete. With `view` the manifest of that view alone."""
        path = self._manifest_path(key, view)
        if not storage.exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return {r.view: r for r in self.spark.read.schema(_MANIFEST).parquet(path).collect()}

    def _earlier(self, names: list[str]) -> dict[str, T.Row] | None:
        """The complete manifest that covers most of the named partitions and no other."""
        best = None
        for folder in storage.list_names(self.spark, f"{self.path}/manifest"):
            found = self.manifest(folder.partition("=")[2])
            if found and set(found[ENRICHED].covered) <= set(names):
                if best is None or len(found[ENRICHED].covered) > len(best[ENRICHED].covered):
                    best = found
        return best

    def table(self, row: T.Row, parts: list[str] | None = None) -> DataFrame:
        """A view, or some parts of it, as its manifest row says. Only the folders of these are opened."""
        schema = T.StructType.fromJson(json.loads(row.schema))
        folder = f"{self.path}/{row.view}"
        paths = [f"{folder}/inputs={key}/part={part}" for part, key in sorted(row.parts.items()) if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tables(self, key: str) -> dict[str, DataFrame]:
        return {view: self.table(row) for view, row in self.manifest(key).items()}

    def _write(self, view: str, df: DataFrame, key: str) -> dict[str, str]:
        """Write rows of a view by province; a province with very many rows is dealt over several tasks and files."""
        path = f"{self.path}/{view}/inputs={key}"
        rows = df.withColumn("part", _part(F.col("province"))).hint("rebalance", "part")
        rows.write.mode("overwrite").partitionBy("part").parquet(path)
        return {n.partition("=")[2]: key for n in storage.list_names(self.spark, path) if n.startswith("part=")}

    def _publish(self, rows: list[tuple], key: str, view: str | None = None) -> None:
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._manifest_path(key, view))

    def _bond(self) -> DataFrame:
        return snapshots.bond(self.spark, self.root, self.date).drop("snapshot_date")

    def written(self) -> bool:
        """Whether the marts were ever completed, for the fiscal lake of now or an earlier one."""
        return self._earlier(covered(self.spark, self.root, self.fiscal_year)) is not None

    def computed(self, compute) -> dict[str, DataFrame]:
        """What `compute` gives of the bonds and the fiscal lake of now; nothing is written."""
        return compute(self._bond(), self._fiscal(covered(self.spark, self.root, self.fiscal_year)))

    def write_view(self, view: str, compute) -> DataFrame:
        """One view, written by itself unless the marts or it are complete. `compute` gives its rows of (bond, fiscal)."""
        names = covered(self.spark, self.root, self.fiscal_year)
        key = _key(names)
        found = self.manifest(key) or self.manifest(key, view)
        if found is None:
            with storage.temporary(self.spark):
                df = compute(self._bond(), self._fiscal(names))
                self._publish([(view, df.schema.json(), self._write(view, df, key), names)], key, view)
            found = self.manifest(key, view)
        return self.table(found[view])

    def write(self, compute) -> str:
        """Bring the marts up to the fiscal lake of now; returns their key. `compute` gives all views of (bond, fiscal)."""
        names = covered(self.spark, self.root, self.fiscal_year)
        key = _key(names)
        if self.manifest(key) is None:
            earlier = self._earlier(names)
            with storage.temporary(self.spark):
                if earlier is None:
                    tables = {view: df for view, df in compute(self._bond(), self._fiscal(names)).items() if view != "v_bond"}
                    rows = []
                    for view, df in tables.items():
                        own = self.manifest(key, view)
                        rows.append(tuple(own[view]) if own else (view, df.schema.json(), self._write(view, df, key), names))
                else:
                    rows = self._refreshed(earlier, self._bond(), names, key)
                self._publish(rows, key)
        return key

    def _refreshed(self, earlier: dict[str, T.Row], bond: DataFrame, names: list[str], key: str) -> list[tuple]:
        """Manifest rows after writing the provinces that the added partitions change."""
        before = earlier[ENRICHED].covered
        added = sorted(set(names) - set(before))
        revenue = storage.store(issuers.city_fiscal(self._fiscal(names)).filter("city IS NOT NULL"))
        old = issuers.city_fiscal(self._fiscal(before)).withColumnRenamed("city_fiscal", "_old")
        changed = revenue.join(old, "city", "left").filter(~F.col("city_fiscal").eqNullSafe(F.col("_old"))).select("city")
        touched = storage.store(self.table(earlier[ENRICHED]).join(storage.store(changed), "city", "left_semi").select("issuer", "province"))
        parts = self._parts(touched)
        e_old = earlier[ENRICHED]
        e = self.table(e_old, parts).drop("city_fiscal", "fiscal_band").join(revenue, "city", "left")
        e = storage.store(e.select(*ISSUER_COLUMNS, "city_fiscal", fiscal_band("city_fiscal").alias("fiscal_band")))
        rest = self.table(e_old, sorted(set(e_old.parts) - set(parts)))
        # Underwriters of an issuer may be counted in provinces other than the issuer's own.
        traded = bond.filter("underwriters IS NOT NULL AND underwriters != ''")
        traded_parts = self._parts(traded.join(touched.select("issuer"), "issuer", "left_semi"))
        own_bonds = bond.filter(_part(F.col("province")).isin(traded_parts)) if traded_parts else bond.limit(0)
        fresh = {
            "v_fiscal": self._fiscal(added),
            ENRICHED: e,
            "v_issuer_profile": issuers.issuer_profile(e),
            "v_agency_competitive_landscape": agency.agency_landscape(e),
            "v_city_credit_overview": city.city_credit_overview(e),
            "v_underwriter_stats": underwriter.underwriter_stats(own_bonds, rest.unionByName(e)),
        }
        written = {view: self._write(view, df, key) for view, df in fresh.items()}
        return [(view, row.schema, {**row.parts, **written.get(view, {})}, names) for view, row in earlier.items()]

    def _parts(self, rows: DataFrame) -> list[str]:
        """Parts of the provinces of some rows: one name a province."""
        return sorted(r.part for r in rows.select(_part(F.col("province")).alias("part")).distinct().collect())

"""The representative bonds of rated issuers, kept from snapshot to snapshot.

Rated bonds fall into buckets of issuers. A new snapshot is read once for the digests of its buckets; a bucket with the same
rated bonds as in any snapshot before is taken over from there, and only issuers of the other buckets are computed and written.
So bonds that were added, changed or removed all count, and the work after the one scan grows with the buckets they touch.

Layout below <root>/issuers/buckets=<n>: written=<date>/bucket=<i>, and manifest/snapshot=<date>, which says for each bucket its
digest and where it was written. Files that a manifest points to are never changed, and a manifest counts only once it is
complete, so a lost run leaves the earlier snapshots as they were.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bondmarts import storage
from bondmarts.operators import digests, issuers
from bondmarts.operators.filters import rated
from bondmarts.schema import BOND, ISSUER_COLUMNS
from bondmarts.sources import snapshots

_MANIFEST = "bucket int, rows long, mixed long, total decimal(30,0), written string"
_SCHEMA = T.StructType([BOND[c] for c in ISSUER_COLUMNS])
BUCKETS = 256


class IssuerStore:
    """Issuers of the snapshots below `root`, written below `folder` (the same unless given). The number of buckets stays with the folder."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.path = f"{folder or root}/issuers/buckets={buckets}"

    def manifest(self, date: str) -> dict[int, T.Row] | None:
        """One row a bucket that has rated bonds; none if the snapshot's issuers are not complete."""
        path = f"{self.path}/manifest/snapshot={date}"
        if not storage.exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return {r.bucket: r for r in self.spark.read.schema(_MANIFEST).parquet(path).collect()}  # at most one row a bucket

    def _earlier(self) -> dict[tuple, str]:
        """Where a bucket with a digest was written, over all complete snapshots."""
        found = {}
        for folder in storage.list_names(self.spark, f"{self.path}/manifest"):
            for r in (self.manifest(folder.partition("=")[2]) or {}).values():
                found[r.bucket, r.rows, r.mixed, r.total] = r.written
        return found

    def write(self, date: str) -> list[int]:
        """Bring a snapshot's issuers into the store, once; returns the buckets that were computed for it."""
        done = self.manifest(date)
        if done is None:
            columns = [*ISSUER_COLUMNS, "security_code"]
            bond = rated(snapshots.bond(self.spark, self.root, date)).select(*columns)
            found = digests.bucket_digests(bond, "issuer", [F.col(c) for c in columns if c != "issuer"], self.buckets).collect()  # one row a bucket
            earlier = self._earlier()
            rows = [(*r, earlier.get(tuple(r), date)) for r in found]
            fresh = [r[0] for r in rows if r[-1] == date]
            if fresh:
                own = issuers.first_bond(bond.filter(digests.bucket("issuer", self.buckets).isin(fresh))).select(*ISSUER_COLUMNS)
                own = own.withColumn("bucket", digests.bucket("issuer", self.buckets)).hint("rebalance", "bucket")
                own.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/written={date}")
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/snapshot={date}")
            done = self.manifest(date)
        return sorted(b for b, r in done.items() if r.written == date)

    def issuers(self, date: str) -> DataFrame:
        """One row per rated issuer of a written snapshot."""
        rows = self.manifest(date)
        if rows is None:
            raise ValueError(f"issuers of snapshot {date} are not written")
        paths = [f"{self.path}/written={r.written}/bucket={b}" for b, r in sorted(rows.items())]
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def enriched(self, date: str, fiscal: DataFrame | None, keys: Sequence[str] = ("city",), fiscal_year: str | None = None) -> DataFrame:
        """As `operators.issuers.enriched` of the snapshot."""
        return issuers.with_band(self.issuers(date), fiscal, keys, fiscal_year)

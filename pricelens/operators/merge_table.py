"""A table that holds the newest row of each key, fed by micro-batches.

The table is a base, the deltas since, and a small manifest that names them:

    base/v=N        one row per key, written by a compaction
    delta/batch=N   one row per key of one micro-batch
    manifest/v=N    one row: the base, the open deltas, the last batch

A batch writes its delta and then a new manifest; only the manifest makes it part of the table. So a batch that is
tried again replaces its own delta or, if its manifest was written, does nothing; and a compaction that breaks off leaves
a folder that no manifest names. Readers take the newest manifest and read the base and at most ``FOLD`` deltas,
whatever the number of batches. A compaction folds the deltas into a new base; folders that neither of the last two
manifests names are then removed. One writer at a time, as a streaming query has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Open deltas at which the table is compacted.
FOLD = 8
_MANIFEST = "version long, base string, deltas array<string>, last_batch long"


@dataclass
class Manifest:
    version: int = 0
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    last_batch: int = -1

    def folders(self) -> list[str]:
        return [*([self.base] if self.base else []), *self.deltas]


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; rows with a null in ``order`` come first."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


class MergeTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], fold: int = FOLD):
        self.spark, self.root, self.keys, self.order, self.fold = spark, root.rstrip("/"), keys, order, fold

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        """Finished folders below ``folder``; a write that broke off has no success mark."""
        files = self._files()
        if not files.exists(self._path(folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(folder))]
        return [n for n in names if files.exists(self._path(f"{folder}/{n}/_SUCCESS"))]

    def manifests(self) -> list[Manifest]:
        """The committed manifests that are kept, newest first."""
        versions = sorted((int(n.partition("=")[2]) for n in self._names("manifest")), reverse=True)
        found = []
        for v in versions[:2]:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={v}").first()
            found.append(Manifest(row["version"], row["base"], list(row["deltas"]), row["last_batch"]))
        return found

    def current(self) -> Manifest:
        return next(iter(self.manifests()), Manifest())

    def _commit(self, m: Manifest) -> None:
        row = self.spark.createDataFrame([(m.version, m.base, m.deltas, m.last_batch)], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={m.version}")

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Add one micro-batch; the same one again changes nothing."""
        m = self.current()
        if batch_id > m.last_batch:
            name = f"delta/batch={batch_id}"
            newest(rows, self.keys, self.order).write.mode("overwrite").parquet(f"{self.root}/{name}")
            m = Manifest(m.version + 1, m.base, [*m.deltas, name], batch_id)
            self._commit(m)
        if len(m.deltas) >= self.fold:
            self.compact()

    def read(self) -> DataFrame | None:
        """The newest row of each key; None before the first batch."""
        folders = self.current().folders()
        if not folders:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{f}") for f in folders]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return newest(whole, self.keys, self.order)

    def compact(self) -> None:
        """Fold the open deltas into a new base."""
        m = self.current()
        if not m.deltas:
            return
        name = f"base/v={m.version + 1}"
        self.read().write.mode("overwrite").parquet(f"{self.root}/{name}")
        self._commit(Manifest(m.version + 1, name, [], m.last_batch))
        self.clean()

    def clean(self) -> None:
        """Remove what neither of the last two manifests names, so that a reader of the one before may finish."""
        kept = self.manifests()
        named = {f for m in kept for f in m.folders()} | {f"manifest/v={m.version}" for m in kept}
        files = self._files()
        for folder in ("base", "delta", "manifest"):
            for n in self._names(folder):
                if f"{folder}/{n}" not in named:
                    files.delete(self._path(f"{folder}/{n}"), True)

    def writer(self, transform=None):
        """A foreachBatch function."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch if transform is None else transform(batch), batch_id)
        return write

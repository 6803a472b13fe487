"""A table in versions: what a version consists of is said by a manifest that is written last.

Rows are written to a folder of their own, which no reader looks into until a manifest names it; a job that fails in
between leaves a folder that nobody reads. A manifest is one row, written by Spark's own committer, so it is there whole or
not at all. Appending leaves out keys that are there already, so a job that is run again adds nothing; replacing is a
manifest that names the new folder only, so a reader sees the old rows or the new ones and never some of both.

One writer at a time: of two that write the same version at once, the later fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import drop_path

_MANIFEST = "version long, folders array<string>, rows long"


class VersionedTable:
    """The table at ``path``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    def manifests(self) -> DataFrame:
        """(version, folders, rows) of every version."""
        if not self._exists(f"{self.path}/manifests"):
            return self.spark.createDataFrame([], _MANIFEST)
        # a version's folder without its file is a manifest that was never finished
        return self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{self.path}/manifests")

    def latest(self) -> tuple[int, list[str]]:
        """The last version's number and folders; (0, []) where there is none."""
        row = self.manifests().orderBy(F.desc("version")).first()
        return (row["version"], list(row["folders"])) if row else (0, [])

    def read(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of the last (or another) version. A table without rows has no columns unless ``schema`` says so."""
        if version is None:
            _, folders = self.latest()
        else:
            row = self.manifests().where(F.col("version") == version).first()
            if row is None:
                raise ValueError(f"no version {version}")
            folders = list(row["folders"])
        if not folders:
            return self.spark.createDataFrame([], schema or "")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, version: int, folders: list[str], n: int) -> None:
        row = self.spark.createDataFrame([(version, folders, n)], _MANIFEST)
        row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/{version:012d}")

    def append_missing(self, rows: DataFrame, keys: list[str]) -> int:
        """Add the rows whose keys the table lacks; how many there were. Without any, no version is made."""
        version, folders = self.latest()
        if folders:
            rows = rows.join(self.read().select(*keys).distinct(), keys, "left_anti")
        folder = self._write(rows)
        n = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
        if n:
            self._commit(version + 1, [*folders, folder], n)
        else:
            drop_path(self.spark, f"{self.path}/data/{folder}")
        return n

    def replace(self, rows: DataFrame) -> int:
        """Put these rows in the place of all others; the new version. Rows may be derived from the table itself."""
        version, _ = self.latest()
        folder = self._write(rows)
        self._commit(version + 1, [folder], self.spark.read.parquet(f"{self.path}/data/{folder}").count())
        return version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions names; how many. Not while others write."""
        named = {f for r in self.manifests().orderBy(F.desc("version")).limit(keep).collect() for f in r["folders"]}
        if not self._exists(f"{self.path}/data"):
            return 0
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        there = [x.getPath().getName() for x in where.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(where)]
        gone = [f for f in there if f not in named]
        for f in gone:
            drop_path(self.spark, f"{self.path}/data/{f}")
        return len(gone)

"""Session helpers: table access and storage that every executor can reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    free = (f"terrane_{k}" for k in range(len(taken) + n))
    return [c for c in free if c not in taken][:n]


def parts_for(spark: SparkSession, rows: int, rows_a_part: int = 1_000_000) -> int:
    """How many partitions hold ``rows`` with about ``rows_a_part`` in each, no fewer than a shuffle has: a task's sorts and
    hash tables then stay as they are when tables grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_part))


#: Folders made where ``spark.checkpoint.dir`` is unset, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private temporary one only on a local master where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # a running session's setting can't be changed, so the folder is remembered here
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="terrane-shared-")
    return base.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/terrane/{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def release(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``materialize``, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "terrane_path", None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, whatever file system it is on; a stopped session leaves it."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder as Parquet and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.terrane_path = path
    return held

"""Arrow batches of few rows, for rows that hold whole sets or texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from terrane.session import materialize


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, at most ``rows`` rows go to a Python worker at once; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    with small_batches(df.sparkSession, rows):
        return materialize(df, label)

"""Marts: results persisted as Parquet between steps.

``write_mart`` / ``read_mart`` optionally partition by columns (e.g. by date),
so later date-window filters prune partitions.  Zip archives of CSV files are
in ``sources.zipped``, plain CSV files in ``sources.tables``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_mart(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Persist ``df`` as Parquet (the hand-off table between steps)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Lineage cuts and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.fixpoint import cut, forget, remove, scratch, shared_folder

__all__ = ["BROADCAST_BYTES", "cut", "forget", "remove", "scratch", "shared_folder", "table", "written"]

#: Frames with at most this many bytes (by a count of their rows) are broadcast; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and its path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path

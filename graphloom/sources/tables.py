"""Tables by path or name: scans, overwriting writes, temporary views, and an optional JDBC scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def replace(df: DataFrame, path: str, *partition_by: str) -> None:
    """Drop-if-exists and create-as-select in one write; levels make good partitions, as queries filter on them."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def insert(into: DataFrame, rows: DataFrame) -> DataFrame:
    """into with rows appended by name; columns that rows lack become null."""
    return into.unionByName(rows, allowMissingColumns=True)


def temporary(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def drop_temporary(spark: SparkSession, name: str) -> bool:
    """Whether there was such a view."""
    return spark.catalog.dropTempView(name)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; credentials come with the options, never from the code."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()

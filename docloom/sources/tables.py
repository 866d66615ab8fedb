"""Relational sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **properties: str,
) -> DataFrame:
    """Table in a database. With ``key`` and ``bounds`` the scan is split into parallel range reads;
    Spark pushes filters and the column list into each of them."""
    if key and bounds:
        return spark.read.jdbc(
            url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=partitions, properties=properties,
        )
    return spark.read.jdbc(url, table, properties=properties)

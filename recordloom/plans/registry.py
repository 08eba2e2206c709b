"""Where the queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder of tables) -> DataFrame, and its SQL if there is any."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, spread: str | None = None) -> DataFrame:
    """A table of the folder.

    ``spread`` names a column to distribute rows by when the scan alone has fewer tasks than
    the cluster has cores: for queries with heavy work per row on a table of one small file.
    A table of many splits is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread is not None and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, spread)
    return df

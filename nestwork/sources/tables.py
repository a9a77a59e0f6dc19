"""Parquet tables in a folder, one ``<name>.parquet`` file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reader(spark: SparkSession, folder: str):
    """``name -> DataFrame`` for the tables of one folder."""
    return lambda name: table(spark, folder, name)

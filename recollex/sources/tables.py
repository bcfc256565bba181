"""Readers of the driver's parquet tables.

Every reader is lazy and returns the whole table; pruning of columns and rows
is left to Catalyst, which pushes both to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` under `directory`; one file or a folder of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")

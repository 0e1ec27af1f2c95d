"""Reading the Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def suffix_is(*suffixes: str):
    """Rows of ``event_def`` whose part_file has one of the suffixes."""
    test = F.lit(False)
    for s in suffixes:
        test = test | F.col("part_file").endswith(s)
    return test


def level_map(spark: SparkSession, folder: str) -> dict[str, str]:
    """The fixed table level_alias (about 40 rows) as a dictionary."""
    return {r["spelling"]: r["level"] for r in table(spark, folder, "level_alias").collect() if r["spelling"]}

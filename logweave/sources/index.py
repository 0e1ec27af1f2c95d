"""Stored events that grow by new files only, and indexes of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.sources.readers import read


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def add_new_files(spark: SparkSession, path: str, store: str, **how) -> int:
    """Reads the files of a folder that aren't stored yet, or have changed since, into ``store``: the number of files read.

    ``store/files`` names each file with its size and time, written after its events: a run that breaks off reads those files again,
    and replaces what it wrote of them.  Events lie in ``store/events`` by file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("part_path"), "length", F.unix_millis("modificationTime").alias("changed"))
    known = _stored(spark, f"{store}/files")
    fresh = files if known is None else files.join(known, ["part_path", "length", "changed"], "left_anti")
    fresh = fresh.collect()  # paths, which the driver lists anyway
    if not fresh:
        return 0
    whole = F.regexp_extract("event_ref", r"(?s)^(.*?)(?:!/.*)?:\d+$", 1)  # the file of an archive's member is the archive
    rows = read(spark, [r["part_path"] for r in fresh], **how).withColumn("file", F.sha2(F.regexp_replace(whole, "^(\\w+):/+", "$1:/").cast("binary"), 256))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{store}/events")
    done = spark.createDataFrame([(r["part_path"], r["length"], r["changed"]) for r in fresh], "part_path string, length long, changed long")
    done.coalesce(1).write.mode("append").parquet(f"{store}/files")
    return len(fresh)


def stored_events(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/events").drop("file")


def index_field(events: DataFrame, column: str, folder: str) -> None:
    """An index of a column's values: (value, id) sorted by value, with bloom filters, so that a lookup reads the row groups that may hold it."""
    rows = events.select(column_of(events, column).cast("string").alias("value"), "id").where("value is not null")
    rows = rows.repartitionByRange("value", "id").sortWithinPartitions("value", "id")
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#value", "true").parquet(folder)


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """entries and distinct values of an index."""
    return spark.read.parquet(folder).agg(F.count("*").alias("entries"), F.count_distinct("value").alias("values"))


def by_index(events: DataFrame, folder: str, value: str) -> DataFrame:
    """Events whose indexed column has a value, exactly."""
    ids = events.sparkSession.read.parquet(folder).where(F.col("value") == value).select("id").distinct()
    return events.join(ids, "id", "left_semi")

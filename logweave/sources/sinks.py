"""Export, split and columnar storage of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.transforms import mask_personal

SECRET_KEYS = r"(?i)passw|senha|secret|token|api[_-]?key|authorization|cookie"


def masked(events: DataFrame) -> DataFrame:
    """Personal data and secrets masked in texts and fields."""
    out = events
    for c, t in events.dtypes:
        if t == "string" and c not in ("event_ref", "part_file", "parse_status", "level"):
            out = out.withColumn(c, mask_personal(F.col(c)))
    if "fields" in events.columns:
        out = out.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k.rlike(SECRET_KEYS), "‹secret›").otherwise(mask_personal(v))))
    return out


def export(events: DataFrame, path: str, kind: str = "jsonl", mask: bool = False) -> None:
    rows = masked(events) if mask else events
    if kind == "jsonl":
        rows.write.mode("error").json(path)
    elif kind == "csv":
        flat = rows.withColumn("fields", F.to_json("fields")) if "fields" in rows.columns else rows
        flat.write.mode("error").option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def split(events: DataFrame, rule: Column, matched: str, rest: str | None = None, text: str = "raw") -> None:
    """Records that satisfy a rule to one folder, the others (missing counts as no) to another; each in its own order."""
    hit = F.coalesce(rule, F.lit(False))
    for path, some in ((matched, events.where(hit)), (rest, events.where(~hit))):
        if path:
            some.select(text).write.mode("error").text(path)


def store(events: DataFrame, path: str) -> None:
    """Columnar copy: by day, sorted by time within files, so that row groups can be skipped."""
    day = F.coalesce(F.to_date(F.timestamp_millis("ts")).cast("string"), F.lit("undated"))
    rows = events.withColumn("day", day)
    rows.repartitionByRange("day", "ts").sortWithinPartitions("day", "ts").write.mode("overwrite").partitionBy("day").parquet(path)


def source_quality(events: DataFrame) -> DataFrame:
    """Records, unparsed and undated ones and the span of each file."""
    return events.groupBy("part_file").agg(F.count("*").alias("records"), F.count_if(F.col("parse_status") != "parsed").alias("unparsed"), F.count_if(F.col("ts").isNull()).alias("undated"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def source_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256, bytes and path of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("part_path"), "length", F.sha2("content", 256).alias("sha256"))


def split_many(events: DataFrame, rules: dict[str, Column], folder: str, text: str = "raw") -> None:
    """Each record to the folder of the first rule that it satisfies, others to ``rest``; one pass, each in its own order."""
    name = F.lit("rest")
    for k, rule in reversed(rules.items()):
        name = F.when(F.coalesce(rule, F.lit(False)), k).otherwise(name)
    events.select(name.alias("part"), F.col(text).alias("value")).write.mode("error").partitionBy("part").text(folder)

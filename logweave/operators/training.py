"""Queries of the general training-data problems: log entries (2), instants (3) and rejected rows (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.entries import frame_entries, parse_texts, with_standard_level
from logweave.operators.rejects import load_delimited
from logweave.operators.stamps import epoch_to_ms, to_epoch_ms
from logweave.tables import level_map, suffix_is, table


def http_entries(spark: SparkSession, folder: str, keep_message: bool = False) -> DataFrame:
    lines = table(spark, folder, "http_records")
    return frame_entries(lines, level_map(spark, folder), keep_message=keep_message)


def event_entries(spark: SparkSession, folder: str, keep_message: bool = False) -> DataFrame:
    """Entries of the .log rows of event_def, one row an id: message holds the entry where raw wraps it."""
    rows = table(spark, folder, "event_def").where(suffix_is(".log")).select("id", "part_file", F.coalesce("message", "raw").alias("text"))
    parsed = parse_texts(rows, level_map(spark, folder), keep_message=keep_message)
    return parsed.select("id", "part_file", "entry.*").dropDuplicates(["id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    levels = level_map(spark, folder)
    http = with_standard_level(http_entries(spark, folder), levels)
    http = http.select(F.lit("http_records").alias("tab"), "first_id", "last_id", "level", F.coalesce("component", F.lit("")).alias("component"))
    log = with_standard_level(event_entries(spark, folder), levels)
    log = log.select(F.lit("event_def").alias("tab"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), "level",
                     F.coalesce("component", F.lit("")).alias("component"))
    return http.unionByName(log)


def p2_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with its fields; level null where none is stated."""
    http = http_entries(spark, folder, True).select(F.lit("http_records").alias("tab"), "first_id", "last_id", "layout", "stamp", "level", "component", "message")
    log = event_entries(spark, folder, True)
    log = log.select(F.lit("event_def").alias("tab"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), "layout", "stamp", "level", "component", "message")
    return http.unionByName(log)


def with_origin(rows: DataFrame, origin: DataFrame) -> DataFrame:
    """Rows with zone, year and date of their file; part_origin is a fixed table of under a hundred rows."""
    return rows.join(F.broadcast(origin.select("part_file", "zone", "ref_year", "ref_date", "day_first")), "part_file", "left")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    origin = table(spark, folder, "part_origin")
    events = table(spark, folder, "event_def").select("id", epoch_to_ms(F.col("timestamp")).alias("epoch_ms")).where("epoch_ms is not null")
    events = events.dropDuplicates(["id"]).select(F.lit("event_def").alias("tab"), F.col("id").alias("rec_id"), "epoch_ms")
    http = http_entries(spark, folder).where("stamp is not null").select(F.col("part").alias("part_file"), F.col("first_id").alias("rec_id"), F.col("stamp").alias("text"))
    stamps = table(spark, folder, "stamp_found")
    part = F.when(F.col("start_pos").isNull() | F.col("end_pos").isNull(), F.col("line")).otherwise(
        F.substring(F.col("line"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    )
    stamps = stamps.select("part_file", F.col("stamp_id").alias("rec_id"), part.alias("text")).where("text is not null").dropDuplicates(["rec_id"])
    written = http.select(F.lit("http_records").alias("tab"), "*").unionByName(stamps.select(F.lit("stamp_found").alias("tab"), "*"))
    written = with_origin(written, origin).withColumn("epoch_ms", to_epoch_ms("text", "zone", "ref_year", "ref_date", "day_first"))
    return events.unionByName(written.where("epoch_ms is not null").select("tab", "rec_id", "epoch_ms"))


def p6_rows(spark: SparkSession, folder: str, keep_fields: bool = True) -> DataFrame:
    rows = table(spark, folder, "event_def").where(suffix_is(".csv")).select("id", "part_file", "raw")
    loaded = load_delimited(rows, table(spark, folder, "part_origin"), level_map(spark, folder), keep_fields=keep_fields)
    return loaded.select("id", "part_file", "load.*")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_rows(spark, folder, False).where("reason is not null").select("id", "reason").distinct()


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records, one row an id, as typed columns (date as written; the instant in epoch_ms, UTC)."""
    f = [F.col("fields")[k] for k in range(7)]
    rows = p6_rows(spark, folder).where("reason is null").dropDuplicates(["id"])
    rows = with_origin(rows.withColumn("stamp", F.concat_ws(" ", f[0], f[1])), table(spark, folder, "part_origin"))
    levels = [x for k, v in level_map(spark, folder).items() for x in (F.lit(k), F.lit(v))]
    return rows.select("id", to_epoch_ms("stamp", "zone", "ref_year", "ref_date", "day_first").alias("epoch_ms"),
                       F.element_at(F.create_map(*levels), F.lower(f[2])).alias("level"), f[3].alias("source"), f[4].alias("message"),
                       f[5].alias("user"), f[6].try_cast("decimal(38,0)").cast("string").alias("bytes"))

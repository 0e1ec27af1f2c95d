"""Event streams: windowed counts, sessions, thresholds and run collapsing with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Dated events with ``event_time`` and a watermark; undated ones are for ``undated``."""
    return events.where("ts is not null").withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", late)


def undated(events: DataFrame) -> DataFrame:
    return events.where("ts is null")


def counts(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return with_event_time(events, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("Crítico", "Erro")).alias("errors")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "errors")


def sessions(events: DataFrame, key: str, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    out = with_event_time(events, late).groupBy(F.session_window("event_time", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(events: DataFrame, key: str = "event_ref", late: str = "10 minutes") -> DataFrame:
    """Events that come again within the watermark are dropped."""
    return with_event_time(events, late).dropDuplicatesWithinWatermark([key])


def live_runs(events: DataFrame, key: str, value: str, late: str = "10 minutes", silence: int = 3_600_000) -> DataFrame:
    """Runs of equal consecutive values of a key, given out when the next value comes or the watermark is ``silence`` milliseconds past the run: key, value, start, end, n.

    State is one row a key, dropped with the key's last run.  Events must come in order within a key; late ones count where they arrive.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out, held = [(k[0], *held)], None
            state.remove()
        else:
            rows = pd.concat(list(batches), ignore_index=True)
            for r in rows.sort_values(["ts", "id"]).itertuples():
                if held is not None and held[0] == r.value:
                    held[2], held[3] = max(held[2], r.ts), held[3] + 1
                else:
                    if held is not None:
                        out.append((k[0], *held))
                    held = [r.value, r.ts, r.ts, 1]
        if held is not None:
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(held[2] + silence, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "value", "start", "end", "n"])

    rows = with_event_time(events, late).select(F.col(key).alias("key"), F.col(value).alias("value"), "ts", "id", "event_time")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, value string, start long, end long, n long", "value string, start long, end long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def merge_groups(batch: DataFrame, number: int, folder: str, keys: list[str]) -> None:
    """For ``foreachBatch``: counts, errors, first and last time by keys, kept as partial groups, one folder a batch.

    A batch that comes again replaces its own folder, so that nothing counts twice; ``groups`` adds the partial groups up.
    """
    bad = F.col("level").isin("Crítico", "Erro")
    part = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    part.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def groups(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The groups of all batches so far."""
    return spark.read.parquet(folder).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.min("first").alias("first"), F.max("last").alias("last"))


def compact_groups(spark: SparkSession, folder: str, into: str, keys: list[str]) -> None:
    """All partial groups as one, in a folder of the same form."""
    groups(spark, folder, keys).write.mode("error").parquet(f"{into}/batch=0")


def recompute_days(batch: DataFrame, number: int, events: str, results: str, compute) -> None:
    """For ``foreachBatch``: the batch is added to the stored events, and ``compute`` runs anew over the days that it touches, however late.

    events and results are folders partitioned by ``day``.  A day's events are kept by batch, so that a batch that comes again replaces
    itself; a day's results are overwritten as a whole.  compute: DataFrame of a day's events to DataFrame of its results.
    """
    spark = batch.sparkSession
    rows = batch.where("ts is not null").withColumn("day", F.to_date(F.timestamp_millis("ts")).cast("string"))
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").options(**dynamic).partitionBy("day", "batch").parquet(events)
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # as many as days that the batch touches
    if not days:
        return
    whole = spark.read.parquet(events).withColumn("day", F.col("day").cast("string")).where(F.col("day").isin(days)).drop("batch")
    compute(whole).write.mode("overwrite").options(**dynamic).partitionBy("day").parquet(results)
